"""Operators on DataFrames: windows, roll-ups, joins, reshapes, reviews, rasters, tracking, scores."""
