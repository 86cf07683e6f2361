"""Registered queries and the roles that tables play in them."""
