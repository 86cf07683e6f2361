"""Quality gates and review rules: reasons, status and scores, all plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import flag, number

#: Review limits of tracks: where a warning starts and where a failure does (fixed values).
LIMITS = {
    "stability_score": (70.0, 45.0),
    "observed_frame_fraction": (0.70, 0.40),
    "valid_ownership_frame_fraction": (0.75, 0.50),
    "root_present_frame_fraction": (0.75, 0.40),
    "shoot_present_frame_fraction": (0.50, 0.20),
    "conflict_frame_fraction": (0.20, 0.50),
    "root_length_drop_mm": (5.0, 15.0),
    "bbox_center_jump_px": (350.0, 750.0),
    "shoot_center_jump_px": (250.0, 600.0),
}
#: Reasons for which a frame fails (fixed values).
FATAL_FRAME_REASONS = (
    "invalid_ownership_measurement",
    "root_missing",
    "large_negative_root_length_drop",
    "large_root_bbox_jump",
    "large_shoot_bbox_jump",
    "large_seedling_bbox_jump",
)


def quality_gate(df: DataFrame, metrics: list[str], valid: str = "ownership_measurement_valid") -> DataFrame:
    """Metrics of invalid rows become null; what they were is kept in ``<metric>_diagnostic_pre_qa``. No validity column: all invalid."""
    ok = flag(valid) if valid in df.columns else F.lit(False)
    out = {}
    for m in (m for m in metrics if m in df.columns):
        before = f"{m}_diagnostic_pre_qa"
        out[before] = F.coalesce(number(before), number(m)) if before in df.columns else number(m)
        out[m] = F.when(ok, number(m))
    return df.withColumns(out)


def _either(value: Column, limits: tuple[float, float], warn: str, fail: str, below: bool = False) -> list[Column]:
    w, f = limits
    if below:
        return [F.when(value < f, fail).when(value < w, warn)]
    return [F.when(value > f, fail).when(value > w, warn)]


def reasons(found: list[Column], joined_by: str = ";") -> Column:
    return F.concat_ws(joined_by, *found)


def frame_review(valid: Column, root: Column, shoot: Column, conflict: Column, drop: Column, root_jump: Column, shoot_jump: Column, seedling_jump: Column, time_source: Column, hours: Column) -> Column:
    """``struct(status, reason_count, reasons)`` of one entity in one frame; unknown numbers count as 0, unknown flags as false."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = [
        F.when(no(valid), "invalid_ownership_measurement"),
        F.when(no(root), "root_missing"),
        F.when(no(shoot), "shoot_missing"),
        F.when(F.coalesce(conflict, F.lit(False)), "seedling_conflict"),
        *_either(zero(drop), LIMITS["root_length_drop_mm"], "negative_root_length_drop", "large_negative_root_length_drop"),
        *_either(zero(root_jump), LIMITS["bbox_center_jump_px"], "root_bbox_jump", "large_root_bbox_jump"),
        *_either(zero(shoot_jump), LIMITS["shoot_center_jump_px"], "shoot_bbox_jump", "large_shoot_bbox_jump"),
        *_either(zero(seedling_jump), LIMITS["bbox_center_jump_px"], "seedling_bbox_jump", "large_seedling_bbox_jump"),
        F.when(F.coalesce(time_source, F.lit("")).contains("default_1h") & (zero(hours) > 0), "default_time_delta_used"),
    ]
    listed = F.filter(F.array(*found), lambda r: r.isNotNull())
    fatal = F.exists(listed, lambda r: r.isin(*FATAL_FRAME_REASONS))
    status = F.when(fatal, "fail").when(F.size(listed) > 0, "review").otherwise("ok")
    return F.struct(status.alias("status"), F.size(listed).alias("reason_count"), F.array_join(listed, ";").alias("reasons"))


def stability_score(observed: Column, valid: Column, root: Column, shoot: Column, conflict: Column, drop: Column, jump: Column) -> Column:
    """0 to 100 from shares of frames, less penalties for the largest drop and jump; three places, half to even."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    base = 100.0 * (0.25 * z(observed) + 0.30 * z(valid) + 0.20 * z(root) + 0.10 * z(shoot) + 0.15 * (1.0 - z(conflict)))
    dropped = F.least(F.lit(20.0), F.greatest(F.lit(0.0), z(drop)) * 2.0)
    jumped = F.least(F.lit(15.0), F.greatest(F.lit(0.0), z(jump) - 250.0) / 25.0)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - dropped - jumped)), 3)


def track_review(score: Column, observed: Column, valid: Column, root: Column, shoot: Column, conflict: Column, drop: Column, bbox_jump: Column, shoot_jump: Column) -> Column:
    """``struct(status, reason_count, reasons)`` of a track: a warning or a failure in each of nine respects."""
    d = lambda c, v: F.coalesce(c, F.lit(v))
    sides = [
        (d(score, 100.0), "stability_score", "low_stability_score", "very_low_stability_score", True),
        (d(observed, 1.0), "observed_frame_fraction", "low_frame_coverage", "very_low_frame_coverage", True),
        (d(valid, 1.0), "valid_ownership_frame_fraction", "some_invalid_ownership_frames", "many_invalid_ownership_frames", True),
        (d(root, 1.0), "root_present_frame_fraction", "root_missing_many_frames", "root_missing_most_frames", True),
        (d(shoot, 1.0), "shoot_present_frame_fraction", "shoot_missing_many_frames", "shoot_missing_most_frames", True),
        (d(conflict, 0.0), "conflict_frame_fraction", "seedling_conflicts", "severe_seedling_conflicts", False),
        (d(drop, 0.0), "root_length_drop_mm", "negative_root_length_drop", "large_negative_root_length_drop", False),
        (d(bbox_jump, 0.0), "bbox_center_jump_px", "root_bbox_jump", "large_root_bbox_jump", False),
        (d(shoot_jump, 0.0), "shoot_center_jump_px", "shoot_bbox_jump", "large_shoot_bbox_jump", False),
    ]
    found = [c for v, limit, warn, fail, below in sides for c in _either(v, LIMITS[limit], warn, fail, below)]
    failed = F.lit(False)
    for v, limit, _, _, below in sides:
        failed = failed | ((v < LIMITS[limit][1]) if below else (v > LIMITS[limit][1]))
    listed = F.filter(F.array(*found), lambda r: r.isNotNull())
    status = F.when(F.size(listed) == 0, "ok").when(failed, "fail").otherwise("review")
    return F.struct(status.alias("status"), F.size(listed).alias("reason_count"), F.array_join(listed, ";").alias("reasons"))


def total_review(total: Column, before: Column, change: Column, root_px: Column, shoot_px: Column, model_px: Column, removed_px: Column, green_only: Column, abstained: Column, components: Column) -> Column:
    """``struct(status, reason)`` of a whole-plate frame; status null if nothing is wrong."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    change = F.coalesce(change, z(total) - before)
    known = before.isNotNull() & (before > 0) & change.isNotNull()
    large, moderate = -F.greatest(F.lit(20.0), before * 0.25), -F.greatest(F.lit(8.0), before * 0.12)
    green = F.coalesce(green_only, F.lit(False))
    rows = [
        (2, (z(root_px) <= 0) | (z(total) <= 0), "no selected root pixels or zero total root length"),
        (2, known & (change < large), "large negative total-root length drop"),
        (1, known & (change >= large) & (change < moderate), "moderate negative total-root length drop"),
        (1, green & F.coalesce(abstained, F.lit(False)), "RGB crown-green detector abstained; retained model shoot mask"),
        (1, green & (z(model_px) > 0) & (z(removed_px) >= z(model_px)) & (z(shoot_px) <= 0), "model shoot pixels rejected as non-green and no green shoot pixels remained"),
        (1, green & (z(shoot_px) <= 0), "no RGB green-only shoot pixels detected"),
        (1, green & (z(components) >= 18), "many disconnected RGB green shoot components"),
        (1, ~green & (z(shoot_px) <= 0), "no shoot pixels detected"),
    ]
    severity = F.greatest(*(F.when(F.coalesce(c, F.lit(False)), s).otherwise(0) for s, c, _ in rows))
    text = F.concat_ws("; ", *(F.when(c, t) for _, c, t in rows))
    return F.struct(F.when(severity >= 2, "fail").when(severity == 1, "review").alias("status"), text.alias("reason"))


def review_rank(status: Column) -> Column:
    """Failures first, then reviews, then the rest."""
    return F.when(status == "fail", 0).when(status == "review", 1).otherwise(2)


def presence_gate(df: DataFrame, track: list[str], valid: Column, root_area: Column, root_length: Column, shoot_area: Column, least_root: int, least_shoot: int) -> DataFrame:
    """Adds ``presence_status`` and ``valid_after_gate``: rows without any evidence, and shoots without a root in the whole series, aren't valid."""
    area, length = F.coalesce(root_area, F.lit(0.0)), F.coalesce(root_length, F.lit(0.0))
    w = Window.partitionBy(*track)
    root = (area >= max(1, least_root)) | (length > 0)
    shoot = F.coalesce(shoot_area, F.lit(0.0)) >= max(1, least_shoot)
    frames = F.count(F.lit(1)).over(w)
    rooted = (
        (F.sum(root.cast("int")).over(w) >= F.greatest(F.lit(2.0), F.ceil(frames * 0.15).cast("double")))
        | (F.max(area).over(w) >= float(max(150, least_root * 5)))
        | (F.max(length).over(w) >= 5.0)
    )
    only_shoot = (frames > 1) & ~rooted
    present = (root | shoot) & ~only_shoot
    status = F.when(only_shoot, "no_root_evidence_across_timeseries").when(present, "seedling_evidence_present").otherwise("no_seedling_evidence")
    return df.withColumns({"presence_status": status, "valid_after_gate": F.coalesce(valid, F.lit(False)) & present})


def endpoint_promotion(df: DataFrame, group: list[str], frame: str, raw: str, clean: str) -> DataFrame:
    """In groups of a single frame the raw metric stands for the cleaned one."""
    w = Window.partitionBy(*group)
    single = F.min(F.col(frame)).over(w).eqNullSafe(F.max(F.col(frame)).over(w))
    return df.withColumn(clean, F.when(single, F.coalesce(F.col(raw), F.col(clean))).otherwise(F.col(clean)))


def conservation_faults(df: DataFrame, frame: list[str], plant: str, expected: int, plate_length: str, length: str, primary: str, lateral: str) -> DataFrame:
    """Frames whose plants don't add up: other than ``expected`` rows, lengths that differ from the plate's, or parts from the whole."""
    sums = df.groupBy(*frame).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(plant).alias("plants"),
        F.abs(F.sum(length) - F.max(plate_length)).alias("length_off"),
        F.max(F.abs(F.col(primary) + F.col(lateral) - F.col(length))).alias("parts_off"),
    )
    return sums.where((F.col("rows") != expected) | (F.col("plants") != expected) | (F.col("length_off") > 1e-6) | (F.col("parts_off") > 1e-6))


def candidate_priority(confidence: Column, entropy: Column, coverage: Column, labelled: Column) -> Column:
    """``struct(confidence, priority)`` for labelling: given confidence, else certainty, else coverage; unlabelled work is worth more."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, 1.0 - entropy, coverage, F.lit(0.0))))
    priority = F.when(F.coalesce(labelled, F.lit(False)), (1.0 - c) * 0.5).otherwise(1.0 - c)
    return F.struct(c.alias("confidence"), priority.alias("priority"))


def pseudo_label_status(confidence: Column, reviewed: Column, accept: float, reject: float) -> Column:
    return F.when(F.coalesce(reviewed, F.lit(False)), "manual").when(confidence >= accept, "accepted").when(confidence < reject, "skipped_low_confidence").otherwise("staged")


def shares(total: Column, **counts: Column) -> dict[str, Column]:
    """Shares from 0 to 1; 0 where there is no total."""
    return {name: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)))), F.lit(0.0)) for name, c in counts.items()}
