"""Agreement of predicted with true labels and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, keys: list[str], truth: Column, predicted: Column) -> DataFrame:
    return df.groupBy(*keys, truth.alias("truth"), predicted.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame, keys: list[str], empty: float | None = 0.0) -> DataFrame:
    """``class, tp, fp, fn, precision, recall, dice, iou`` from a confusion table; ratios of nothing are ``empty`` (None: null)."""
    sides = F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(True).alias("t")), F.struct(F.col("predicted").alias("class"), F.lit(False).alias("t"))))
    long = counts.withColumn("s", sides).select(*keys, F.col("s.class").alias("class"), F.col("s.t").alias("t"), "truth", "predicted", "n").where("class IS NOT NULL")
    same = F.col("truth").eqNullSafe(F.col("predicted"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = long.groupBy(*keys, "class").agg(n(same & F.col("t")).alias("tp"), n(~same & ~F.col("t")).alias("fp"), n(~same & F.col("t")).alias("fn"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(empty).cast("double"))
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "dice": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn)})


def macro(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("dice").alias("macro_dice"), F.avg("iou").alias("macro_iou"), F.count(F.lit(1)).alias("classes"))


def length_errors(df: DataFrame, keys: list[str], predicted: str, truth: str) -> DataFrame:
    """``mape`` over rows with a true length, ``wape`` over all."""
    off = F.abs(F.col(predicted) - F.col(truth))
    return df.groupBy(*keys).agg(
        F.avg(F.when(F.col(truth) > 0, off / F.col(truth))).alias("mape"),
        (F.sum(off) / F.greatest(F.sum(truth), F.lit(1e-9))).alias("wape"),
        F.count(F.lit(1)).alias("rows"),
    )


def threshold_sweep(cases: DataFrame, case: str, margin: str, lane: str, ranked: str, truth: str, dice_lane: str, dice_ranked: str, thresholds: list[float]) -> DataFrame:
    """Errors and Dice for each threshold at which the ranked owner replaces the lane's, and the one to choose.

    A threshold is feasible if neither error grows by more than 0.01 and no case loses more than 0.02 of Dice. Of the feasible ones
    (all, if none is) the best has the largest mean Dice, then the least errors, then the smallest threshold.
    """
    tried = cases.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    gated = F.col(margin) >= F.col("threshold")
    rows = tried.withColumns({"__p": F.when(gated, F.col(ranked)).otherwise(F.col(lane)), "__d": F.when(gated, F.col(dice_ranked)).otherwise(F.col(dice_lane))})
    mape = lambda p: F.avg(F.when(F.col(truth) > 0, F.abs(F.col(p) - F.col(truth)) / F.col(truth)))
    wape = lambda p: F.sum(F.abs(F.col(p) - F.col(truth))) / F.greatest(F.sum(truth), F.lit(1e-9))
    worst = rows.groupBy("threshold", case).agg((F.avg("__d") - F.avg(dice_lane)).alias("__loss")).groupBy("threshold").agg(F.min("__loss").alias("worst_dice_change"))
    sums = rows.groupBy("threshold").agg(F.avg("__d").alias("dice"), mape("__p").alias("mape"), wape("__p").alias("wape"), mape(lane).alias("lane_mape"), wape(lane).alias("lane_wape"))
    both = sums.join(worst, "threshold").withColumn(
        "feasible", (F.col("mape") <= F.col("lane_mape") + 0.01) & (F.col("wape") <= F.col("lane_wape") + 0.01) & (F.col("worst_dice_change") >= -0.02)
    )
    # One row for each threshold: a list fixed by the caller.
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("feasible"), F.desc("dice"), "mape", "wape", "threshold")
    return both.withColumn("chosen", F.row_number().over(order) == 1)


def overlap_or_null(intersection: Column, union: Column) -> Column:
    return intersection.cast("double") / F.nullif(union.cast("double"), F.lit(0.0))


def qualification(checks: dict[str, Column]) -> Column:
    """``struct(passed, failed)``: whether all named checks hold, and the names of those that don't."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items())), lambda n: n.isNotNull())
    return F.struct((F.size(failed) == 0).alias("passed"), F.array_join(failed, ";").alias("failed"))


def hausdorff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Largest distance from a pixel of either set to the nearest of the other, by key; the pixels of one key meet in one task."""
    import numpy as np
    import pandas as pd

    both = a.select(*keys, "y", "x", F.lit(0).alias("side")).unionAll(b.select(*keys, "y", "x", F.lit(1).alias("side")))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in a.select(*keys).schema), "hausdorff double"])

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        p, q = (rows.loc[rows["side"] == s, ["y", "x"]].to_numpy(float) for s in (0, 1))
        if not len(p) or not len(q):
            far = None
        else:
            far = 0.0
            for u, v in ((p, q), (q, p)):
                for at in range(0, len(u), 256):
                    far = max(far, float(np.sqrt(((u[at : at + 256, None] - v[None]) ** 2).sum(2)).min(1).max()))
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "hausdorff": [far]})

    return both.groupBy(*keys).applyInPandas(measure, fields)
