"""Joins and lookups between frames, plants, plates and files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], tie: str) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before its time, by key; null where there is none.

    Both sides are laid on one time line and the last known state carried forward: one shuffle by key, no pairs. ``tie`` orders rows
    of ``right`` at one time; keys may be null.
    """
    state = F.struct(*values)
    both = left.select(F.struct(*left.columns).alias("__row"), *keys, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.lit(None).cast(right.select(state.alias("s")).schema["s"].dataType).alias("__state"))
    other = right.where(F.col(time).isNotNull()).select(F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), *keys, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), state.alias("__state"))
    w = Window.partitionBy(*keys).orderBy(F.col("__t").asc_nulls_first(), "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.unionByName(other).withColumn("__last", F.last("__state", ignorenulls=True).over(w)).where("__side = 1")
    return seen.select("__row.*", *(F.col(f"__last.{v}").alias(v) for v in values))


def at_or_before(df: DataFrame, keys: list[str], time: str, when: Column) -> DataFrame:
    """All rows of the last time at or before ``when``, by key."""
    w = Window.partitionBy(*keys)
    known = df.where(F.col(time) <= when).withColumn("__last", F.max(time).over(w))
    return known.where(F.col(time) == F.col("__last")).drop("__last")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys meet; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, on, how).drop(*(f"__{k}" for k in keys))


def rollback(current: DataFrame, baseline: DataFrame, plate: str, keys: list[str], valid: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, audit)``: plates on which a row lost its validity come whole from the baseline; the audit counts regressed rows by plate."""
    ok = lambda alias: F.coalesce(F.col(f"{alias}.{valid}"), F.lit(False))
    pairs = current.alias("c").join(baseline.alias("b"), keys)
    audit = pairs.where(ok("b") & ~ok("c")).groupBy(plate).agg(F.count(F.lit(1)).alias("regressed_rows"))
    plates = audit.select(plate)
    kept = current.join(plates, plate, "left_anti").withColumn("source", F.lit("current"))
    taken = baseline.join(plates, plate, "left_semi").withColumn("source", F.lit("baseline"))
    return kept.unionByName(taken, allowMissingColumns=True), audit


def one_to_one_faults(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that aren't exactly once on each side."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = n(left, "n_left").join(n(right, "n_right"), keys, "full_outer").na.fill(0, ["n_left", "n_right"])
    return both.where("n_left <> 1 OR n_right <> 1")


def outer_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side, with ``side``: both, left_only or right_only."""
    a = left.select(*keys, F.lit(1).alias("__l")).distinct()
    b = right.select(*keys, F.lit(1).alias("__r")).distinct()
    side = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))


def accepted_lookup(frames: DataFrame, accepted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` of the frames, overruled by the sum of accepted rows of the same key."""
    sums = accepted.groupBy(*keys).agg(F.sum(value).alias("__new"))
    return frames.join(sums, keys, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def share_of_whole(plants: DataFrame, whole: DataFrame, keys: list[str], plant: str, value: str) -> DataFrame:
    """Each plant's own summed ``value``, or an equal share of the whole frame's where it has none."""
    own = plants.groupBy(*keys, plant).agg(F.sum(value).alias(value))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return own.withColumn("__n", n).join(whole.select(*keys, F.col(value).alias("__whole")), keys, "left").withColumn(value, F.coalesce(F.col(value), F.col("__whole") / F.col("__n"))).drop("__n", "__whole")


def expected_frames(tracks: DataFrame, frames: DataFrame, plate: list[str], frame: str) -> DataFrame:
    """Tracks with the number of frames that their plate has."""
    return tracks.join(frames.groupBy(*plate).agg(F.countDistinct(frame).alias("expected_frames")), plate, "left")


def lane_centres(df: DataFrame, plate: list[str], plant: str, x: str, lanes: int, width: float) -> DataFrame:
    """``lane_centres`` of each plate: medians by plant, in order, if all lanes have one; else evenly spaced ones."""
    medians = df.where(F.col(x).isNotNull()).groupBy(*plate, plant).agg(F.percentile(x, 0.5).alias("m"))
    found = medians.groupBy(*plate).agg(F.array_sort(F.collect_list("m")).alias("found"))
    even = F.array(*(F.lit((i + 0.5) * width / lanes) for i in range(lanes)))
    return found.select(*plate, F.when(F.size("found") == lanes, F.col("found")).otherwise(even).alias("lane_centres"))


#: Boxes of one grid cell that are compared at once (a cell of more is dealt to tiles, each two parts of it), and boxes compared with others in one array.
PART, ROWS, OTHERS = 1 << 16, 64, 1 << 11


def touching_runs(tile: np.ndarray, side: np.ndarray, seeks: np.ndarray, name: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray, inside: np.ndarray, above: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Boxes of different names that overlap within a tile, each pair once: numbers of boxes, of how many others each meets, and of those in turn.

    Boxes are swept from left to right: those that start within a box are a run of the order. ``inside`` and ``above`` tell whether a box has its left
    and top edge in the tile's cell; the pair's later edges must. A box meets only those of the ``side`` that it ``seeks``.
    """
    at = np.lexsort((right, left, tile))  # at one place those of no width first, as nothing that starts there meets them
    places, heights = np.unique(left), np.unique(np.concatenate([top, bottom]))
    tile, side, seeks, name, left, right, inside, above = (v[at] for v in (tile, side, seeks, name, left, right, inside, above))
    top, bottom = (np.searchsorted(heights, v[at]).astype(np.int32) for v in (top, bottom))
    starts, first = np.flatnonzero(inside), np.cumsum(inside, dtype=np.int32)
    place = tile * (len(places) + 1)
    end = np.searchsorted((place + np.searchsorted(places, left))[starts], place + np.searchsorted(places, right)).astype(np.int32)
    number = np.arange(len(starts), dtype=np.int32)
    tests = [(np.less_equal, first, number), (np.greater, end, number), (np.less, top, bottom[starts]), (np.greater, bottom, top[starts])]
    if not above.all():
        tests.append((np.logical_or, above, above[starts]))
    if (side != seeks).any():
        tests.append((np.equal, seeks, side[starts]))
    if len(np.unique(name)) < len(name):
        tests.append((np.not_equal, name, name[starts]))
    others = at[starts]
    for a in range(0, len(at), ROWS):
        b = min(a + ROWS, len(at))
        for low in range(int(first[a]), int(end[a:b].max()), OTHERS):
            high = min(low + OTHERS, int(end[a:b].max()))
            meet = reduce(np.logical_and, (test(mine[a:b, None], theirs[low:high]) for test, mine, theirs in tests))
            times = np.count_nonzero(meet, axis=1)
            shown = np.flatnonzero(times)
            if len(shown):
                yield at[a:b][shown], times[shown], others[np.flatnonzero(meet) - np.repeat(shown * (high - low) - low, times[shown])]


def touching_pairs(boxes: DataFrame, frame: list[str], plant: str, cell: int = 64) -> DataFrame:
    """``a, b``: plants whose boxes meet in a frame, ``a`` before ``b``.

    Boxes are dealt to the grid cells that they cover, so only neighbours meet; a pair is reported from the first cell that both cover. Each cell is swept
    in a kernel that gives the others that a box meets as arrays, ``OTHERS`` at most in one; crowded cells are shared out to more tasks in tiles.
    """
    from ..functions.geometry import Box

    box, cells = Box.of(), [*frame, "__cx", "__cy"]
    cut = lambda low, size: F.sequence(F.floor(low / cell), F.greatest(F.floor(low / cell), F.floor((low + size) / cell)))
    known = boxes.where(box.exists & ~F.isnan(box.x) & ~F.isnan(box.y)).dropna(subset=[*frame, plant])
    sides = {"__left": box.x, "__top": box.y, "__right": box.x + box.w, "__bottom": box.y + box.h}
    placed = known.withColumn("__cx", F.explode(cut(box.x, box.w))).withColumn("__cy", F.explode(cut(box.y, box.h)))
    placed = placed.select(*cells, F.col(plant).alias("__plant"), *(v.alias(c) for c, v in sides.items()), (F.floor(box.x / cell) == F.col("__cx")).alias("__inside"), (F.floor(box.y / cell) == F.col("__cy")).alias("__above"))
    crowded = placed.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("__parts")).where("__parts > 1")
    # The part is found from the box's values, so a task that is run again deals alike.
    parts = placed.join(F.broadcast(crowded), cells, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    parts = parts.withColumn("__part", F.pmod(F.xxhash64("__plant", *sides), F.col("__parts")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    tiles = [*cells, "__p", "__q"]
    dealt = parts.select(*cells, F.least("__part", "__other").alias("__p"), F.greatest("__part", "__other").alias("__q"), "__plant", *sides, "__inside", "__above", (F.col("__part") > F.col("__other")).alias("__side"))
    # By number, as adaptive execution would join partitions by their bytes: it doesn't know that pairs grow with the square.
    dealt = dealt.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *tiles).sortWithinPartitions(*tiles, "__plant")
    kind = boxes.schema[plant].dataType
    fields = StructType([*(StructField(c, boxes.schema[c].dataType) for c in frame), StructField("__plant", kind), StructField("__others", ArrayType(kind))])

    def changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
        """Whether a row differs from the one before in any of the columns."""
        out = np.zeros(rows.num_rows, bool)
        for c in columns:
            out[1:] |= np.diff(rows[c].combine_chunks().dictionary_encode().indices.to_numpy()) != 0
        return out

    def met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        number = lambda c: rows[c].to_numpy()
        end = lambda c: np.where(np.isnan(v := number(c)), np.inf, v)  # noqa: E731  NaN is over all numbers, as in SQL
        tile, name, side = np.cumsum(changes(rows, tiles)), np.cumsum(changes(rows, [*tiles, "__plant"])), number("__side").astype(np.int8)
        seeks = np.where(number("__p") < number("__q"), 1 - side, side)
        known = rows.select([*frame, "__plant"]).combine_chunks()
        plants = known["__plant"].combine_chunks()

        def shown(found: list[tuple[np.ndarray, ...]]) -> list[pa.RecordBatch]:
            one, times, others = map(np.concatenate, zip(*found, strict=True))
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(times)), pa.int32()), plants.take(pa.array(others)))
            return pa.table([*known.take(pa.array(one)).columns, runs], fields.names).to_batches()

        found, pairs = [], 0
        for run in touching_runs(tile, side, seeks, name, number("__left"), number("__top"), end("__right"), end("__bottom"), number("__inside"), number("__above")):
            found.append(run)
            pairs += len(run[2])
            if pairs > PART:
                yield from shown(found)
                found, pairs = [], 0
        if found:
            yield from shown(found)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unseen = [], 0
        for batch in batches:
            held.append(batch)
            unseen += batch.num_rows
            if unseen > PART:
                rows, unseen = pa.Table.from_batches(held), 0
                last = int(np.flatnonzero(changes(rows, tiles))[-1:].sum())  # the tile that begins there may go on
                held = rows.slice(last).to_batches()
                yield from met(rows.slice(0, last))
        if held:
            yield from met(pa.Table.from_batches(held))

    runs = dealt.mapInArrow(sweep, fields).select(*frame, "__plant", F.explode("__others").alias("__other"))
    return runs.select(*frame, F.least("__plant", "__other").alias("a"), F.greatest("__plant", "__other").alias("b"))


def first_existing_file(wanted: DataFrame, key: str, candidates: str, files: DataFrame, path: str) -> DataFrame:
    """``key, path``: of each row's candidate paths, in order, the first that is in ``files``; null if none is."""
    tried = wanted.select(key, F.posexplode_outer(candidates).alias("__rank", "__path"))
    hits = tried.join(files.select(F.col(path).alias("__path")).distinct(), "__path").groupBy(key).agg(F.min_by("__path", "__rank").alias("path"))
    return wanted.select(key).join(hits, key, "left")


def identity_lookup(images: DataFrame, identities: DataFrame, path: str, name: str, value: str) -> DataFrame:
    """``value`` of each image by its path, else by its name in small letters if only one identity has that name."""
    by_path = identities.groupBy(path).agg(F.min(value).alias("__by_path"))
    by_name = identities.groupBy(F.lower(name).alias("__name")).agg(F.min(value).alias("__by_name"), F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    return images.join(by_path, path, "left").join(by_name, F.lower(name) == F.col("__name"), "left").withColumn(value, F.coalesce("__by_path", "__by_name")).drop("__by_path", "__by_name", "__name")


def same_stem_pairs(a: DataFrame, b: DataFrame, path: str) -> DataFrame:
    """``stem, a_path, b_path``: files of the two listings with one name but for the folder and the extension; the first by path counts."""
    stem = lambda: F.regexp_replace(F.substring_index(F.col(path), "/", -1), r"\.[^.]*$", "")
    one = lambda df, out: df.groupBy(stem().alias("stem")).agg(F.min(path).alias(out))
    return one(a, "a_path").join(one(b, "b_path"), "stem")
