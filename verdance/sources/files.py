"""Readers of measurement files, manifests, rasters and sensor cubes."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_in_path, frame_index, petri_name, timestamp_token

#: Numbers of ENVI data types (fixed values).
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
FLUORESCENCE_PARAMETERS = ("Fv/Fm", "Fm", "Fo", "NPQ", "QY")


def clean_columns(df: DataFrame) -> DataFrame:
    """Names without byte-order marks and outer spaces; unnamed index columns go; a name that comes again gets a number."""
    names: dict[str, int] = {}
    out, kept = [], []
    for c in df.columns:
        name = c.replace("﻿", "").replace("ï»¿", "").strip()
        if not name or name.startswith("Unnamed") or name.startswith("_c"):
            continue
        names[name.lower()] = names.get(name.lower(), 0) + 1
        kept.append(F.col(f"`{c}`"))
        out.append(name if names[name.lower()] == 1 else f"{name}.{names[name.lower()]}")
    return df.select(*(c.alias(n) for c, n in zip(kept, out, strict=True)))


def measurements(spark: SparkSession, folder: str, pattern: str = "*.csv", separator: str = ",") -> DataFrame:
    """All measurement files below ``folder`` in one table, with ``source_path, dish, frame, taken`` from their paths.

    Each distinct header is read as its own set of files, and the sets are united by name. Every value is text; ``functions.coerce`` makes numbers.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
    header = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=False)
    heads = header.select(F.col("_metadata.file_path").alias("path"), F.col("value"), F.col("_metadata.file_block_start").alias("at")).where("at = 0")
    first = heads.groupBy("path").agg(F.first("value").alias("head")).groupBy("head").agg(F.collect_list("path").alias("paths"))
    parts = []
    for r in first.toLocalIterator():  # one row for each distinct header
        df = spark.read.option("header", True).option("sep", separator).csv(r["paths"])
        parts.append(clean_columns(df.withColumn("source_path", F.col("_metadata.file_path"))))
    if not parts:
        return files.select(F.col("path").alias("source_path")).limit(0)
    from ..operators.reshape import union_all

    return with_path_metadata(union_all(parts), "source_path")


def with_path_metadata(df: DataFrame, path: str) -> DataFrame:
    """``dish, frame, taken`` from the file's name or else the nearest folder that tells."""
    return df.withColumns(
        {
            "dish": first_in_path(path, petri_name),
            "frame": first_in_path(path, frame_index),
            "taken": first_in_path(path, lambda p: timestamp_token(F.regexp_extract(p, r"(20\d{2}[ ._-]?\d{2}[ ._-]?\d{2}[ ._-]?\d{2}[ ._-]?\d{2}[ ._-]?\d{2})", 1))),
        }
    )


def manifest(df: DataFrame, required: list[str], defaults: dict[str, object], keys: list[str]) -> DataFrame:
    """A manifest with all required columns (or a ``ValueError``), defaults for the optional ones, and the first row of each key."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in df.columns if c not in keys))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def identity_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A plate-identity manifest from CSV (evidence as JSON text) or JSON."""
    evidence = "array<struct<kind:string,text:string,confidence:double,bbox:array<double>>>"
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    df = clean_columns(spark.read.option("header", True).option("escape", '"').csv(path))
    return df.withColumn("evidence", F.from_json("evidence", evidence)) if "evidence" in df.columns else df


def series_files(files: DataFrame, path: str, pattern: str) -> DataFrame:
    """``series, frame, path`` of files whose name fits ``pattern`` (groups 1 and 2); ``duplicate`` marks a frame that occurs again."""
    name = F.substring_index(F.col(path), "/", -1)
    rows = files.select(F.col(path).alias("path"), F.regexp_extract(name, pattern, 1).alias("series"), F.regexp_extract(name, pattern, 2).try_cast("int").alias("frame")).where("series <> ''")
    return rows.withColumn("duplicate", F.count(F.lit(1)).over(Window.partitionBy("series", "frame")) > 1)


def envi_header(text: Column) -> Column:
    """``struct`` of an ENVI header: samples, lines, bands, type, interleave, byte order, offset, wavelengths."""
    number = lambda key: F.regexp_extract(text, rf"(?im)^\s*{key}\s*=\s*(\d+)", 1).try_cast("int")
    waves = F.regexp_extract(text, r"(?is)wavelength\s*=\s*\{([^}]*)\}", 1)
    return F.struct(
        number("samples").alias("samples"),
        number("lines").alias("lines"),
        number("bands").alias("bands"),
        number("data type").alias("data_type"),
        F.lower(F.regexp_extract(text, r"(?im)^\s*interleave\s*=\s*(\w+)", 1)).alias("interleave"),
        F.coalesce(number("byte order"), F.lit(0)).alias("byte_order"),
        F.coalesce(number("header offset"), F.lit(0)).alias("offset"),
        F.filter(F.transform(F.split(waves, ","), lambda w: F.trim(w).try_cast("double")), lambda w: w.isNotNull()).alias("wavelengths"),
    )


def envi_cube(data: bytes, samples: int, lines: int, bands: int, data_type: int, interleave: str, byte_order: int = 0, offset: int = 0) -> np.ndarray:
    """The cube as lines x samples x bands."""
    kind = np.dtype(("<" if byte_order == 0 else ">") + ENVI_TYPES[data_type])
    flat = np.frombuffer(data, kind, samples * lines * bands, offset)
    if interleave == "bsq":
        return flat.reshape(bands, lines, samples).transpose(1, 2, 0)
    if interleave == "bil":
        return flat.reshape(lines, bands, samples).transpose(0, 2, 1)
    return flat.reshape(lines, samples, bands)


def envi_pixels(cubes: DataFrame) -> DataFrame:
    """``path, y, x, band, wavelength, value`` from rows of ``path, content, header``; a band at a time, so a cube never stands whole as rows."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                h = r.header if isinstance(r.header, dict) else r.header.asDict()
                waves = list(h["wavelengths"]) if h["wavelengths"] is not None else []
                cube = envi_cube(r.content, h["samples"], h["lines"], h["bands"], h["data_type"], h["interleave"], h["byte_order"], h["offset"])
                ys, xs = np.indices(cube.shape[:2])
                for b in range(cube.shape[2]):
                    yield pd.DataFrame({"path": r.path, "y": ys.ravel().astype("int32"), "x": xs.ravel().astype("int32"), "band": np.int32(b), "wavelength": float(waves[b]) if b < len(waves) else None, "value": cube[:, :, b].ravel().astype(float)})

    return cubes.select("path", "content", "header").mapInPandas(spread, "path string, y int, x int, band int, wavelength double, value double")


def png_gray(data: bytes) -> np.ndarray:
    """The first channel of an 8-bit PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, head, palette = 8, b"", None, False
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        elif kind == b"PLTE":
            palette = True
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or (palette and colour != 3):
        raise ValueError("only plain 8-bit PNG files are read")
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.int32)
    for y in range(height):
        how, line = int(raw[y, 0]), raw[y, 1:].astype(np.int32)
        up = out[y - 1] if y else np.zeros(width * step, np.int32)
        if how == 0:
            out[y] = line
        elif how == 2:
            out[y] = (line + up) & 255
        else:
            for i in range(width * step):
                left = int(out[y, i - step]) if i >= step else 0
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + int(up[i])) // 2
                else:
                    corner = int(up[i - step]) if i >= step else 0
                    p = left + int(up[i]) - corner
                    guess = min((left, int(up[i]), corner), key=lambda c: abs(p - c))
                out[y, i] = (int(line[i]) + guess) & 255
    return out.reshape(height, width, step)[:, :, 0].astype(np.uint8)


def rasters(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """``path, h, w, bits`` of label rasters; ``error`` tells why one can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    mask = png_gray(bytes(content))
                    rows.append((path, mask.shape[0], mask.shape[1], mask.tobytes(), None))
                except (ValueError, KeyError, TypeError, zlib.error, struct.error) as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "bits", "error"])

    return files.mapInPandas(decode, "path string, h int, w int, bits binary, error string")


def archive_members(files: DataFrame, suffix: str = ".json") -> DataFrame:
    """``path, member, content`` of the members of tar and zip archives (rows of ``path, content``) that end with ``suffix``."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = io.BytesIO(bytes(content))
                if zipfile.is_zipfile(data):
                    with zipfile.ZipFile(data) as z:
                        rows = [(path, n, z.read(n)) for n in z.namelist() if n.endswith(suffix)]
                else:
                    data.seek(0)
                    with tarfile.open(fileobj=data) as t:
                        rows = [(path, m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile() and m.name.endswith(suffix)]
                yield pd.DataFrame(rows, columns=["path", "member", "content"])

    return files.select("path", "content").mapInPandas(unpack, "path string, member string, content binary")


def paired(roots: DataFrame, others: DataFrame, path: str, key: str = r"(\d{8}_\d{6}|\d+)(?=[^/]*$)") -> DataFrame:
    """``key, root_path, other_path``: files of two listings with the same frame key in their names."""
    k = F.regexp_extract(F.col(path), key, 1)
    one = lambda df, out: df.groupBy(k.alias("key")).agg(F.min(path).alias(out)).where("key <> ''")
    return one(roots, "root_path").join(one(others, "other_path"), "key")


def detections(spark: SparkSession, path: str) -> DataFrame:
    """``image, track_id, label, confidence, bbox_x, bbox_y, bbox_w, bbox_h`` from a JSON file of detections by image."""
    schema = "images array<struct<name:string, detections:array<struct<track_id:string, label:string, confidence:double, box:array<double>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("images").alias("i")).select(F.col("i.name").alias("image"), F.explode("i.detections").alias("d"))
    return rows.select("image", "d.track_id", "d.label", "d.confidence", *(F.try_element_at("d.box", F.lit(k + 1)).alias(f"bbox_{c}") for k, c in enumerate("xywh")))


def npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def project_items(spark: SparkSession, folder: str) -> DataFrame:
    """``path, member, meta``: the JSON documents inside project archives below ``folder``, as text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(folder)
    return archive_members(files, ".json").select("path", "member", F.decode("content", "utf-8").alias("meta"))


def dumps(value: object) -> str:
    """Compact JSON; numbers that JSON lacks become null."""
    clean = lambda v: {str(k): clean(x) for k, x in v.items()} if isinstance(v, dict) else [clean(x) for x in v] if isinstance(v, (list, tuple)) else None if isinstance(v, float) and not np.isfinite(v) else v
    return json.dumps(clean(value), separators=(",", ":"))
