"""Names, times and identities in file names and other texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import clean_text

#: Words that name no plate, and names of folders that don't either (fixed values).
GENERIC_WORDS = ["agar", "camera", "control", "date", "dish", "greiner", "lucifer", "npec", "petri", "plate", "time"]
GENERIC_FOLDERS = ["images", "image", "input", "inputs", "jpeg", "jpg", "png", "raw", "rgb", "stabilized", "stabilized_input"]
#: Confidence in an id from a code, a structured file name, any file name and a folder; from where an id is accepted (fixed values).
QR, BARCODE, STRUCTURED, PLAIN, FOLDER, ACCEPTED = 0.99, 0.96, 0.94, 0.56, 0.48, 0.72
#: A date and time with signs between its parts, and one of 14 digits.
_DATE = r"(?<!\d)20\d{2}[._-]\d{2}[._-]\d{2}[ T._-]\d{2}[._:-]\d{2}[._:-]\d{2}(?!\d)|(?<!\d)20\d{12}(?!\d)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def natural_key(c: Column | str) -> Column:
    """A sortable key: runs of digits as numbers, and before text; small letters otherwise."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(_c(c).cast("string"), F.lit(""))), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: p.rlike(r"^\d+$")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(digits(p), 0).otherwise(1).alias("t"),
            F.when(digits(p), p.try_cast("decimal(38,0)")).alias("n"),
            F.when(~digits(p), p).otherwise(F.when(p.try_cast("decimal(38,0)").isNull(), p)).alias("s"),
        ),
    )


def timestamp_token(c: Column | str) -> Column:
    """TIMESTAMP_NTZ of ``20240131_235959``-like tokens: 14 digits in six groups with or without any of `` .-_`` between; years 20xx."""
    raw = F.trim(_c(c).cast("string"))
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"[ .-]+", "_"), "_+", "_"), "^_|_$", "")
    digits = F.when(joined.rlike(r"^20\d{2}(_?\d{2}){5}$"), F.regexp_replace(joined, "_", ""))
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def frame_index(c: Column | str) -> Column:
    """The number after ``frame``, ``t`` or ``_`` at a name's end, else null."""
    text = F.coalesce(_c(c).cast("string"), F.lit(""))
    found = [F.regexp_extract(text, p, 1) for p in (r"(?i)frame[_ -]?(\d+)", r"(?i)(?:^|[_ -])t(\d+)(?:$|[_ .-])", r"_(\d+)(?:\.[A-Za-z0-9]+)?$")]
    return F.coalesce(*(F.when(f != "", f.try_cast("int")) for f in found))


def petri_name(c: Column | str) -> Column:
    """The dish named in a path part such as ``petri_03`` or ``dish-B``, else null."""
    found = F.regexp_extract(F.coalesce(_c(c).cast("string"), F.lit("")), r"(?i)(?:petri|dish|plate)[_ -]*([A-Za-z0-9]+)", 1)
    return F.when(found != "", found)


def first_in_path(path: Column | str, field) -> Column:
    """``field`` of the file's stem, else of its folders from the last to the first."""
    parts = F.split(_c(path), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    folders = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    found = F.filter(F.transform(F.concat(F.array(stem), folders), field), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(1))


def plate_id(c: Column | str) -> Column:
    """A name safe for files: white space and other signs become one underscore; 96 characters at most."""
    text = F.regexp_replace(F.trim(F.coalesce(_c(c).cast("string"), F.lit(""))), r"\s+", "_")
    text = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    return F.left(F.regexp_replace(text, r"^[._-]+|[._-]+$", ""), F.lit(96))


def code_payload(c: Column | str) -> Column:
    """The plate id in a scanned code: without a leading label, of a web address the last part."""
    text = F.regexp_replace(F.trim(F.coalesce(_c(c).cast("string"), F.lit(""))), r"(?i)^(?:URL|PLATE|DISH|ID)\s*:\s*", "")
    tail = F.substring_index(F.regexp_replace(text, "/+$", ""), "/", -1)
    return plate_id(F.when(text.rlike(r"(?i)^https?://"), tail).otherwise(text))


def candidate_tokens(c: Column | str) -> Column:
    """Parts of a text that may be plate ids: numbers of 2 to 4 digits, mixed parts, or short words in capitals."""
    parts = F.transform(F.split(F.coalesce(_c(c).cast("string"), F.lit("")), r"[\s,;:/|]+"), plate_id)

    def may_be(p: Column) -> Column:
        numeric, has_digit = p.rlike(r"^\d+$"), p.rlike(r"\d")
        return (
            F.length(p).between(2, 24)
            & ~F.regexp_replace(F.lower(p), r"^[._-]+|[._-]+$", "").isin(*GENERIC_WORDS)
            & written_time(p).isNull()
            & F.when(numeric, F.length(p).between(2, 4)).when(~has_digit, (F.length(p) <= 12) & (F.upper(p) == p)).otherwise(True)
        )

    return F.filter(parts, may_be)


def written_time(c: Column | str) -> Column:
    """The first date and time written in a text, as TIMESTAMP_NTZ; one that is no real date counts as none."""
    digits = lambda pattern: F.regexp_replace(F.regexp_extract(_c(c), pattern, 0), r"\D", "")
    read = lambda d: F.try_to_timestamp(F.when(F.length(d) == 14, d), F.lit("yyyyMMddHHmmss"))
    parted, joined = _DATE.split("|")
    return F.coalesce(read(digits(parted)), read(digits(joined))).cast("timestamp_ntz")


def file_identity(path: Column | str) -> Column:
    """``struct(plate_id, source, confidence)`` from a file's path alone; null if nothing in it names a plate.

    A name of words, a date and time and a number (``A1 B2_2024-01-31_23-59-59_0001``) is structured: the words before the date are the id. Of any other
    name it is the words left without dates and frame numbers; failing these, those of the folder. Four words at most, joined by ``_``.
    """
    whole = F.coalesce(_c(path), F.lit(""))
    parts = F.split(whole, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    folder = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    words = lambda text: F.array_join(F.slice(candidate_tokens(text), 1, 4), "_")
    before = F.regexp_replace(F.regexp_extract(stem, rf"^(.*?)(?:{_DATE})[_-]\d{{1,7}}$", 1), "^[._ -]+|[._ -]+$", "")
    rest = F.regexp_replace(F.regexp_replace(stem, _DATE, " "), r"(?i)(?:frame|image|img|capture|seq)[_-]*\d+", " ")
    folder_words = F.when(~F.lower(plate_id(folder)).isin(*GENERIC_FOLDERS), words(plate_id(folder)))
    found = lambda value, source, confidence: F.when(
        F.coalesce(value, F.lit("")) != "", F.struct(plate_id(value).alias("plate_id"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    )
    return F.coalesce(found(words(before), "filename", STRUCTURED), found(words(rest), "filename", PLAIN), found(folder_words, "folder", FOLDER))


def identity(qr: Column, barcode: Column, filename: Column, ocr: Column, ocr_confidence: Column, accept: float = ACCEPTED) -> Column:
    """``struct(plate_id, source, confidence, accepted)`` by the best evidence: QR, barcode, structured file name, OCR, plain file name or folder."""
    named = file_identity(filename)
    structured = (named["confidence"] >= STRUCTURED) & written_time(F.element_at(F.split(filename, "/"), -1)).isNotNull()
    option = lambda value, source, confidence: F.when(
        F.coalesce(value, F.lit("")) != "", F.struct(value.alias("plate_id"), F.lit(source).alias("source"), confidence.cast("double").alias("confidence"))
    )
    best = F.coalesce(
        option(code_payload(qr), "qr", F.lit(QR)),
        option(code_payload(barcode), "barcode", F.lit(BARCODE)),
        F.when(structured, named),
        option(plate_id(ocr), "ocr", F.least(F.greatest(ocr_confidence, F.lit(0.0)), F.lit(1.0))),
        named,
    )
    return F.struct(best["plate_id"].alias("plate_id"), best["source"].alias("source"), best["confidence"].alias("confidence"), F.coalesce(best["confidence"] >= accept, F.lit(False)).alias("accepted"))


def hash_fraction(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key alone: 52 bits of SHA-1 of ``salt:key``."""
    digest = F.sha1(F.concat(F.lit(f"{salt}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def title(c: Column | str) -> Column:
    """A metric's column name as a heading."""
    return F.initcap(F.trim(F.regexp_replace(clean_text(c), "[_]+", " ")))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def points(c: Column | str) -> Column:
    """``array<array<double>>`` from a JSON list of points; null if it is none."""
    return F.from_json(_c(c), "array<array<double>>")


def root_type(path: Column | str) -> Column:
    """``ROOT2`` where the path says so, else ``ROOT1``."""
    return F.when(F.upper(_c(path)).contains("ROOT2"), "ROOT2").otherwise("ROOT1")


def fluorescence_channel(path: Column | str) -> Column:
    """``FC2`` where the path says so, else ``FC1``."""
    return F.when(F.upper(_c(path)).contains("FC2"), "FC2").otherwise("FC1")


def plate_group(sample: Column | str) -> Column:
    """The plate of a sample such as ``12-3``, else the sample's slug, else ``unknown``."""
    text = F.trim(F.coalesce(_c(sample).cast("string"), F.lit("")))
    other = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(text.rlike(r"^\d+-\d+$"), F.substring_index(text, "-", 1)).when(other != "", other).otherwise("unknown")


#: Words in a project's path and the family that they tell, first match first (fixed values).
FAMILIES = (
    (("rootpainter", "minirhizotron"), "minirhizotron_public"),
    (("multiplex", "dark", "mxlab"), "arabidopsis_dark_rgb"),
    (("potato",), "potato_rgb"),
    (("lucifer", "rgb"), "plate_rgb_lucifer"),
    (("hades", "bw", "grayscale"), "plate_bw_hades"),
)


def corpus_family(path: Column | str) -> Column:
    """The family of images that a project's path tells; ``generic_root`` if none."""
    text = F.lower(_c(path))
    options = [F.when(text.rlike("|".join(words)), family) for words, family in FAMILIES]
    return F.coalesce(*options, F.lit("generic_root"))


#: Readers by a file's suffix; images for all others (fixed values).
SENSOR_KINDS = {"hdr": "envi", "bil": "envi", "tar": "fluorescence_archive", "npy": "array", "npz": "arrays"}


def sensor_kind(path: Column | str) -> Column:
    """How a sensor's file is read, by its suffix."""
    suffix = F.lower(F.regexp_extract(_c(path), r"\.([^./]*)$", 1))
    return F.coalesce(*(F.when(suffix == s, kind) for s, kind in SENSOR_KINDS.items()), F.lit("image"))


def file_signature(path: Column, size: Column, changed: Column) -> Column:
    """``path:size:time`` of a file, or that it is missing."""
    return F.coalesce(F.concat_ws(":", path, size.cast("string"), F.when(size.isNotNull(), changed.cast("string"))), path)


def plate_fingerprint(frames: DataFrame, plate: list[str], order: list[Column], parts: list[Column], version: str, config: Column) -> DataFrame:
    """``*plate, fingerprint``: SHA-256 of the version, the settings and every frame's parts in order; a plate's frames meet in one row."""
    row = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), F.concat_ws("|", *parts).alias("said"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["said"]), ";")
    return frames.groupBy(*plate).agg(F.sha2(F.concat(F.lit(version), F.max(config), listed).cast("binary"), 256).alias("fingerprint"))
