"""Coercions: what can't be parsed is missing, NaN is missing, and each text-to-boolean rule keeps its own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that count as true, by where a flag comes from (fixed values); they differ on purpose.
TRUE_WORDS = {
    "validity": ("1", "true", "yes", "y"),
    "review": ("1", "true", "yes", "on", "enabled"),
    "trait": ("1", "true", "yes", "y", "on"),
    "cell": ("true", "1", "1.0", "yes", "y", "on"),
}
FALSE_CELL_WORDS = ("false", "0", "0.0", "no", "n", "off")
MISSING_WORDS = ("nan", "none", "<na>", "nat", "null")


def number(c: Column | str) -> Column:
    """A DOUBLE; text that is no number, NaN and infinities become null."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def number_or(c: Column | str, default: float) -> Column:
    return F.coalesce(number(c), F.lit(float(default)))


def whole_or(c: Column | str, default: int) -> Column:
    """Rounded half to even, as an INT."""
    return F.coalesce(F.bround(number(c)).try_cast("int"), F.lit(default))


def rounded(v: Column, places: int) -> Column:
    """A DOUBLE rounded half away from zero by its binary value, as engines of SQL round; ``F.round`` goes by the shortest decimal text that stands for it."""
    scale = F.lit(10.0**places)
    return F.round(v * scale) / scale


def flag(c: Column | str, rule: str = "validity", default: bool = False) -> Column:
    """A BOOLEAN by the words of ``rule``; the rule ``cell`` gives ``default`` for words that it doesn't know."""
    word = F.lower(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))
    if rule == "cell":
        return F.when(word.isin(*TRUE_WORDS["cell"]), True).when(word.isin(*FALSE_CELL_WORDS), False).otherwise(F.lit(default))
    return F.coalesce(word.isin(*TRUE_WORDS[rule]), F.lit(default))


def clean_text(c: Column | str) -> Column:
    """Trimmed; the words for missing values become empty."""
    text = F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))
    return F.when(F.lower(text).isin(*MISSING_WORDS), "").otherwise(text)


def timestamp(c: Column | str, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd")) -> Column:
    """TIMESTAMP_NTZ by the first format that fits, else null; fractions of a second are kept."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats))


def first_existing(df: DataFrame, candidates: list[str] | tuple[str, ...]) -> str | None:
    """The first candidate that is a column: decided while planning, so rows pay nothing."""
    return next((c for c in candidates if c in df.columns), None)


def backfilled_number(df: DataFrame, candidates: list[str]) -> Column:
    """The first existing candidate as a number, its value from before the quality gate where the gate took it away."""
    name = first_existing(df, candidates)
    if name is None:
        return F.lit(None).cast("double")
    before = f"{name}_diagnostic_pre_qa"
    return F.coalesce(number(name), number(before)) if before in df.columns else number(name)


def class_ids(c: Column | str, fallback: tuple[int, ...] = ()) -> Column:
    """Class numbers 1 to 255 in a text such as ``"1, 3;4"``, each once, in order; ``fallback`` if there are none."""
    parts = F.split(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")), r"[,;\s]+")
    ids = F.array_distinct(F.filter(F.transform(parts, lambda p: p.try_cast("int")), lambda i: i.between(1, 255)))
    return F.when(F.size(ids) > 0, ids).otherwise(F.array(*(F.lit(i) for i in fallback)).cast("array<int>"))


def class_roles(ids: Column) -> Column:
    """``struct(primary, lateral, shoots)``: the first class, the second, all further ones."""
    return F.struct(
        F.try_element_at(ids, F.lit(1)).alias("primary"),
        F.try_element_at(ids, F.lit(2)).alias("lateral"),
        F.when(F.size(ids) > 2, F.slice(ids, 3, 255)).otherwise(F.array().cast("array<int>")).alias("shoots"),
    )


def pixel_size(details: list[Column], fallback: float) -> Column:
    """The first finite size over 0."""
    return F.coalesce(*(F.when(number(d) > 0, number(d)) for d in details), F.lit(float(fallback)))


def plate_value(c: Column | str) -> Column:
    """Canonical text of a plate number: ``"007"`` and ``7.0`` are ``"7"``, other text stays."""
    text = clean_text(c)
    return (
        F.when(text.rlike(r"^\d+$"), F.coalesce(text.try_cast("bigint").cast("string"), text))
        .when(text.rlike(r"^-?\d+\.0+$"), F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text))
        .otherwise(text)
    )


def colour_hex(c: Column | str, default: str = "#ffffff") -> Column:
    """``#rrggbb`` in small letters; three digits are doubled, anything else is ``default``."""
    text = F.lower(F.regexp_replace(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")), "^#", ""))
    short = F.regexp_replace(text, "(.)", "$1$1")
    return F.when(text.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), text)).when(text.rlike("^[0-9a-f]{3}$"), F.concat(F.lit("#"), short)).otherwise(F.lit(default))


def colour_rgb(c: Column | str) -> Column:
    """``struct(r, g, b)`` of ``#rrggbb``."""
    text = F.col(c) if isinstance(c, str) else c
    part = lambda at: F.conv(F.substring(text, at, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def shortened(c: Column | str, limit: int = 32000) -> Column:
    """Text cut for spreadsheets, with a note of what is missing."""
    text = F.col(c) if isinstance(c, str) else c
    note = F.concat(F.lit("… ["), (F.length(text) - limit).cast("string"), F.lit(" more characters]"))
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), note)).otherwise(text)
