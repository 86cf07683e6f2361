"""Secret scans with multipart credential linking, with DataFrame functions only.

Base spans stand on their own: assignments to secret names, access identifiers, long hexadecimal runs. Weak candidates (account
names, other assigned or random-looking keys, endpoints) are parts of a credential: they are reported only where complementary
parts lie within the same scope of text. That interval join of parts with parts is a range frame over
each document's spans in order of their start, so a document with many parts costs a sort and no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Starts of parts of one credential lie at most so many code points apart.
SCOPE = 400


@dataclass(frozen=True)
class Kind:
    """One kind of span: its pattern (Java and RE2 read it alike), and what a match must hold besides.

    ``value``: the group whose length counts (0: the match); ``also``: patterns that must occur in it.
    """

    name: str
    pattern: str
    role: str
    value: int = 0
    least: int = 1
    base: bool = False
    also: tuple[str, ...] = ()
    hint: tuple[str, ...] = ()


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _assigned(names: list[str], value: str) -> str:
    return f"""({"|".join(map(_either_case, names))})["']?\\x20*[:=]\\x20*["']?({value})"""


#: In the order in which spans with one start are listed. Names and patterns of the first three are fixed values.
KINDS = (
    Kind("assign", _assigned(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]+"), "secret", 2, 12, True, hint=(":", "=")),
    Kind("access", "AKIA[A-Z0-9]+", "id", 0, 18, True, hint=("AKIA",)),
    Kind("hex", "[0-9a-f]{16,}", "secret", 0, 16, True),
    Kind("account", _assigned(["client_?id", "user_?name", "user", "login", "account", "access_?key_?id"], "[A-Za-z0-9+/_.@-]+"), "id", 2, 3, hint=(":", "=")),
    Kind("key", _assigned(["passphrase", "pwd", "pass", "private_?key", "access_?key", "auth", "bearer"], "[A-Za-z0-9+/_.=-]+"), "secret", 2, 8, hint=(":", "=")),
    Kind("random", "[A-Za-z0-9+/]{32,}", "secret", 0, 32, also=("[0-9]", "[A-Z]", "[a-z]")),
    Kind("endpoint", """[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+""", "endpoint", 0, 8, hint=("://",)),
)


def _matches(text: Column, index: int, kind: Kind) -> Column:
    """An array of all matches in order: how much text lies before each (since the last), its length, whether it counts."""
    pattern = F.lit(kind.pattern)
    whole, value = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(kind.value))

    def counts(v: Column) -> Column:
        ok = F.length(v) >= kind.least
        for more in kind.also:
            ok = ok & v.rlike(more)
        return ok

    values = F.transform(value, counts)
    lengths = F.zip_with(whole, values, lambda m, ok: F.struct(F.length(m).alias("length"), ok.alias("ok")))
    rows = F.zip_with(F.split(text, kind.pattern, -1), lengths, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    rows = F.transform(
        F.filter(rows, lambda r: r["m"].isNotNull()),
        lambda r, i: F.struct(F.lit(index).alias("kind"), i.alias("place"), r["gap"].alias("gap"), r["m"]["length"].alias("length"), r["m"]["ok"].alias("ok")),
    )
    possible = text.rlike(kind.pattern)
    if kind.hint:
        hinted = text.contains(kind.hint[0])
        for more in kind.hint[1:]:
            hinted = hinted | text.contains(more)
        possible = hinted & possible
    return F.when(possible, rows).otherwise(F.array().cast("array<struct<kind:int,place:int,gap:int,length:int,ok:boolean>>"))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of each span by start, then kind, comma-joined."""
    name = lambda k: F.element_at(F.array(*(F.lit(x.name) for x in KINDS)), k + 1)
    return F.concat_ws(",", F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, text: str = "text", row_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` of every row.

    Spans are of whole matches, in code points, end exclusive. Matches of one kind don't overlap, the leftmost first; those that fail a
    kind's conditions are passed over. A weak id is reported if a secret starts within ``scope``, a weak secret if an id or
    an endpoint does, an endpoint if both an id and a secret do. A null text counts as an empty one (no spans, the
    hash of nothing); repeated rows and null ids stay rows of their own; an empty table gives no rows; other columns are ignored.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*(_matches(whole, i, k) for i, k in enumerate(KINDS)))
    head = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("place"), F.lit(0).alias("gap"), F.lit(0).alias("length"), F.lit(True).alias("ok")))
    rows = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(row_id).alias("doc_id"), F.concat(head, found).alias("found"))
        .select("row", "doc_id", F.explode("found").alias("m"))
        .select("row", "doc_id", "m.*")
        .repartition("row")
    )
    so_far = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far)).withColumn("start", F.col("end") - F.col("length"))
    placed = placed.where("ok")
    role = F.element_at(F.array(*(F.lit(k.role) for k in KINDS)), F.col("kind") + 1)
    placed = placed.withColumn("role", F.when(F.col("kind") >= 0, role))
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    has = {r: F.max((F.col("role") == r).cast("int")).over(near) == 1 for r in ("id", "secret", "endpoint")}
    linked = (
        F.when(F.col("role") == "id", has["secret"])
        .when(F.col("role") == "secret", has["id"] | has["endpoint"])
        .when(F.col("role") == "endpoint", has["id"] & has["secret"])
    )
    base = F.col("kind").isin([i for i, k in enumerate(KINDS) if k.base])
    placed = placed.withColumn("base", base).withColumn("linked", F.coalesce(linked, F.lit(False)))
    span = F.struct("start", "kind", "end")
    n = lambda i: F.count(F.when(F.col("kind") == i, 1))
    grouped = placed.groupBy("row", "doc_id").agg(
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.collect_list(F.when(F.col("base"), span)).alias("base_spans"),
        F.collect_list(F.when((F.col("kind") >= 0) & (F.col("base") | F.col("linked")), span)).alias("all_spans"),
        F.count(F.when(F.col("linked"), 1)).alias("n_linked"),
    )
    return grouped.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(_listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("all_spans")).alias("spans"),
        "n_linked",
    )


def oracle() -> str:
    """The same in DuckDB's SQL, from the same table of kinds."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, k in enumerate(KINDS):
        also = "".join(f" AND regexp_matches(v, {quote(a)})" for a in k.also)
        parts.append(
            f"SELECT row, {i} AS kind, place, len(g) AS gap, len(m) AS length, len(v) >= {k.least}{also} AS ok FROM ("
            f"SELECT row, unnest(string_split_regex(t, {quote(k.pattern)})) AS g, unnest(regexp_extract_all(t, {quote(k.pattern)}, 0)) AS m,"
            f" unnest(regexp_extract_all(t, {quote(k.pattern)}, {k.value})) AS v, generate_subscripts(string_split_regex(t, {quote(k.pattern)}), 1) AS place"
            f" FROM d WHERE regexp_matches(t, {quote(k.pattern)})) WHERE m IS NOT NULL"
        )
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k.name}'" for i, k in enumerate(KINDS)) + " END"
    roles = "CASE kind " + " ".join(f"WHEN {i} THEN '{k.role}'" for i, k in enumerate(KINDS)) + " END"
    bases = ", ".join(str(i) for i, k in enumerate(KINDS) if k.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, sum(gap + length) OVER (PARTITION BY row, kind ORDER BY place) AS e FROM m),
s AS (SELECT row, kind, CAST(e - length AS BIGINT) AS s, CAST(e AS BIGINT) AS e, {roles} AS role, {names} || ':' || CAST(e - length AS BIGINT) || ':' || CAST(e AS BIGINT) AS said FROM p WHERE ok),
n AS (SELECT *, max(CASE WHEN role = 'id' THEN 1 ELSE 0 END) OVER w AS has_id, max(CASE WHEN role = 'secret' THEN 1 ELSE 0 END) OVER w AS has_secret,
  max(CASE WHEN role = 'endpoint' THEN 1 ELSE 0 END) OVER w AS has_endpoint FROM s WINDOW w AS (PARTITION BY row ORDER BY s RANGE BETWEEN {SCOPE} PRECEDING AND {SCOPE} FOLLOWING)),
l AS (SELECT *, kind IN ({bases}) AS base, CASE role WHEN 'id' THEN has_secret = 1 WHEN 'secret' THEN has_id = 1 OR has_endpoint = 1 ELSE has_id = 1 AND has_secret = 1 END AS linked FROM n),
g AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c, count(*) FILTER (WHERE linked) AS n_linked,
  string_agg(said, ',' ORDER BY s, kind) FILTER (WHERE base) AS base, string_agg(said, ',' ORDER BY s, kind) FILTER (WHERE base OR linked) AS spans FROM l GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN g USING (row)
"""
