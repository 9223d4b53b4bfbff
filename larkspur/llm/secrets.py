"""Secret scans that link the parts of a credential, in DataFrame functions only.

Some patterns speak for themselves (the base kinds). Others are weak: a long
mixed token, a named identifier or an address alone says little. The scan
reports those when complementary parts stand close together: parts join by the
interval of SCOPE characters about their starts,

* key: a long mixed token with an identifier or an address in its scope,
* ident: a named identifier with a secret (of any kind) in its scope,
* endpoint: an address with both an identifier and a secret in its scope.

Matches are the leftmost ones that don't overlap, kind by kind. Their places
follow from the lengths of the gaps and the matches, as running sums. A row of
the scan is a match, not a text; nothing but matches is shuffled. Places count
characters (code points), ends are exclusive.

Null text counts as empty; empty text has no spans. Repeated rows are scanned
each by itself. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spliced

#: Characters between the starts of parts that belong together, at most.
SCOPE = 200


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token")))
_SET = r"""["']?\x20*[:=]\x20*["']?"""
_IDENT = "|".join(map(_either_case, ("access", "client", "account", "user", "key")))
# Kind -> pattern, the group whose length counts, its least length, a text that every match holds.
PATTERNS = {
    "assign": (rf"({_NAMES}|{_either_case('api')}_?{_either_case('key')}){_SET}([A-Za-z0-9+/_.=-]+)", 2, 6, ""),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    "hex": (r"[0-9a-f]{24,}", 0, 24, ""),
    "key": (r"[A-Za-z0-9+/=_-]{32,}", 0, 32, ""),
    "ident": (rf"({_IDENT})[_-]?(?:[Kk][Ee][Yy][_-]?)?[Ii][Dd]{_SET}([A-Za-z0-9._-]+)", 2, 8, ""),
    "endpoint": (r"""[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9._:@%/?&=+~#-]+""", 0, 10, "://"),
}
KINDS = list(PATTERNS)
BASE, SECRETS, IDENTIFIERS = KINDS[:3], ("assign", "hex", "key"), ("access", "ident")


def _mixed(match: Column) -> Column:
    """A token of one kind of characters only is a word, a number or a rule, not a key."""
    return match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")


def _matches(text: Column, kind: str) -> Column:
    """array of (kind, i, gap before, size, counts) of a kind's matches."""
    pattern, group, least, holds = PATTERNS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)

    def match(hit: Column, i: Column) -> Column:
        counts = F.length(F.get(values, i)) >= least
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("i"),
            F.length(F.get(gaps, i)).alias("gap"),
            F.length(hit).alias("size"),
            (counts & _mixed(hit) if kind == "key" else counts).alias("counts"),
        )

    found = F.transform(hits, match)
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,counts:boolean>>")
    return F.when(text.contains(holds), found).otherwise(none) if holds else found


def spans(df: DataFrame, keep: list[Column], text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of df: keep's columns and spans, an array of
    (start, kind, end), kind an index into KINDS, in that order."""
    names = [f"__k{i}" for i in range(len(keep))]
    value = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)], value.alias("__text"))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    found = F.concat(*[_matches(F.col("__text"), k) for k in KINDS])
    # Rows and matches meet at the row's number, so texts stay where they are.
    rows = rows.select("__row", *names, F.explode_outer(found).alias("m")).repartition("__row")
    by_kind = Window.partitionBy("__row", "m.kind").orderBy("m.i")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(by_kind)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("m.size"))
    rows = rows.withColumn("kind", F.when(F.col("m.counts"), F.col("m.kind")))
    near = Window.partitionBy("__row").orderBy("start").rangeBetween(-scope, scope)

    def close(kinds) -> Column:
        is_one = F.col("kind").isin([KINDS.index(k) for k in kinds])
        return F.coalesce(F.max(is_one).over(near), F.lit(False))

    for name, kinds in (("id", IDENTIFIERS), ("secret", SECRETS), ("address", ("endpoint",))):
        rows = rows.withColumn(f"near_{name}", close(kinds))
    is_kind = lambda k: F.col("kind") == KINDS.index(k)
    reported = (
        F.when(is_kind("key"), F.col("near_id") | F.col("near_address"))
        .when(is_kind("ident"), F.col("near_secret"))
        .when(is_kind("endpoint"), F.col("near_id") & F.col("near_secret"))
        .otherwise(F.col("kind").isNotNull())
    )
    span = F.when(reported, F.struct("start", "kind", "end"))
    out = rows.groupBy("__row").agg(
        *[F.first(n).alias(n) for n in names], F.sort_array(F.collect_list(span)).alias("spans")
    )
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, _names(df, keep), strict=True)], "spans")


def _names(df: DataFrame, keep: list[Column]) -> list[str]:
    return df.select(*keep).columns


def spans_string(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ","
    )


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    found = spans(df, [F.col(doc_id).alias("doc_id")], text)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(spans_string(base), 256).alias("base_sha256"),
        spans_string(F.col("spans")).alias("spans"),
    )


def mask(df: DataFrame, mark: str = "<SECRET>", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with every span of its texts replaced by mark, overlapping spans by one. Rows
    are told apart by doc_id and text; columns of any name pass through."""
    own = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    found = spans(own, [F.col("__id").alias("__doc"), F.xxhash64("__text").alias("__hash")], "__text")
    found = found.where(F.size("spans") > 0).dropDuplicates(["__doc", "__hash"]).withColumnRenamed("spans", "__spans")
    rows = df.select(F.struct("*").alias("__row"), F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    same = F.col("__id").eqNullSafe(F.col("__doc")) & (F.xxhash64("__text") == F.col("__hash"))
    rows = rows.join(found, same, "left").withColumn("__text", spliced(F.col("__text"), F.col("__spans"), F.lit(mark)))
    return rows.select(*[F.col("__text").alias(c) if c == text else F.col("__row").getField(c).alias(c) for c in df.columns])


def _sql() -> str:
    parts = []
    for kind, (pattern, group, least, _) in PATTERNS.items():
        p = pattern.replace("'", "''")
        mixed = " AND regexp_matches(h, '[0-9]') AND regexp_matches(h, '[A-Z]') AND regexp_matches(h, '[a-z]')"
        parts.append(
            f"SELECT row, {KINDS.index(kind)} AS kind, i, length(gaps[i]) AS gap, length(h) AS size, "
            f"length(v) >= {least}{mixed if kind == 'key' else ''} AS counts FROM ("
            f"SELECT row, gaps, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS h, unnest(vals) AS v FROM ("
            f"SELECT row, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS hits, "
            f"regexp_extract_all(text, '{p}', {group}) AS vals FROM docs))"
        )
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    isin = lambda ks: "kind IN (" + ", ".join(str(KINDS.index(k)) for k in ks) + ") AND counts"
    k = KINDS.index
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({" UNION ALL ".join(parts)}),
ends AS (SELECT *, sum(gap + size) OVER (PARTITION BY row, kind ORDER BY i)::BIGINT AS e FROM matches),
places AS (SELECT *, e - size AS s FROM ends),
near AS (SELECT *, coalesce(bool_or({isin(IDENTIFIERS)}) OVER w, false) AS near_id,
  coalesce(bool_or({isin(SECRETS)}) OVER w, false) AS near_secret,
  coalesce(bool_or({isin(("endpoint",))}) OVER w, false) AS near_address
  FROM places WINDOW w AS (PARTITION BY row ORDER BY s RANGE BETWEEN {SCOPE} PRECEDING AND {SCOPE} FOLLOWING)),
told AS (SELECT row, kind, s, {names}[kind + 1] || ':' || s || ':' || e AS span FROM near WHERE counts AND CASE
  WHEN kind = {k("key")} THEN near_id OR near_address WHEN kind = {k("ident")} THEN near_secret
  WHEN kind = {k("endpoint")} THEN near_id AND near_secret ELSE true END),
joined AS (SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
  string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans
  FROM told GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (row)"""


REPORT_SQL = _sql()
