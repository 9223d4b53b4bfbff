"""Event inputs: how a rule's field names become columns.

A resolver is a function from a field name to a string column that is null
where the event has no such field; absent and empty differ. Three inputs:

* columns: a mapping from field names to columns, or the columns themselves;
* JSON text: an exact top-level key first, then the dotted path through nested
  objects. Null, arrays and objects are absent, and an exact key shadows the
  path even then. Booleans and numbers are rendered as text. Text ends at an
  embedded NUL. Names of 1024 bytes or more, or with a part that is empty or
  has 128 bytes or more (beyond an exact key), are absent.
* TAB-separated key=value lines: the first = splits, the first of equal keys
  wins, tokens without = are left out, 64 pairs at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import to_f64

Resolver = Callable[[str], Column]
# Limits of names and of pairs in a line.
MAX_NAME, MAX_PART, MAX_PAIRS = 1024, 128, 64


def absent() -> Column:
    return F.lit(None).cast("string")


def from_columns(df: DataFrame, mapping: dict[str, Column | str] | None = None) -> Resolver:
    """Fields are df's columns (as text), under mapping's names where it has them."""
    names, mapped = set(df.columns), mapping or {}

    def field(name: str) -> Column:
        if name in mapped:
            c = mapped[name]
            return (F.col(c) if isinstance(c, str) else c).cast("string")
        if mapping is None and name in names:
            return F.col("`" + name.replace("`", "``") + "`").cast("string")
        return absent()

    return field


def _path(*parts: str) -> str | None:
    """A path of literal keys, or None if no quoting can hold one."""
    out = "$"
    for p in parts:
        if "'" not in p:
            out += f"['{p}']"
        elif '"' not in p:
            out += f'["{p}"]'
        else:
            return None
    return out


def _leaf(root: Column, path: str) -> tuple[Column, Column]:
    """Whether the path is there, and its text if it is a leaf."""
    at = F.try_variant_get(root, path, "variant")
    kind = F.schema_of_variant(at)
    container = kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID")
    text = F.try_variant_get(root, path, "string")
    cut = F.when(F.instr(text, "\0") > 0, F.substring_index(text, "\0", 1)).otherwise(text)
    return at.isNotNull(), F.when(~container, cut)


def from_json(json: Column) -> Resolver:
    """Fields of a column of JSON objects; text that is none has no fields."""
    root = F.try_parse_json(json)

    def field(name: str) -> Column:
        if not name or len(name.encode()) >= MAX_NAME:
            return absent()
        exact = _path(name)
        there, text = _leaf(root, exact) if exact else (F.lit(False), absent())
        parts = name.split(".")
        if len(parts) == 1:
            return text
        if any(not 0 < len(p.encode()) < MAX_PART for p in parts) or not (nested := _path(*parts)):
            return F.when(there, text)
        return F.when(there, text).otherwise(_leaf(root, nested)[1])

    return field


def read_json(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """ord and json of every event in files of JSON arrays, single objects, JSON
    Lines or objects separated by white space.

    strict: the first value that is no object fails the query and names its
    place; otherwise such values are left out. Files are read whole (as an array
    can't be split); `read_json_lines` splits files.
    """
    import json as json_module

    from pyspark.sql import types as T

    @F.udf(T.ArrayType(T.StringType()), useArrow=True)
    def events(text):
        decoder, at, out = json_module.JSONDecoder(), 0, []
        text = text or ""
        while True:
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
            if at >= len(text):
                return out
            try:
                value, end = decoder.raw_decode(text, at)
            except ValueError as e:
                if strict:
                    raise ValueError(f"event {len(out)}: {e}") from e
                return out
            many = value if isinstance(value, list) and not out else [value]
            for v in many:
                if isinstance(v, dict):
                    raw = text[at:end] if v is value else json_module.dumps(v, ensure_ascii=False)
                    out.append(raw)
                elif strict:
                    raise ValueError(f"event {len(out)}: not an object")
            at = end

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    rows = whole.select("file", F.posexplode(events("value")).alias("n", "json"))
    return rows.select(F.struct("file", "n").alias("ord"), "json")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord (file order within a run) and json of every line that isn't blank."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("json"))


def pairs(line: Column) -> Column:
    """The map of a TAB-separated key=value line."""
    tokens = F.filter(F.split(line, "\t", -1), lambda t: F.instr(t, "=") > 0)
    entries = F.transform(
        F.slice(tokens, 1, MAX_PAIRS),
        lambda t: F.struct(
            F.substring_index(t, "=", 1).alias("key"),
            F.substring(t, F.instr(t, "=") + 1, F.length(t)).alias("value"),
        ),
    )
    # The first of equal keys: those that no earlier entry has.
    keys = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(first)


def from_map(m: Column) -> Resolver:
    return lambda name: F.try_element_at(m, F.lit(name))


def present(field: Resolver) -> Resolver:
    """field with empty values absent, as correlations over TSV lines have it; rules
    tell the two apart."""
    return lambda name: F.nullif(field(name), F.lit(""))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """ord, fields (a map) and clock of every line that isn't empty. The clock is the
    number that _ts starts with, 0 if it starts with none, and null where _ts is absent
    or empty (`with_line_clock` has the line's number there). Correlations over
    the fields take `present(from_map(...))`."""
    lines = spark.read.text(path).where(F.col("value") != "")
    rows = lines.select(F.monotonically_increasing_id().alias("ord"), pairs(F.col("value")).alias("fields"))
    stamp = present(from_map(F.col("fields")))("_ts")
    return rows.withColumn("clock", F.when(stamp.isNotNull(), F.coalesce(to_f64(stamp), F.lit(0.0))))


def with_line_clock(rows: DataFrame) -> DataFrame:
    """read_tsv's rows whose missing clocks are the line's number (from 1).

    Numbers come from counts of the rows of each partition (a row for each),
    so no task sees all lines."""
    part = F.shiftright("ord", 33)
    sizes = {r["p"]: r["count"] for r in rows.groupBy(part.alias("p")).count().collect()}
    if not sizes:
        return rows
    before = [0]
    for p in range(max(sizes)):
        before.append(before[-1] + sizes.get(p, 0))
    base = F.element_at(F.lit(before), part.cast("int") + 1)
    w = Window.partitionBy(part).orderBy("ord")
    line = (base + F.row_number().over(w)).cast("double")
    return rows.withColumn("clock", F.coalesce("clock", line))
