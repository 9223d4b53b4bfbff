"""Which rules each event fires, and why."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..plans import compile
from ..plans.evaluate import Evaluator
from ..plans.model import Kind, Op, Predicate, Rule, RuleSet, Verdict
from ..sources.events import Resolver

HIT = T.StructType(
    [
        T.StructField("rule_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("score", T.DecimalType(5, 2)),
        T.StructField("mitre", T.StringType()),
    ]
)
#: Rules from which on the Arrow strategy is the default.
ARROW_FROM = 400
#: What is counted of an event: rules that routing lets through, rules verified, whether the
#: prefilter ran, necessary literals it found, and bytes that it searched.
COUNTERS = ("rules_in_scope", "rules_verified", "prefilter_runs", "needles_confirmed", "haystack_bytes")
#: Characters of a value that an explanation shows.
SHOWN = 4096


def label(r: Rule) -> tuple:
    """What a hit says of its rule. A benign verdict suppresses nothing."""
    name = {int(v): v.name.lower() for v in Verdict}.get(int(r.verdict), str(int(r.verdict)))
    return (r.rule_id, r.name, name, r.severity, Decimal(r.score_x100).scaleb(-2), r.mitre)


def _hit(r: Rule) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(label(r), HIT, strict=True)])


def hits_column(rules: RuleSet, field: Resolver, routed: bool = True, allow: dict[int, Column] | None = None) -> Column:
    """array<hit>, in table order; a projection, so it works on streams as well."""
    routes = compile.routes(field)
    cells = []
    for i, r in enumerate(rules.rules):
        test = compile.rule(r, field)
        if routed:
            test = compile.in_scope(rules, i, routes) & test
        if allow and r.rule_id in allow:
            test = test & allow[r.rule_id]
        cells.append(F.when(test, _hit(r)))
    if not cells:
        return F.array().cast(T.ArrayType(HIT))
    return F.array_compact(F.array(*cells)).cast(T.ArrayType(HIT))


class Projected:
    """A resolver over columns that hold each field, and each folded field, once."""

    def __init__(self, field: Resolver, rules: RuleSet):
        self.field = field
        self.names = {f: f"__field_{i}" for i, f in enumerate(_needed(rules))}
        self.fold_names = {f: f"__fold_{i}" for i, f in enumerate(compile.folded_fields(rules))}
        self.folded = {f: F.col(n) for f, n in self.fold_names.items()}

    def __call__(self, name: str) -> Column:
        return F.col(self.names[name]) if name in self.names else self.field(name)

    def columns(self, field: Resolver) -> list[Column]:
        return [field(f).alias(n) for f, n in self.names.items()]

    def folds(self) -> list[Column]:
        return [text.fold(F.col(self.names[f])).alias(n) for f, n in self.fold_names.items()]


def _needed(rules: RuleSet) -> list[str]:
    return sorted({*rules.fields(), *compile.ROUTE_FIELDS})


def match(
    df: DataFrame,
    rules: RuleSet,
    field: Resolver,
    routed: bool = True,
    strategy: str = "auto",
    out: str = "hits",
    prefilter: str = "auto",
    counters: str | None = None,
) -> DataFrame:
    """df with the hits of each event.

    strategy: "native" compiles the rules into the plan; "arrow" evaluates them
    in batches; "auto" takes the second for large rule sets and where a prefilter is
    asked for. Both give the same hits.
    prefilter: whether the arrow strategy first looks for necessary literals, with one
    automaton a field, and for necessary numbers and networks: "off", "auto" (in large
    buckets) or "on" (always, without routing too). It changes no hit.
    counters: a column for the event's COUNTERS.
    """
    large = len(rules.rules) >= ARROW_FROM or prefilter == "on"
    if strategy == "native" or strategy == "auto" and not large:
        ready = Projected(field, rules)
        wide = df.select("*", *ready.columns(field)).select("*", *ready.folds())
        wide = wide.withColumn(out, hits_column(rules, ready, routed))
        if counters:
            scope = scope_size(rules, ready) if routed else F.lit(len(rules.rules)).cast("long")
            zero = F.lit(0).cast("long")
            told = {"rules_in_scope": scope, "rules_verified": scope}
            wide = wide.withColumn(counters, F.struct(*[told.get(n, zero).alias(n) for n in COUNTERS]))
        return wide.drop(*ready.names.values(), *ready.fold_names.values())
    return _match_arrow(df, rules, field, routed, out, prefilter, counters)


def scope_size(rules: RuleSet, field: Resolver) -> Column:
    """How many rules routing lets through."""
    routes = compile.routes(field)
    total = F.lit(0).cast("long")
    for i in range(len(rules.rules)):
        total = total + compile.in_scope(rules, i, routes).cast("long")
    return total


def _match_arrow(
    df: DataFrame, rules: RuleSet, field: Resolver, routed: bool, out: str, prefilter: str, counters: str | None
) -> DataFrame:
    needed = _needed(rules)
    shared = df.sparkSession.sparkContext.broadcast(rules)  # as large as its artifact
    labels = [dict(zip(HIT.names, label(r), strict=True)) for r in rules.rules]
    made = [T.StructField(out, T.ArrayType(HIT))]
    if counters:
        made.append(T.StructField(counters, T.StructType([T.StructField(n, T.LongType()) for n in COUNTERS])))
    schema = T.StructType([*df.schema.fields, *made])
    n = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        evaluator = Evaluator(shared.value, prefilter)
        for batch in batches:
            cells = {f: batch.column(n + i).to_pylist() for i, f in enumerate(needed)}
            hits, told = [], []
            for row in range(batch.num_rows):
                evaluator.stats.clear()
                found = evaluator.matches(lambda f, row=row: cells[f][row] if f in cells else None, routed)
                hits.append([labels[i] for i in sorted(found)])
                told.append({name: evaluator.stats[name] for name in COUNTERS})
            cols = [batch.column(i).cast(to.field(i).type) for i in range(n)]
            cols += [pa.array(v, to.field(n + i).type) for i, v in enumerate((hits, told)[: len(made)])]
            yield pa.RecordBatch.from_arrays(cols, schema=to)

    wide = df.select("*", *[field(f).alias(f"__field_{i}") for i, f in enumerate(needed)])
    return wide.mapInArrow(run, schema)


def needles(df: DataFrame, rules: RuleSet, field: Resolver, out: str = "needles") -> DataFrame:
    """df with the necessary literals that each event holds, in order: all of a field's
    are looked for at once."""
    names = sorted({f for w in rules.witnesses if w.literal is not None for f in ([w.field] if w.field else rules.fields())})
    shared = df.sparkSession.sparkContext.broadcast(rules)  # as large as its artifact

    @F.udf(T.ArrayType(T.StringType()), useArrow=True)
    def found(*texts):
        cells = dict(zip(names, texts, strict=True))
        return sorted({literal for _, literal in _evaluator(shared).present(cells.get)})

    return df.withColumn(out, found(*[field(f) for f in names]) if names else F.array().cast("array<string>"))


_READY: dict[int, Evaluator] = {}


def _evaluator(shared) -> Evaluator:
    """A worker makes a rule set's evaluator once."""
    key = id(shared.value)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Evaluator(shared.value, "on")
    return _READY[key]


def exploded(df: DataFrame, hits: str = "hits") -> DataFrame:
    """A row for each hit, its parts as columns."""
    return df.select("*", F.explode(hits).alias("__hit")).select("*", "__hit.*").drop("__hit", hits)


def totals(df: DataFrame, hits: str = "hits") -> DataFrame:
    """One row: events, events with hits, hits, and hits of each verdict."""
    count = lambda v: F.coalesce(F.sum(F.size(F.filter(hits, lambda h: h["verdict"] == v))), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.size(hits) > 0).alias("matched"),
        F.coalesce(F.sum(F.size(hits)), F.lit(0)).cast("long").alias("hits"),
        *[count(v.name.lower()).cast("long").alias(v.name.lower()) for v in Verdict],
    )


def as_json(df: DataFrame, hits: str = "hits") -> DataFrame:
    """One JSON text for each event: its place and hits."""
    keep = [c for c in df.columns if c != hits]
    return df.select(F.to_json(F.struct(*keep, hits)).alias("value"))


def stats(df: DataFrame, counters: str) -> DataFrame:
    """One row: events, and the sums of the counters that `match` gave each."""
    return df.agg(
        F.count(F.lit(1)).alias("events"),
        *[F.coalesce(F.sum(F.col(counters)[n]), F.lit(0)).alias(n) for n in COUNTERS],
    )


def with_stats(df: DataFrame, counters: str, name: str = "match"):
    """df observed under name as `stats` has it, and the Observation; works on streams."""
    from pyspark.sql import Observation

    seen = Observation(name)
    sums = [F.sum(F.col(counters)[n]).alias(n) for n in COUNTERS]
    return df.observe(seen, F.count(F.lit(1)).alias("events"), *sums), seen


# --- explaining ------------------------------------------------------------------


def operand_text(p: Predicate) -> str | None:
    if p.op == Op.EXISTS:
        return None
    return str(p.value) if p.value is not None else None


def _explained_predicate(p: Predicate, group: int, field: Resolver) -> Column:
    v = field(p.field)
    op = p.op.name.lower() if isinstance(p.op, Op) else str(p.op)
    return F.struct(
        F.lit(p.field).alias("field"),
        F.lit(group).alias("group"),
        F.lit(op).alias("op"),
        F.lit(operand_text(p)).cast("string").alias("operand"),
        F.lit(p.cased).alias("cased"),
        F.lit(p.negate).alias("negate"),
        F.lit(p.fieldref).alias("fieldref"),
        v.isNotNull().alias("present"),
        F.substring(v, 1, SHOWN).alias("value"),
        compile.predicate(p, field).alias("matched"),
    )


def explain_column(rules: RuleSet, rule_id: int, field: Resolver) -> Column:
    """How one rule comes to its answer, from the same columns that match uses.

    Raises KeyError for an unknown rule; of equal identifiers the first counts."""
    position = rules.position(rule_id)
    if position is None:
        raise KeyError(rule_id)
    r = rules.rules[position]
    matched = compile.rule(r, field)
    routed = compile.in_scope(rules, position, compile.routes(field)) & matched
    kinds = {Kind.SEL: "sel", Kind.AND: "and", Kind.OR: "or", Kind.NOT: "not"}
    tokens = [
        F.struct(F.lit(kinds[t.kind]).alias("k"), F.lit(t.index if t.kind == Kind.SEL else None).cast("int").alias("sel"))
        for t in r.condition
    ]
    selections = []
    for i, s in enumerate(r.selections):
        predicates = [_explained_predicate(p, g, field) for g, ps in enumerate(s.groups) for p in ps]
        selections.append(
            F.struct(
                F.lit(i).alias("index"),
                compile.selection(s, field).alias("matched"),
                (F.array(*predicates) if predicates else F.array().cast(_PREDICATES)).alias("predicates"),
            )
        )
    return F.struct(
        F.lit(r.rule_id).cast("long").alias("rule_id"),
        F.lit(r.name).cast("string").alias("title"),
        routed.alias("matched"),
        matched.alias("matched_unrouted"),
        (F.array(*tokens) if tokens else F.array().cast("array<struct<k:string,sel:int>>")).alias("condition"),
        (F.array(*selections) if selections else F.array().cast(_SELECTIONS)).alias("selections"),
    )


_PREDICATES = (
    "array<struct<field:string,group:int,op:string,operand:string,cased:boolean,negate:boolean,fieldref:boolean,"
    "present:boolean,value:string,matched:boolean>>"
)
_SELECTIONS = f"array<struct<index:int,matched:boolean,predicates:{_PREDICATES}>>"


def explain(df: DataFrame, rules: RuleSet, rule_id: int, field: Resolver, out: str = "explanation") -> DataFrame:
    position = rules.position(rule_id)
    if position is None:
        raise KeyError(rule_id)
    ready = Projected(field, RuleSet((rules.rules[position],)))
    wide = df.select("*", *ready.columns(field)).select("*", *ready.folds())
    told = wide.withColumn(out, explain_column(rules, rule_id, ready))
    return told.drop(*ready.names.values(), *ready.fold_names.values())

