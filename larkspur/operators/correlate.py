"""Correlations over the hits of a batch.

Input rows are events: `ord` (arrival order), `ts` (epoch seconds, double),
`rids` (rules that matched, in verification order) and whatever fields the
correlations read. All correlations share one pass over the events and one exchange
of what they watch. The step function of `streaming.kernel` is applied to sorted
rows that stream through each partition, one state at a time; a state is bounded by
the caps, whatever the group's size. Two ways to the same fires:

* windows: rows of a group are dealt to slices of one time span each, a row also to
  the slice after its own, where it only fills the state. So a task holds two time
  spans of a group and not its whole history. Right if a group's times don't fall
  in arrival order. Suppression after a fire is a fold over the few rows that hold
  the condition.
* fold: a group's rows in arrival order. Right for any order, and for the types
  whose state goes back farther than a time span.

`auto` takes slices for the types that have them; slices tell on the way whether a
group is out of order, and such groups alone are folded again.
"""

from __future__ import annotations

import sys
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ownership
from ..functions.evtime import RANGE_ROWS, dealt
from ..functions.text import to_f64
from ..plans.model import MAX_SEEN_RULES, WEIGHTS, Correlation, admitted, problem
from ..sources.events import Resolver
from ..streaming.kernel import Caps, Engine, Group

#: Counters of the step function.
COUNTED = (
    "distinct_evicted", "events_overwritten", "fires_suppressed", "seen_truncated", "hits_truncated", "watermark_late",
    "hotkey_fallback",
)
#: Of these a batch's answer is exact without the ring of events that an instance has.
UNCUT = ("event_count",)
WINDOWED = ("event_count", "value_count", "value_sum", "value_avg", "value_percentile", "value_median", "temporal", "beaconing")


def _watching(c: Correlation, field: Resolver, apply: Column | None) -> tuple[Column, Column, Column]:
    """Whether the correlation looks at an event; its group (array<string>) and value."""
    base = F.lit([int(r) for r in dict.fromkeys(c.base_rule_ids)]).cast("array<long>")
    rids = F.col("rids").cast("array<long>")
    test = F.arrays_overlap(rids, base)
    test = test if apply is None else test & apply
    grp = F.array(*[field(f) for f in c.group_by]) if c.group_by else F.array().cast("array<string>")
    if c.alias_group_by:
        first = F.get(F.filter(rids, lambda r: F.array_contains(base, r)), F.lit(0))
        for r in reversed(dict.fromkeys(c.base_rule_ids)):
            grp = F.when(first == r, F.array(*[field(f) for f in c.group_fields(r)])).otherwise(grp)
    return test, grp, field(c.field) if c.uses_field else F.lit(None).cast("string")


def watched(
    df: DataFrame, c: Correlation, field: Resolver, apply: Column | None = None, complete: bool = True
) -> DataFrame:
    """ord, ts, rids, grp (array<string>) and value of the events that the
    correlation looks at: a base rule matched, no group field is absent (unless
    complete is false) and apply, a test on the event, holds."""
    test, grp, value = _watching(c, field, apply)
    rids = F.col("rids").cast("array<long>")
    rows = df.where(test).select("ord", F.col("ts").cast("double").alias("ts"), rids.alias("rids"), grp.alias("grp"), value.alias("value"))
    return rows.where(_complete()) if complete else rows


def watched_by_any(
    df: DataFrame, rules: list[Correlation], field: Resolver, apply: dict[str, Column] | None = None, complete: bool = True
) -> DataFrame:
    """c (the position of a correlation), ord, ts, rids, grp and value: a row for each
    event and correlation that looks at it, in one pass over the events."""
    names = sorted({f for c in rules for r in c.base_rule_ids for f in c.group_fields(r)} | {c.field for c in rules if c.uses_field})
    ready = {f: f"__field_{i}" for i, f in enumerate(names)}
    wide = df.select("*", *[field(f).alias(n) for f, n in ready.items()])
    cells = []
    for i, c in enumerate(rules):
        test, grp, value = _watching(c, lambda f: F.col(ready[f]), (apply or {}).get(c.id))
        cells.append(F.when(test, F.struct(F.lit(i).alias("c"), grp.alias("grp"), value.alias("value"))))
    rids = F.col("rids").cast("array<long>").alias("rids")
    rows = wide.select("ord", F.col("ts").cast("double").alias("ts"), rids, F.explode(F.array_compact(F.array(*cells))).alias("w"))
    rows = rows.select("w.c", "ord", "ts", "rids", "w.grp", "w.value")
    return rows.where(_complete()) if complete else rows


def _complete() -> Column:
    return ~F.exists("grp", lambda v: v.isNull())


def _sliceable(c: Correlation) -> bool:
    """Whether two time spans before an event are all that its answer rests on."""
    return c.type in WINDOWED and len(c.base_rule_ids) <= MAX_SEEN_RULES


def _together(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of equal keys together and in order; they stream through their partition."""
    rows = rows.withColumn("__key", F.xxhash64(*keys)).repartition("__key")
    return rows.sortWithinPartitions("__key", *keys, *order).drop("__key")


def _span(rules: list[Correlation]) -> Column:
    return F.element_at(F.lit([float(c.timespan_s) for c in rules]), F.col("c") + 1)


def _rows_of(batch: pa.RecordBatch, *names: str):
    return zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, schema, strict=True)], schema=schema)


def _place(ord_value):
    """Something that compares as the column does."""
    return tuple(ord_value.values()) if isinstance(ord_value, dict) else ord_value


def _caps_of(rules: list[Correlation], caps: Caps | None) -> list[Caps]:
    whole = replace(Caps(), max_events=sys.maxsize)
    return [caps or (whole if c.type in UNCUT else Caps()) for c in rules]


def sliced(rows: DataFrame, rules: list[Correlation], caps: Caps | None = None) -> DataFrame:
    """c, grp, slice, ord, ts, observed of the rows on which a condition holds, and for
    each slice a row without ts: ord is its first row's, last its last one's, and
    observed is 1 if its rows, or those of the slice before, are out of order."""
    order = rows.schema["ord"].dataType
    schema = T.StructType.fromDDL("c int, grp array<string>, slice long")
    schema = schema.add("ord", order).add("last", order).add("ts", T.DoubleType()).add("observed", T.LongType())
    limits = _caps_of(rules, caps)
    own = F.floor(F.col("ts") / _span(rules))
    two = F.array(F.struct(own.alias("n"), F.lit(False).alias("guest")), F.struct((own + 1).alias("n"), F.lit(True).alias("guest")))
    dealt = rows.withColumn("__at", F.explode(two)).select("*", F.col("__at.n").alias("slice"), F.col("__at.guest").alias("guest")).drop("__at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, stats = to_arrow_schema(schema), Counter()
        key, state, first, last, latest, wrong = None, Group(), None, None, None, 0
        for batch in batches:
            made = []
            for c, grp, n, guest, ord_value, ts, rids, value in _rows_of(batch, "c", "grp", "slice", "guest", "ord", "ts", "rids", "value"):
                if (c, grp, n) != key:
                    if first is not None:
                        made.append((*key, first, last, None, wrong))
                    key, state, first, last, latest, wrong = (c, grp, n), Group(), None, None, None, 0
                place = _place(ord_value)
                if latest is not None and place < latest:
                    wrong = 1
                else:
                    latest = place
                observed = state.step(rules[c], ts, rids, value, limits[c], stats)
                if not guest:
                    first = ord_value if first is None or place < _place(first) else first
                    last = ord_value if last is None or place > _place(last) else last
                    if observed is not None:
                        made.append((c, grp, n, ord_value, None, ts, observed))
            yield _batch(made, out)
        if first is not None:
            yield _batch([(*key, first, last, None, wrong)], out)

    return _together(dealt, ["c", "grp", "slice"], "ts", "ord").mapInArrow(run, schema)


def out_of_order(found: DataFrame) -> DataFrame:
    """c and grp of what `sliced` has found to have a row that is earlier than one that
    arrived before it: within neighbouring slices, or a slice's first row arrived
    before the last one of an earlier slice. A row for each slice is looked at."""
    before = Window.partitionBy("c", "grp").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.where("ts is null").withColumn("before", F.max("last").over(before))
    return ends.where((F.col("observed") == 1) | (F.col("before") > F.col("ord"))).select("c", "grp").distinct()


def suppress(found: DataFrame, rules: list[Correlation]) -> DataFrame:
    """The fires among rows that hold a condition: after one at t, none before t + span."""
    spans = [float(c.timespan_s) for c in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until = None, 0.0
        for batch in batches:
            keep = []
            for c, grp, ts in _rows_of(batch, "c", "grp", "ts"):
                if (c, grp) != key:
                    key, until = (c, grp), 0.0
                keep.append(ts >= until)
                if keep[-1]:
                    until = ts + spans[c]
            yield batch.filter(pa.array(keep, pa.bool_()))

    found = found.select("c", "ord", "ts", "grp", "observed")
    fired = _together(found, ["c", "grp"], "ts", "ord").mapInArrow(run, found.schema)
    return fired.withColumn("remote", F.lit(False))


def _fired(order: T.DataType) -> T.StructType:
    schema = T.StructType().add("c", T.IntegerType()).add("ord", order)
    return T.StructType([*schema, *T.StructType.fromDDL("ts double, grp array<string>, observed long, remote boolean")])


def fold(rows: DataFrame, rules: list[Correlation], caps: Caps | None = None, spells: bool = False) -> DataFrame:
    """c, ord, ts, grp, observed, remote of the fires, by the step function in arrival
    order. Rows with a kind are contributions. spells: each spell of a group (of `_spells`)
    begins anew."""
    schema = _fired(rows.schema["ord"].dataType)
    with_kind, limits = "kind" in rows.columns, _caps_of(rules, caps)
    keys = ["c", "grp", "spell"] if spells else ["c", "grp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, stats = to_arrow_schema(schema), Counter()
        key, state = None, Group()
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if [row[k] for k in keys] != key:
                    key, state = [row[k] for k in keys], Group()
                c = rules[row["c"]]
                if with_kind and row["kind"] is not None:
                    observed = state.contribution(c, row, limits[row["c"]], stats)
                else:
                    observed = state.event(c, row["ts"], row["rids"], row["value"], limits[row["c"]], stats)
                if observed is not None:
                    made.append((row["c"], row["ord"], row["ts"], row["grp"], observed, state.remote))
            yield _batch(made, out)

    return _together(rows, keys, "ord").mapInArrow(run, schema)


def counters(rows: DataFrame, rules: list[Correlation], caps: Caps = Caps()) -> DataFrame:
    """c, name, n: what the fold counts on its way (losses to caps, suppressed fires,
    values that are no numbers and so on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, all_stats = None, Group(), {}
        for batch in batches:
            for c, grp, ts, rids, value in _rows_of(batch, "c", "grp", "ts", "rids", "value"):
                if (c, grp) != key:
                    key, state = (c, grp), Group()
                state.event(rules[c], ts, rids, value, caps, all_stats.setdefault(c, Counter()))
        found = [(c, name, n) for c, stats in all_stats.items() for name, n in stats.items()]
        yield _batch(found, pa.schema([("c", pa.int32()), ("name", pa.string()), ("n", pa.int64())]))

    found = _together(rows, ["c", "grp"], "ord").mapInArrow(run, "c int, name string, n long")
    return found.groupBy("c", "name").agg(F.sum("n").alias("n"))


def instances(
    df: DataFrame, rules: list[Correlation], field: Resolver, caps: Caps = Caps(), of: int = 1, live: bool = False
) -> DataFrame:
    """Fires of `of` separate instances, each with its own limit on groups and its own
    periodic sweep; a group belongs to the instance that `functions.ownership` names. live: the
    groups that are left instead (c, id, groups).

    These bounds go over all groups of an instance. What is left follows from the groups' last
    events, and what a limit without sweeps makes groups forget from ranges of the events. Where
    sweeps and the limit meet out of time order, or fires are asked for with sweeps, an
    instance's events are one sequence in one task; more instances are how this grows."""
    good, _ = admitted(rules)
    rows = watched_by_any(df, good, field)
    ticks = df.where(F.size("rids") > 0).select("ord", F.col("ts").cast("double").alias("ts"))
    times = ticks.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    swept = times["low"] is not None and times["high"] - times["low"] >= caps.sweep_s
    if live and (not swept or caps.sweep_s <= 0):
        left = _kept(_last_events(rows, ticks, good, of, swept))
        full = F.col("n") > caps.max_groups
        if not swept or left.where(full).isEmpty() or _in_time_order(ticks):
            counts = left.groupBy("c").agg(F.sum(F.least("kept", F.lit(caps.max_groups))).cast("long").alias("groups"))
            ids = df.sparkSession.createDataFrame([(i, c.id) for i, c in enumerate(good)], "c int, id string")
            return F.broadcast(ids).join(counts, "c", "left").select("c", "id", F.coalesce("groups", F.lit(0)).alias("groups"))
    if not live and not swept and isinstance(rows.schema["ord"].dataType, T.NumericType):
        return described(fold(_spells(rows, good, caps.max_groups, of), good, caps, spells=True), good)
    return _one_by_one(rows, ticks, good, caps, of, live)


def _spells(rows: DataFrame, rules: list[Correlation], limit: int, of: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with `spell`, which tells the times apart at which the limit on groups has made
    an instance begin a group anew.

    A group is forgotten when as many others as the limit have had events since its last one.
    Within a range of the order that is known but for each group's first event there; those
    are decided by what ranges leave to the next: a row for each range and group, in one task
    for an instance and correlation."""
    if limit < 1:
        raise ValueError("no group may be held")
    part, _ = dealt(rows, "ord", range_rows)
    rows = rows.withColumn("instance", _owner(rules, of)).withColumn("part", part.cast("int"))
    keys = ["instance", "c", "part"]

    def again(narrow: DataFrame) -> DataFrame:
        """narrow with `again`: how often the group has begun anew in its range."""
        schema = T.StructType([*narrow.schema, *T.StructType.fromDDL("again long")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            out, key, held, times = to_arrow_schema(schema), None, OrderedDict(), {}
            for batch in batches:
                made = []
                for at, c, part, grp in _rows_of(batch, *keys, "grp"):
                    if (at, c, part) != key:
                        key, held, times = (at, c, part), OrderedDict(), {}
                    g = tuple(grp)
                    if g in held:
                        held.move_to_end(g)
                    else:
                        times[g] = times.get(g, -1) + 1
                        if len(held) >= limit:
                            held.popitem(last=False)
                        held[g] = None
                    made.append(times[g])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], schema=out)

        return _together(narrow, keys, "ord").mapInArrow(run, schema)

    ends = again(rows.select(*keys, "grp", "ord")).groupBy(*keys, "grp").agg(
        F.min("ord").alias("first"), F.max("ord").alias("last"), F.max("again").alias("again")
    )
    begun = T.StructType([*ends.select(*keys, "grp").schema, *T.StructType.fromDDL("spell string")])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        key, held, waiting = None, OrderedDict(), []

        def end() -> None:
            """The groups of a range in the order of their last events."""
            for _, g, spell in sorted(waiting, key=lambda w: w[0]):
                hold(g, spell)
            waiting.clear()

        def hold(g: tuple, spell: str) -> None:
            if g not in held and len(held) >= limit:
                held.popitem(last=False)
            held[g] = spell
            held.move_to_end(g)

        for batch in batches:
            made = []
            for at, c, part, grp, last, times in _rows_of(batch, *keys, "grp", "last", "again"):
                if (at, c, part) != key:
                    end()
                    if key is None or (at, c) != key[:2]:
                        held.clear()
                    key = (at, c, part)
                g = tuple(grp)
                spell = held.get(g, f"{part}:0")
                hold(g, spell)
                made.append((at, c, part, grp, spell))
                waiting.append((last, g, f"{part}:{times}" if times else spell))
            yield _batch(made, to_arrow_schema(begun))

    first = _together(ends, ["instance", "c"], "part", "first").mapInArrow(carry, begun)
    marked = again(rows).join(first, [*keys, "grp"])
    spell = F.when(F.col("again") == 0, F.col("spell")).otherwise(F.concat_ws(":", "part", "again"))
    return marked.withColumn("spell", spell)


def _owner(rules: list[Correlation], of: int) -> Column:
    """The instance that a row's group belongs to."""
    ids = F.element_at(F.lit([c.id for c in rules]), F.col("c") + 1)
    own = F.lit(0).cast("long")
    for n in sorted({len(c.group_by) for c in rules}):
        own = F.when(F.size("grp") == n, ownership.owner_index(of, ids, *[F.get("grp", F.lit(i)) for i in range(n)])).otherwise(own)
    return own.cast("long")


def _last_events(rows: DataFrame, ticks: DataFrame, rules: list[Correlation], of: int, swept: bool) -> DataFrame:
    """instance, c, n (groups) and kept (groups that sweeps leave), without the limit on groups.

    swept: each event starts a sweep that isn't earlier than the last one. The last of these
    is the latest in time, too, so it alone decides on groups that have no event after it."""
    groups = rows.groupBy("c", "grp").agg(F.max(F.struct("ord", "ts")).alias("last"))
    kept = F.lit(True)
    if swept:
        final = ticks.agg(F.max(F.struct("ts", "ord")).alias("final"))
        groups = groups.crossJoin(F.broadcast(final))
        kept = (F.col("final.ord") <= F.col("last.ord")) | (F.col("last.ts") >= F.col("final.ts") - _span(rules))
    groups = groups.select("c", kept.alias("kept"), _owner(rules, of).alias("instance"))
    return groups.groupBy("instance", "c").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept"))


def _in_time_order(ticks: DataFrame) -> bool:
    """Whether no event is earlier than one that arrived before it."""
    order = ticks.schema["ord"].dataType
    schema = T.StructType().add("ord", order).add("low", T.DoubleType()).add("high", T.DoubleType()).add("wrong", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        first, low, high, wrong = None, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column("ts").to_numpy(zero_copy_only=False)
            if low is None:
                first, low = batch.column("ord")[0].as_py(), float(times[0])
            wrong = wrong or bool((times[1:] < times[:-1]).any()) or (high is not None and times[0] < high)
            high = float(times[-1])
        if low is not None:
            yield _batch([(first, low, high, wrong)], to_arrow_schema(schema))

    ends = ticks.repartitionByRange("ord").sortWithinPartitions("ord").mapInArrow(run, schema)
    before = F.lag("high").over(Window.orderBy("ord"))
    return ends.withColumn("before", before).where(F.col("wrong") | (F.col("before") > F.col("low"))).isEmpty()


def _one_by_one(
    rows: DataFrame, ticks: DataFrame, rules: list[Correlation], caps: Caps, of: int, live: bool
) -> DataFrame:
    """`instances`, each as a sequence of events in one task."""
    rows = rows.withColumn("instance", _owner(rules, of))
    # Every event that matched a rule may start a sweep, in each instance.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("rids", "array<long>"), ("grp", "array<string>"), ("value", "string"))]
    rows = rows.unionByName(ticks.select(F.lit(-1).alias("c"), "ord", "ts", *nothing, every.alias("instance")))
    schema = T.StructType.fromDDL("c int, id string, groups long") if live else _fired(rows.schema["ord"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, current, engine = to_arrow_schema(schema), None, Engine(rules, caps)
        left: Counter = Counter()
        for batch in batches:
            made = []
            for at, c, ord_value, ts, rids, grp, value in _rows_of(batch, "instance", "c", "ord", "ts", "rids", "grp", "value"):
                if at != current:
                    left.update({i: engine.n_groups(i) for i in range(len(rules))})
                    current, engine = at, Engine(rules, caps)
                if c < 0:
                    engine.sweep(ts)
                    continue
                observed, remote = engine.one(c, tuple(grp), ts, rids, value)
                if observed is not None and not live:
                    made.append((c, ord_value, ts, grp, observed, remote))
            if not live:
                yield _batch(made, out)
        if live:
            left.update({i: engine.n_groups(i) for i in range(len(rules))})
            yield _batch([(i, rules[i].id, n) for i, n in left.items()], out)

    found = _together(rows, ["instance"], "ord", "c").mapInArrow(run, schema)
    if live:
        return found.groupBy("c", "id").agg(F.sum("groups").alias("groups"))
    return described(found, rules)


def described(found: DataFrame, rules: list[Correlation]) -> DataFrame:
    """The full record of each fire of several correlations; a row for each of these is
    broadcast."""
    kinds = "c int, corr_id string, title string, type string, technique string, level string, tier string, weight double, group_by array<string>, threshold long, value_field string, base_rule_ids array<long>"
    table = found.sparkSession.createDataFrame(
        [
            (
                i, c.id, c.title, c.type, c.mitre, c.level or "medium", c.tier, WEIGHTS[c.tier], list(c.group_by), c.count,
                c.field if c.uses_field else None, list(c.base_rule_ids),
            )
            for i, c in enumerate(rules)
        ],
        kinds,
    )
    return found.join(F.broadcast(table), "c").select(
        "corr_id", "title", "type", "technique", "level", "tier", "weight", "group_by", F.col("grp").alias("group"),
        "observed", "threshold", "value_field", "base_rule_ids", "remote", "ts", "ord",
    )


def correlate(
    df: DataFrame,
    rules: list[Correlation],
    field: Resolver,
    caps: Caps | None = None,
    how: str = "auto",
    apply: dict[str, Column] | None = None,
) -> DataFrame:
    """Fires of all admitted correlations.

    how: "windows", "fold", or "auto": slices for the types that have them, and the fold
    for other types and for groups that turn out to be out of order.
    apply: by correlation, which events it is applied to here.
    caps: the limits of an instance; without them its defaults hold, but event counts are
    whole (a number for each event of a time span is in memory).
    """
    good, _ = admitted(rules)
    if not good:
        raise ValueError("no valid correlation: " + ", ".join(str(problem(c)) for c in rules))
    by_slice = [i for i, c in enumerate(good) if how != "fold" and _sliceable(c)]
    if how == "windows" and len(by_slice) < len(good):
        raise ValueError("no window form: " + ", ".join(c.type for c in good if not _sliceable(c)))
    rows, parts = watched_by_any(df, good, field, apply), []
    if len(by_slice) < len(good):
        parts.append(fold(rows.where(~F.col("c").isin(by_slice)), good, caps))
    if by_slice:
        mine = rows.where(F.col("c").isin(by_slice))
        found = sliced(mine, good, caps)
        if how == "auto":
            found = _kept(found)
            wrong = _kept(out_of_order(found))
            if not wrong.isEmpty():
                parts.append(fold(mine.join(wrong, ["c", "grp"], "left_semi"), good, caps))
                found = found.join(wrong, ["c", "grp"], "left_anti")
        parts.append(suppress(found.where("ts is not null"), good))
    return described(reduce(DataFrame.unionByName, parts), good)


def _kept(df: DataFrame) -> DataFrame:
    """df computed once: in the checkpoint folder where one is set, else in the executors'
    memory and disks (and computed again for a lost one)."""
    set_up = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    return df.checkpoint() if set_up else df.persist()


def stats(df: DataFrame, rules: list[Correlation], field: Resolver, caps: Caps = Caps()) -> DataFrame:
    """By correlation: events it watches, groups, and the counters of an instance. What
    depends on buffers that don't exist here is 0."""
    good, rejected = admitted(rules)
    rows = watched_by_any(df, good, field, complete=False)
    numbers = [i for i, c in enumerate(good) if c.uses_field and c.type != "value_count"]
    no_number = _complete() & F.col("c").isin(numbers) & to_f64(F.col("value")).isNull()
    seen = rows.groupBy("c").agg(
        F.count(F.lit(1)).alias("watched"),
        F.count_if(~_complete()).alias("event_skipped_missing_field"),
        F.count_distinct(F.when(_complete(), F.col("grp"))).alias("groups"),
        F.count_if(no_number).alias("values_nonnumeric"),
    )
    counted = counters(rows.where(_complete()), good, caps).groupBy("c").agg(
        *[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in COUNTED]
    )
    ids = df.sparkSession.createDataFrame([(i, c.id) for i, c in enumerate(good)], "c int, corr_id string")
    every = F.broadcast(ids).join(seen, "c", "left").join(counted, "c", "left")
    names = ("watched", "event_skipped_missing_field", "groups", "values_nonnumeric", *COUNTED)
    return every.select(
        "corr_id",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
        *[F.lit(rejected.get(n, 0)).cast("long").alias(n) for n in ("rules_rejected", "cond_over_arity")],
        *[F.lit(0).cast("long").alias(n) for n in ("groups_evicted", "fires_truncated", "group_evidence_dropped", "oom_dropped")],
    )
