"""Correlations: known cases, windows against the step function, streams, merging."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.functions.ownership import python_owner_index
from larkspur.operators import correlate, merge
from larkspur.plans.model import Correlation, Kind, Token, problem
from larkspur.sources import contrib, corrfile
from larkspur.sources.events import from_columns
from larkspur.streaming.kernel import EVENT_TIME, Caps, Engine

SEL = [Token(Kind.SEL, i) for i in range(3)]
AND, NOT = Token(Kind.AND), Token(Kind.NOT)
RULES = [
    Correlation("ec", "event_count", (1,), 60, group_by=("g",), count=4),
    Correlation("vc", "value_count", (1, 2), 60, group_by=("g",), count=3, field="v"),
    Correlation("vs", "value_sum", (1, 2), 60, group_by=("g",), count=12, field="v"),
    Correlation("va", "value_avg", (1, 2), 60, group_by=("g",), count=3, field="v", op="gt"),
    Correlation("vp", "value_percentile", (1, 2), 60, group_by=("g",), count=10, field="v", percentile=80),
    Correlation("vm", "value_median", (1, 2), 60, group_by=("g",), count=2, field="v", op="lte"),
    Correlation("tp", "temporal", (1, 2, 3), 30, group_by=("g",)),
    Correlation("tr", "temporal", (1, 2, 3), 30, group_by=("g",), condition=(SEL[0], SEL[1], AND, SEL[2], NOT, AND)),
    Correlation("to", "temporal_ordered", (1, 2, 3), 40, group_by=("g",), ordered_rule_ids=(3, 1, 2)),
    Correlation("tc", "temporal_ordered", (1, 2, 3), 40, group_by=("g",), ordered_rule_ids=(1, 2), condition=(SEL[2], NOT)),
    Correlation("br", "beaconing", (1,), 300, group_by=("g",), count=4, cv_permille=900),
    Correlation("bb", "beaconing", (1,), 600, group_by=("g",), count=5, cv_permille=800, n_buckets=20),
    Correlation("ng", "event_count", (2,), 50, count=6, op="eq"),
    Correlation("al", "event_count", (1, 2), 60, group_by=("g",), alias_group_by=(("g",), ("h",)), count=3),
]


def stream(seed, n=300, disorder=0.0):
    rng, t, rows = random.Random(seed), 1000.0, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 3, 7, 20, 45]) + rng.choice([0, 0.25])
        back = rng.choice([0, 5, 40]) if rng.random() < disorder else 0
        rids = [r for r in (3, 1, 2) if rng.random() < 0.6]
        rows.append((i, t - back, rids, rng.choice(["a", "b", None, ""]), rng.choice("xy"), rng.choice(["1", "2.5", "x", None, "10/t", "-3"])))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "ord long, ts double, rids array<long>, g string, h string, v string")
    return df, from_columns(df)


def expected(rows, rules, caps=Caps(sweep_s=1e18)):
    engine, out = Engine(rules, caps), set()
    for o, ts, rids, g, h, v in rows:
        for x in engine.event(rids, {"g": g, "h": h, "v": v}.get, ts):
            out.add((x["corr_id"], o, tuple(x["group"]), x["observed"]))
    return out


def found(df):
    return {(r["corr_id"], r["ord"], tuple(r["group"]), r["observed"]) for r in df.collect()}


@pytest.mark.parametrize("how", ["auto", "fold"])
def test_batch_agrees_with_one_instance(spark, how):
    rows = stream(1)
    df, field = frame(spark, rows)
    want = expected(rows, RULES)
    assert {x[0] for x in want} >= {"ec", "vc", "vs", "tp", "to", "br", "ng", "al"}
    for part in (RULES[:7], RULES[7:]):
        ids = {c.id for c in part}
        assert found(correlate.correlate(df, part, field, how=how)) == {x for x in want if x[0] in ids}


def test_out_of_order_goes_to_the_fold(spark):
    rows = stream(2, disorder=0.3)
    df, field = frame(spark, rows)
    rules = [RULES[0], RULES[3], RULES[8], RULES[9]]
    seen = correlate.sliced(correlate.watched_by_any(df, rules[:2], field), rules[:2], Caps())
    assert not correlate.out_of_order(seen).isEmpty()
    assert found(correlate.correlate(df, rules, field)) == expected(rows, rules)
    caps = Caps(event_time=True, watermark_s=2.0, sweep_s=1e18)
    assert found(correlate.correlate(df, rules[2:], field, caps, "fold")) == expected(rows, rules[2:], caps)


@pytest.mark.parametrize("how", ["auto", "windows", "fold"])
def test_caps(spark, how):
    rows = stream(3)
    df, field = frame(spark, rows)
    caps = Caps(max_distinct=2, max_events=3, sweep_s=1e18)
    rules = [Correlation("vc", "value_count", (1, 2), 600, count=2, field="v", op="eq"), Correlation("ec", "event_count", (1,), 600, count=3, op="eq")]
    rules += [Correlation("vm", "value_median", (1, 2), 60, group_by=("g",), count=2, field="v", op="lte"), Correlation("br", "beaconing", (1,), 300, group_by=("g",), count=3, cv_permille=900)]
    assert found(correlate.correlate(df, rules, field, caps, how)) == expected(rows, rules, caps)


def test_event_counts_are_whole_without_limits(spark):
    """More events in a time span than an instance's ring has, in both strategies."""
    df = spark.range(5_000).select(F.col("id").alias("ord"), (F.col("id") / 100).alias("ts"), F.array(F.lit(1).cast("long")).alias("rids"), F.lit("a").alias("g"))
    c = [Correlation("e", "event_count", (1,), 100, group_by=("g",), count=4_500)]
    for how in ("auto", "fold"):
        assert found(correlate.correlate(df, c, from_columns(df), how=how)) == {("e", 4_499, ("a",), 4_500)}
        assert not found(correlate.correlate(df, c, from_columns(df), Caps(), how))


def test_distant_disorder_is_seen(spark):
    """An event far earlier than the one before it, with empty slices between."""
    rows = [(0, 1000.0, [1], "a", "x", "1"), (1, 5000.0, [1], "a", "x", "1"), (2, 3000.0, [1], "a", "x", "1"), (3, 9000.0, [1], "b", "x", "1")]
    df, field = frame(spark, rows)
    c = [Correlation("e", "event_count", (1,), 100, group_by=("g",), count=2)]
    want = expected(rows, c)
    assert want and found(correlate.correlate(df, c, field)) == want


def test_one_pass_and_one_exchange_for_many_correlations(spark):
    rows = stream(8, 50)
    df, field = frame(spark, rows)
    rules = [c for c in RULES if c.type in correlate.WINDOWED]
    plan = correlate.sliced(correlate.watched_by_any(df, rules, field), rules, Caps())._jdf.queryExecution().executedPlan().toString()
    assert len(rules) >= 10 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan ExistingRDD") == 1


def test_one_large_group_ends(spark):
    """20,000 events of a group in one window: time and memory follow the caps."""
    df = spark.range(20_000).select(F.col("id").alias("ord"), (F.col("id") / 100).alias("ts"), F.array(F.lit(1).cast("long")).alias("rids"),
                                    F.lit("a").alias("g"), F.lit("h").alias("h"), (F.col("id") % 7).cast("string").alias("v"))
    caps = Caps(max_events=200, sweep_s=1e18)
    rules = [Correlation(t, t, (1,), 100_000, group_by=("g",), count=10**6, field="v", percentile=50) for t in ("value_sum", "value_percentile", "value_count")]
    assert correlate.correlate(df, rules, from_columns(df), caps).count() == 0


def test_instances_have_their_own_bounds(spark):
    rows = stream(9)
    df, field = frame(spark, rows)
    rules = [Correlation("e", "event_count", (1, 2), 600, group_by=("g", "h"), count=3), RULES[1]]
    caps = Caps(max_groups=2, sweep_s=50)
    assert found(correlate.instances(df, rules, field, caps)) == expected(rows, rules, caps)
    engine = Engine(rules, caps)
    for o, ts, rids, g, h, v in rows:
        engine.event(rids, {"g": g, "h": h, "v": v}.get, ts)
    assert engine.stats["groups_evicted"] > 0
    live = {r["id"]: r["groups"] for r in correlate.instances(df, rules, field, caps, live=True).collect()}
    assert live == {c.id: engine.n_groups(i) for i, c in enumerate(rules)}
    whole = Caps(sweep_s=1e18)
    assert found(correlate.instances(df, rules, field, whole, of=3)) == expected(rows, rules, whole)


def left_by_engines(rows, rules, caps, of):
    """Groups that are left by correlation, each event's sweep reaching every instance."""
    engines, out = [Engine(rules, caps) for _ in range(of)], Counter({c.id: 0 for c in rules})
    for o, ts, rids, g, h, v in rows:
        for i, engine in enumerate(engines):
            if rids:
                engine.sweep(ts)
            engine.event(rids, {"g": g, "h": h, "v": v}.get, ts, lambda c, key, i=i: python_owner_index(of, c.id, key) == i)
    for engine in engines:
        out.update({c.id: engine.n_groups(i) for i, c in enumerate(rules)})
    return out


@pytest.mark.parametrize("disorder", [0.0, 0.3])
@pytest.mark.parametrize("caps", [Caps(sweep_s=0.0), Caps(max_groups=2, sweep_s=0.0), Caps(max_groups=2, sweep_s=1e18), Caps(sweep_s=1e18), Caps(sweep_s=200)])
def test_groups_left_are_those_of_the_engines(spark, caps, disorder):
    rng = random.Random(5)
    rows = [(o, ts, rids, rng.choice("abcdefghij"), h, v) for o, ts, rids, g, h, v in stream(12, 150, disorder)]
    df, field = frame(spark, rows)
    rules = [Correlation("e", "event_count", (1, 2), 300, group_by=("g",), count=3), Correlation("f", "event_count", (3,), 900, group_by=("g", "h"), count=3)]
    got = correlate.instances(df, rules, field, caps, of=2, live=True)
    assert {r["id"]: r["groups"] for r in got.collect()} == left_by_engines(rows, rules, caps, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("MapInArrow" in plan) == (0 < caps.sweep_s < 1e18 or (disorder > 0 and caps == Caps(max_groups=2, sweep_s=0.0)))


def test_groups_left_are_counted_without_a_sort(spark):
    """A task of the queries introspect and sweep doesn't hold an instance's events."""
    from larkspur import queries

    for name in ("introspect", "sweep"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Sort [__key" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_limited_groups_in_ranges(spark, limit):
    """The limit's spells over many ranges of the order and several instances, without a sequence
    of all events."""
    rng = random.Random(limit)
    rows = [(o, ts, rids, rng.choice("abcdef") if o % 40 else "z", h, v) for o, ts, rids, g, h, v in stream(13, 250, 0.2)]
    df, field = frame(spark, rows)
    rules = [Correlation("e", "event_count", (1, 2), 300, group_by=("g",), count=2), Correlation("f", "event_count", (3,), 900, group_by=("g", "h"), count=2)]
    caps, want = Caps(max_groups=limit, sweep_s=1e18), set()
    for i in range(2):
        engine = Engine(rules, caps)
        for o, ts, rids, g, h, v in rows:
            for x in engine.event(rids, {"g": g, "h": h, "v": v}.get, ts, lambda c, key: python_owner_index(2, c.id, key) == i):
                want.add((x["corr_id"], o, tuple(x["group"]), x["observed"]))
    whole = correlate.watched_by_any(df, rules, field)
    for range_rows in (7, 1_000):
        spells = correlate._spells(whole, rules, limit, 2, range_rows)
        fired = correlate.described(correlate.fold(spells, rules, caps, spells=True), rules)
        assert found(fired) == want
    got = correlate.instances(df, rules, field, caps, of=2)
    assert found(got) == want and "spell" in got._jdf.queryExecution().executedPlan().toString()


def test_sweeps_look_at_expired_groups_only():
    """A sweep with each event, in and out of time order: as all groups looked at, and quickly."""

    class Plain(Engine):
        def sweep(self, now):
            self.last_sweep = now if self.last_sweep is None else self.last_sweep
            if now - self.last_sweep >= self.caps.sweep_s:
                self.last_sweep = now
                for c, groups in zip(self.rules, self.groups, strict=True):
                    for key in [k for k, g in groups.items() if g.last_update < now - c.timespan_s]:
                        del groups[key]

    c = [Correlation("e", "event_count", (1,), 50, group_by=("g",), count=2), Correlation("f", "event_count", (1,), 400, group_by=("g",), count=2)]
    rng = random.Random(3)
    for caps in (Caps(sweep_s=0.0), Caps(sweep_s=7.0, max_groups=9), Caps(sweep_s=0.0, max_groups=25)):
        quick, plain = Engine(c, caps), Plain(c, caps)
        for i in range(3_000):
            ts, g = i / 2 - rng.choice([0, 0, 0, 30, 200, 700]), rng.choice([str(rng.randrange(40)), str(i // 9)])
            assert quick.event([1], {"g": g}.get, ts) == plain.event([1], {"g": g}.get, ts)
            assert [list(x) for x in quick.groups] == [list(x) for x in plain.groups]
    engine, begin = Engine(c[1:], Caps(sweep_s=0.0)), time.perf_counter()
    for i in range(100_000):
        engine.event([1], {"g": str(i % 10_000)}.get, i / 100)
    assert engine.n_groups() == 10_000 and time.perf_counter() - begin < 30


def test_counters(spark):
    rows = stream(10)
    df, field = frame(spark, rows)
    caps = Caps(max_events=3, max_distinct=2, sweep_s=1e18)
    rules = [Correlation("vs", "value_sum", (1, 2), 600, group_by=("g",), count=1, field="v"), Correlation("vc", "value_count", (1, 2), 600, group_by=("g",), count=1, field="v")]
    for c in rules:
        engine = Engine([c], caps)
        for o, ts, rids, g, h, v in rows:
            engine.event(rids, {"g": g, "h": h, "v": v}.get, ts)
        row = correlate.stats(df, [c, Correlation("", "x", (), 0)], field, caps).first().asDict()
        assert row["rules_rejected"] == 1
        for name in (*correlate.COUNTED, "event_skipped_missing_field", "values_nonnumeric"):
            assert row[name] == engine.stats[name], name


@pytest.mark.parametrize("ttl_ms", [None, 3_600_000])
def test_streams_agree_with_batches(spark, tmp_path, ttl_ms):
    """All correlations in one stream of several batches, with and without a time to live."""
    rows = stream(4, 120)
    df, field = frame(spark, rows)
    df.where(F.col("ord") < 60).coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where(F.col("ord") >= 60).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    from larkspur.streaming.stateful import correlate_stream

    out = correlate_stream(source, RULES, from_columns(source), ttl_ms=ttl_ms)
    name = f"fires_{ttl_ms or 0}"
    query = out.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(240)
        assert found(spark.table(name)) == expected(rows, RULES)
    finally:
        query.stop()


def run(c, events, caps=Caps()):
    """observed of each fire; events are (ts, rids, value)."""
    engine = Engine([c], caps)
    return [(ts, x["observed"]) for ts, rids, v in events for x in engine.event(rids, lambda _, v=v: v, ts)]


def test_known_cases():
    beacon = Correlation("b", "beaconing", (1,), 3600, count=6, cv_permille=200)
    assert run(beacon, [(100.0 + 60 * i, [1], None) for i in range(6)]) == [(400.0, 6)]
    p80 = Correlation("p", "value_percentile", (1,), 60, count=80, field="n", percentile=80)
    assert run(p80, [(i, [1], v) for i, v in enumerate(["10", "20", "30", "100"])]) == [(3, 100)]
    median = Correlation("m", "value_median", (1,), 60, count=20, field="n")
    assert run(median, [(i, [1], v) for i, v in enumerate(["10", "20", "30"])]) == [(2, 20)]
    total = Correlation("s", "value_sum", (1,), 600, count=1000, field="n")
    assert run(total, [(i, [1], v) for i, v in enumerate(["300", "300", "300", "N/A", "300"])]) == [(4, 1200)]
    late = Correlation("o", "temporal_ordered", (1, 2), 60, ordered_rule_ids=(1, 2))
    assert run(late, [(101.0, [2], None), (100.0, [1], None), (104.0, [1], None)], EVENT_TIME) == [(104.0, 2)]
    again = Correlation("e", "event_count", (1,), 10, count=1)
    assert [t for t, _ in run(again, [(float(t), [1], None) for t in range(25)])] == [0, 10, 20]
    edge = Correlation("w", "event_count", (1,), 10, count=2)
    assert run(edge, [(0.0, [1], None), (10.0, [1], None)]) == [(10.0, 2)]
    assert run(edge, [(0.0, [1], None), (10.5, [1], None)]) == []


def test_admission():
    assert problem(RULES[0]) is None
    wrong = [
        Correlation("", "event_count", (1,), 60), Correlation("x", "y", (1,), 60), Correlation("x", "event_count", (), 60),
        Correlation("x", "event_count", (1,), 0), Correlation("x", "value_avg", (1,), 60), Correlation("x", "temporal", tuple(range(65)), 60, condition=(SEL[0],)),
        Correlation("x", "beaconing", (1,), 60, count=3), Correlation("x", "beaconing", (1,), 60, count=3, cv_permille=1, n_buckets=61),
        Correlation("x", "event_count", (1,), 60, group_by=("a",), alias_group_by=(("a",), ("b",))),
        Correlation("x", "value_percentile", (1,), 60, field="v", percentile=101),
    ]
    assert all(problem(c) for c in wrong)
    engine = Engine([RULES[0], *wrong])
    assert engine.stats["rules_rejected"] == len(wrong) and engine.stats["cond_over_arity"] == 1


def test_groups_are_bounded_and_swept():
    c = Correlation("e", "event_count", (1,), 10, group_by=("g",), count=99)
    engine = Engine([c], Caps(max_groups=2, sweep_s=30))
    for i, g in enumerate("abc"):
        engine.event([1], lambda _, g=g: g, float(i))
    assert engine.n_groups() == 2 and engine.stats["groups_evicted"] == 1
    engine.event([1], lambda _: "z", 100.0)
    assert engine.n_groups(0) == 1
    engine.event([1], lambda _: None, 100.0)
    assert engine.stats["event_skipped_missing_field"] == 1


def test_correlation_file():
    text = """{"version": 1, "correlations": [
      {"id": "a", "type": "temporal", "base_rule_ids": [1, -1, 4294967296, 2], "timespan_s": 99999999999, "group_by": ["1","2","3","4","5","6","7","8","9"],
       "condition": {"op": "odd", "count": 2}, "condition_rpn": [{"k": "sel", "r": 0}, {"k": "not"}]},
      {"id": "b", "condition_rpn": [{"k": "sel", "r": 5}]}, {"type": "temporal"}, 7,
      {"id": "c", "base_rule_ids": [1], "group_by": ["x"], "alias_group_by": [["p", "q"]]}]}"""
    rules, stats = corrfile.loads(text)
    assert [r.id for r in rules] == ["a"] and stats.rules_rejected == 4
    a = rules[0]
    assert a.base_rule_ids == (1, 2) and stats.rids_dropped == 2 and len(a.group_by) == 8 and stats.groupby_truncated == 1
    assert a.timespan_s == 2**31 - 1 and a.op == "gte" and a.condition == (SEL[0], NOT)
    for bad in ("[]", "{", '{"version": 2, "correlations": []}', '{"version": 1}', '{"version": 1, "correlations": []} x'):
        with pytest.raises(corrfile.CorrelationFileError):
            corrfile.loads(bad)


def test_merge_agrees_with_one_instance(spark):
    rows = stream(5, 80)
    df, field = frame(spark, rows)
    c = RULES[0]
    remote = [("count", c.id, 1000.0, ["a"], 2, None, None, None), ("count", "other", 1000.0, ["a"], 9, None, None, None), ("count", c.id, 1000.0, [], 9, None, None, None)]
    sent = spark.createDataFrame(remote, "kind string, corr_id string, ts double, group array<string>, count long, numeric double, value string, seen_mask long")
    sent = sent.withColumn("ord", F.lit(-1).cast("long"))
    got = found(merge.merge(df, sent, c, field))
    engine, want = Engine([c], Caps(sweep_s=1e18)), set()
    fires = engine.contribution({"kind": "count", "corr_id": c.id, "ts": 1000.0, "group": ["a"], "count": 2})
    for o, ts, rids, g, h, v in rows:
        fires = engine.event(rids, {"g": g, "h": h, "v": v}.get, ts)
        want |= {(x["corr_id"], o, tuple(x["group"]), x["observed"]) for x in fires}
    assert got == want


def test_contributions_on_the_wire(spark):
    df, field = frame(spark, stream(6, 60))
    for c, kind in ((RULES[0], "count"), (RULES[1], "distinct"), (RULES[2], "sum"), (RULES[6], "seen")):
        made = merge.partials(df, c, field)
        back = contrib.decode(contrib.encode(made)).select(*made.columns)
        assert sorted(map(repr, back.collect())) == sorted(map(repr, made.collect())) and made.first()["kind"] == kind
    with pytest.raises(ValueError):
        merge.partials(df, RULES[8], field)
    bad = ['{"v":2,"kind":"count","corr_id":"a"}', '{"kind":"count","corr_id":"a"}', '{"v":1,"kind":"event","corr_id":"a"}', '{"v":1,"kind":"count"}', "x", '{"v":"1","kind":"count","corr_id":"a"}']
    good = '{"v":1,"kind":"count","corr_id":"a"}'
    assert contrib.decode(spark.createDataFrame([(x,) for x in [*bad, good]], "value string")).count() == 1


def test_empty_input(spark):
    df, field = frame(spark, stream(7, 1))
    assert correlate.correlate(df.limit(0), RULES[:1] + RULES[8:9], field).count() == 0
    assert correlate.stats(df.limit(0), RULES[:1], field).first()["watched"] == 0
