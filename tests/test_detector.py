"""The JSON front end end to end, and the driver's contract."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from larkspur.detector import Detector
from larkspur.functions import evtime
from larkspur.sources import artifact
from larkspur.sources.builder import RuleBuilder, where
from larkspur.streaming.kernel import Caps


def rules():
    """Doors and printers of an office."""
    return (
        RuleBuilder()
        .rule(5101, (where("door.state", "startswith", "forced"),), (where("door.panel", "cidr", "172.20.0.0/14"),), condition="0 1 not and", name="forced door", buckets=("access",))
        .rule(5207, (where("job.pages", "gt", 250),), name="long print job", buckets=("printing",))
        .rule(5330, (where("badge.holder", "contains", "visitor"), where("badge.age_days", "lte", 2)), name="new visitor", buckets=("",))
        .build()
    )


EVENTS = [
    {"timestamp": "2031-03-09T06:30:00Z", "event": {"category": "access"}, "door": {"state": "FORCED open", "panel": "192.0.2.44"}, "badge.holder": "kim"},
    {"event.category": "access", "time": "1930804245", "door.state": "forced", "door": {"panel": "192.0.2.44"}, "badge": {"holder": "lou"}},
    {"event": {"category": "access"}, "door": {"state": "forced", "panel": "172.21.9.9"}, "badge": {"holder": "kim"}},
    {"event": {"category": "printing"}, "job": {"pages": "900 of 900"}, "badge": {"holder": "max"}},
    {"event": {"category": "canteen"}, "job": {"pages": 900}, "badge": {"holder": "Visitor 12", "age_days": "1 day"}},
    {"event": {"category": ["access"]}, "job": {"pages": 251}},
    {"event": {"category": "access"}, "door": {"state": "forced shut", "panel": "192.0.2.44"}, "badge": {"holder": "kim"}},
]
EXPECT = [[5101], [5101], [], [5207], [5330], [5207], [5101]]
CORRELATIONS = {
    "version": 1,
    "correlations": [
        {"id": "rattled", "type": "event_count", "base_rule_ids": [5101], "group_by": ["door.panel"], "timespan_s": 900, "condition": {"op": "gt", "count": 2}},
        {"id": "two hands", "type": "value_count", "base_rule_ids": [5101], "group_by": ["door.panel"], "timespan_s": 900, "condition": {"count": 2, "field": "badge.holder"}},
        {"id": "in and out", "type": "temporal_ordered", "base_rule_ids": [5101, 5207], "timespan_s": 3600},
    ],
}


@pytest.fixture()
def detector(spark, tmp_path):
    artifact.dump(rules(), str(tmp_path / "rules.bin"))
    (tmp_path / "corr.json").write_text(json.dumps(CORRELATIONS))
    return Detector.load(spark, str(tmp_path / "rules.bin"), str(tmp_path / "corr.json"))


def frame(spark):
    return spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(EVENTS)], "ord long, json string").repartition(3)


def test_match_and_explain(spark, detector):
    got = {r["ord"]: r["ids"] for r in detector.match(frame(spark)).select("ord", F.col("hits.rule_id").alias("ids")).collect()}
    assert [got[i] for i in range(len(EVENTS))] == EXPECT
    told = {r["ord"]: r["explanation"] for r in detector.explain(frame(spark), 5207).collect()}
    assert told[4]["matched_unrouted"] and not told[4]["matched"]  # out of scope by routing
    assert told[3]["selections"][0]["predicates"][0]["value"] == "900 of 900"
    assert detector.info(spark).count() == 3 and detector.summary()["correlations"] == 3


def test_clock_and_fires(spark, detector):
    times = {r["ord"]: (r["ts"], r["untimed"]) for r in detector.clocked(frame(spark)).collect()}
    assert times[0] == (1930804200.0, False) and times[1] == (1930804245.0, False)
    assert all(times[i] == (1930804245.0, True) for i in range(2, 7))
    fires = {(r["corr_id"], r["ord"], tuple(r["group"]), r["observed"]) for r in detector.correlate(frame(spark)).collect()}
    assert fires == {("two hands", 1, ("192.0.2.44",), 2), ("rattled", 6, ("192.0.2.44",), 3)}
    quick = detector.correlate(frame(spark), caps=Caps())
    assert ("in and out", 3) in {(r["corr_id"], r["ord"]) for r in quick.collect()}


@pytest.mark.parametrize("range_rows", [1, 3, 50, 10**6])
def test_clock_by_ranges(spark, range_rows):
    """The carry over ranges of any size is that of one pass."""
    own = [None, None, 5.0, None, 7.5, None, None, None, 1.0, None] * 12
    df = spark.createDataFrame([(3 * i, t) for i, t in enumerate(own)], "n long, own double").repartition(4)
    clocked = evtime.event_clock(df, "own", "n", "ts", range_rows).orderBy("n").collect()
    last, want = 0.0, []
    for t in own:
        last = last if t is None else t
        want.append((last, t is None))
    assert [(r["ts"], r["untimed"]) for r in clocked] == want


def test_match_on_a_stream(spark, detector, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ord long, json string").parquet(str(tmp_path / "in"))
    out = detector.match(source).select("ord", F.col("hits.rule_id").alias("ids"))
    query = out.writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(90)
        got = {r["ord"]: r["ids"] for r in spark.table("hits").collect()}
        assert [got[i] for i in range(len(EVENTS))] == EXPECT
    finally:
        query.stop()


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    assert "match_routed" in queries


def test_nothing_imports_the_training_data_package():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "larkspur"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
