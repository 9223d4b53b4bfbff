"""Coercions, addresses, patterns, times and ownership."""

import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import evtime, network, ownership, regexes, text
from larkspur.plans.model import Network


def values(spark, made, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(made(F.col("v"))).collect()]


I64 = [
    ("443/tcp", 443), ("-12x", -12), ("+7", 7), (" 5", None), ("", None), ("x", None), (None, None), ("-", None),
    ("9223372036854775807", 2**63 - 1), ("9223372036854775808", 2**63 - 1), ("-9223372036854775809", -(2**63)),
    ("0" * 40 + "12", 12), ("99999999999999999999999", 2**63 - 1), ("-0", 0), ("-9223372036854775808", -(2**63)),
]
F64 = [
    ("1500/tcp", 1500.0), ("  2.5e3x", 2500.0), (".5", 0.5), ("5.", 5.0), ("N/A", None), ("inf", None), ("nan", None),
    ("", None), (None, None), ("1e999", None), ("0x1p3", 8.0), ("-0x.8", -0.5), ("+3", 3.0), ("0x", 0.0), ("-", None),
]


def test_integers(spark):
    assert values(spark, text.to_i64, [v for v, _ in I64]) == [x for _, x in I64]
    assert [None if v is None else text.literal_to_i64(v) for v, _ in I64] == [x for _, x in I64]


def test_doubles(spark):
    assert values(spark, text.to_f64, [v for v, _ in F64]) == [x for _, x in F64]
    assert [None if v is None else text.literal_to_f64(v) for v, _ in F64] == [x for _, x in F64]


def test_fold_is_ascii_only(spark):
    assert values(spark, text.fold, ["ABCz", "É", "K"]) == ["abcz", "É", "K"]


ADDRESSES = ["10.1.2.3", "010.1.2.3", "10.1.2.256", "10.1.2", "10.1.2.3 ", "::ffff:10.1.2.3", "2001:db8::1", "2001:db8::1%eth0", "", None, "11.0.0.0"]


def test_networks(spark):
    v4, v6 = Network.parse("10.0.0.0/8"), Network.parse("2001:db8::/32")
    want = [True] + [False] * 10
    assert values(spark, lambda v: F.coalesce(network.in_network(v, v4), F.lit(False)), ADDRESSES) == want
    assert [network.address_in(a or "", v4) for a in ADDRESSES] == want
    got = values(spark, lambda v: F.coalesce(network.in_network(v, v6), F.lit(False)), ADDRESSES)
    assert [a for a, g in zip(ADDRESSES, got, strict=True) if g] == ["2001:db8::1"]
    assert str(v6) == "2001:db8::/32"
    everything = values(spark, lambda v: network.in_network(v, Network.parse("0.0.0.0/0")), ["1.2.3.4"])
    assert everything == [True]


@pytest.mark.parametrize(
    ("pattern", "how"),
    [(r"port \d{3,}", "native"), (r"^(a|b)*c$", "bounded"), (r"^(a+)+$", "bounded"), ("[", "skipped"), (r"\C", "skipped"), (r"(?:ab){3}", "native"), (r"(a)\1", "bounded")],
)
def test_how_patterns_run(spark, pattern, how):
    assert regexes.plan(pattern, False) == how


def test_hostile_patterns_end(spark):
    long = "a" * 40 + "!"
    assert values(spark, lambda v: regexes.matches(v, r"^(a+)+$", False), [long, "AAA"]) == [False, True]
    assert values(spark, lambda v: regexes.matches(v, r"^(a|b)*c$", True), ["ab" * 20_000 + "c"])[0] in (True, False)
    assert values(spark, lambda v: regexes.matches(v, "[", True), ["["]) == [False]


def test_matches_late_in_long_texts_are_found():
    text = "harmless words of a very long text " * 150_000
    assert regexes.search(r"([a-z]+[0-9])+@", False, text + "ab1@")
    assert not regexes.search(r"([a-z]+[0-9])+@", False, text)


TIMES = [
    ("2024-01-02T03:04:05Z", 1704164645.0), ("2024-01-02 03:04:05.25+02:00", 1704157445.25), ("2024-01-02", 1704153600.0),
    ("2024-01-02T03:04", 1704164640.0), ("2024-02-31", 1709337600.0 - 86400 + 0), ("1700000000", 1700000000.0),
    ("1700000000.5", 1700000000.5), ("12345", None), ("2024/01/02 03:04:05", 1704164645.0),
    ("2/Jan/2024:03:04:05 +0100", 1704161045.0), ("Jan  2 03:04:05", 1704164645.0), ("Dec 31 23:59:60", 1704067200.0),
    ("  2024-01-02  ", 1704153600.0), ("2024-13-02", None), ("2024-01-02T25:00:00", None), ("1969-01-01", None),
    ("", None), (None, None), ("nonsense", None), ("x" * 70, None), ("2024-01-02T03:04:05+15:00", None),
    ("2024-01-02T03:04:61", None),
]


def test_times(spark):
    want = [x for _, x in TIMES]
    want[4] = 1709164800.0 + 2 * 86400  # 31 February is 2 March
    got = values(spark, lambda v: evtime.parse_time(v, 1704900000.0), [v for v, _ in TIMES])
    assert got == want


def test_clock_carries(spark):
    rows = [(i, float(i * 10) if i % 3 == 1 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "o long, own double")
    got = {r["o"]: (r["ts"], r["untimed"]) for r in evtime.event_clock(df, "own", "o").collect()}
    last = 0.0
    for o, own in rows:
        last = own if own is not None else last
        assert got[o] == (last, own is None)
    assert evtime.event_clock(df.limit(0), "own", "o").count() == 0


def test_owner(spark):
    # Values that every peer shares.
    for peers, want in ((4, 1), (7, 6), (8, 5)):
        assert ownership.python_owner_index(peers, "brute", ["10.0.0.1", "root"]) == want
    df = spark.createDataFrame([("10.0.0.1", "root"), ("é", ""), (None, "x")], "a string, b string")
    for peers in (4, 7, 8, 1000):
        got = [r[0] for r in df.select(ownership.owner_index(peers, F.lit("brute"), F.col("a"), F.col("b"))).collect()]
        want = [ownership.python_owner_index(peers, "brute", g) for g in (["10.0.0.1", "root"], ["é", ""], ["", "x"])]
        assert got == want
    assert [r[0] for r in df.select(ownership.owner_index(0, F.lit("x"))).collect()] == [0, 0, 0]


def test_nan_is_no_number():
    assert text.literal_to_f64("nan") is None and math.isfinite(text.literal_to_f64("1"))


def test_query_of_wide_numbers_follows_its_sql(spark, tmp_path):
    """Users of five digits and more, whose repeated numbers have more than 30."""
    import duckdb

    from larkspur import queries

    path = str(tmp_path / "events.parquet")
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, u AS user_id, 'click' AS event_type, 1.5 AS value, '{{}}' AS props FROM (VALUES (1, 7), (2, 9999), (3, 10000), (4, 123456)) t(i, u)) TO '{path}'")
    want = duckdb.sql(queries.ORACLES["to_i64"].replace("FROM events", f"FROM '{path}'")).fetchall()
    assert sorted(map(tuple, queries.QUERIES["to_i64"](spark, str(tmp_path)).collect())) == sorted(want)
    assert {r[0]: r[2] for r in want} == {1: 7777777, 2: -(1 << 63), 3: None, 4: None}
