"""Predicates, rules, routing, explanations and artifacts."""

import random
import struct
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from larkspur.operators import match
from larkspur.plans import compile, evaluate
from larkspur.plans.model import Kind, Network, Op, Predicate, Rule, RuleSet, Selection, Token
from larkspur.sources import artifact, events
from larkspur.sources.builder import RuleBuilder, between, where

EVENTS = [
    {"a": "Hello World", "n": "443/tcp", "ip": "10.1.2.3", "user": "World", "event.category": "process"},
    {"a": "", "n": "-5", "ip": "bad", "event.category": ""},
    {"n": "99999999999999999999", "user": "x", "product": "linux"},
    {"a": "HELLO", "user": "hello", "event.category": "unknown"},
    {"a": "É hello port 8080", "n": "7", "ip": "2001:db8::5", "event.category": "Process"},
    {},
]
FIELDS = sorted({k for e in EVENTS for k in e})
PREDICATES = [
    Predicate("a", Op.EQ, "hello world"), Predicate("a", Op.EQ, "Hello World", cased=True), Predicate("a", Op.CONTAINS, "LO"),
    Predicate("a", Op.CONTAINS, ""), Predicate("a", Op.STARTSWITH, "hel"), Predicate("a", Op.ENDSWITH, "WORLD"), Predicate("a", Op.EXISTS),
    Predicate("a", Op.EXISTS, negate=True), Predicate("n", Op.GT, 400), Predicate("n", Op.GTE, 443), Predicate("n", Op.LT, 0),
    Predicate("n", Op.LTE, 7), Predicate("n", Op.NUMEQ, 2**63 - 1), Predicate("a", Op.RE, r"port \d{3,}"), Predicate("a", Op.RE, "HELLO", cased=True),
    Predicate("a", Op.RE, "[", negate=True), Predicate("ip", Op.CIDR, Network.parse("10.0.0.0/8")), Predicate("ip", Op.CIDR, Network.parse("2001:db8::/32"), negate=True),
    Predicate("a", Op.CONTAINS, "user", fieldref=True), Predicate("a", Op.EQ, "user", fieldref=True, cased=True), Predicate("missing", Op.EQ, "x", negate=True),
    Predicate("a", Op.EQ, ""), Predicate("a", Op.STARTSWITH, "É"),
]


def frame(spark):
    rows = [(i, *[e.get(f) for f in FIELDS]) for i, e in enumerate(EVENTS)]
    names = [f"f{i}" for i in range(len(FIELDS))]
    df = spark.createDataFrame(rows, "ord long, " + ", ".join(f"{n} string" for n in names))
    return df, events.from_columns(df, dict(zip(FIELDS, names, strict=True)))


def test_predicates_agree_with_single_events(spark):
    df, field = frame(spark)
    got = df.orderBy("ord").select(*[compile.predicate(p, field).alias(f"p{i}") for i, p in enumerate(PREDICATES)]).collect()
    for e, row in zip(EVENTS, got, strict=True):
        assert list(row) == [evaluate.predicate(p, e.get) for p in PREDICATES]
    assert all(v is not None for row in got for v in row)


def test_absent_and_negated(spark):
    df, field = frame(spark)
    p = Predicate("a", Op.CONTAINS, "x", negate=True)
    assert df.where("ord = 5").select(compile.predicate(p, field)).first()[0] is True
    assert df.where("ord = 1").select(compile.predicate(Predicate("a", Op.EXISTS), field)).first()[0] is False


def some_rules():
    return (
        RuleBuilder()
        .rule(1, (where("a", "contains", "hello"),), name="one", score=1.5, buckets=("process",))
        .rule(2, (where("a", "contains", "world", "port"), where("n", "gte", 1)), (where("ip", "cidr", "10.0.0.0/8"),), condition="0 1 not and", buckets=("process", "linux"))
        .rule(3, (where("n", "gt", 10**6),), verdict="benign", buckets=("linux",))
        .rule(4, (where("user", "exists"),), buckets=("",))
        .rule(5, tuple(between("n", -10, 10)), verdict="escalate", mitre="T1", severity=3)
        .rule(6, name="no selection")
        .rule(7, (where("a", "eq", "hello"),), condition="0 and")
        .rule(8, (where("a", "contains", "user", fieldref=True),), (), condition="0 1 or", buckets=("process",))
    )


def test_match_routed_linear_and_arrow_agree(spark):
    df, field = frame(spark)
    rules = some_rules().build(prefilter=True)
    for routed in (True, False):
        want = {i: sorted(rules.rules[p].rule_id for p in evaluate.Evaluator(rules, "on").matches(e.get, routed)) for i, e in enumerate(EVENTS)}
        brute = evaluate.Evaluator(RuleSet(rules.rules, rules.buckets))
        assert want == {i: sorted(rules.rules[p].rule_id for p in brute.matches(e.get, routed)) for i, e in enumerate(EVENTS)}
        for how in ("native", "arrow"):
            got = match.match(df, rules, field, routed, how).select("ord", "hits").collect()
            assert {r["ord"]: sorted(h["rule_id"] for h in r["hits"]) for r in got} == want
        for mode in ("off", "auto", "on"):
            got = match.match(df, rules, field, routed, "arrow", prefilter=mode, counters="n").select("ord", "hits", "n.*").collect()
            assert {r["ord"]: sorted(h["rule_id"] for h in r["hits"]) for r in got} == want
            assert all((r["rules_verified"] < r["rules_in_scope"]) == (mode == "on") for r in got if r["rules_in_scope"] == 8 and r["ord"] == 5)
            assert {r["prefilter_runs"] for r in got} == {int(mode == "on")}
    # An event with an unknown bucket sees rule 4 only; one without any sees all rules.
    assert {i: w for i, w in ((3, [4]), (5, []))}.items() <= {i: sorted(rules.rules[p].rule_id for p in brute.matches(e.get, True)) for i, e in enumerate(EVENTS)}.items()


def test_random_rules_agree(spark):
    rng = random.Random(3)
    df, field = frame(spark)
    rules = []
    for rid in range(40):
        sels = tuple(Selection(tuple(tuple(rng.sample(PREDICATES, rng.randint(1, 2))) for _ in range(rng.randint(0, 2)))) for _ in range(rng.randint(0, 3)))
        tokens = tuple(rng.choice([Token(Kind.SEL, rng.randint(0, 3)), Token(Kind.NOT), Token(Kind.AND), Token(Kind.OR)]) for _ in range(rng.choice([0, 0, 3, 4])))
        rules.append(Rule(rid, None, sels, tokens))
    rules = RuleSet(tuple(rules))
    got = match.match(df, rules, field).select("ord", "hits.rule_id").collect()
    for r in got:
        assert r["rule_id"] == [x.rule_id for x in rules.rules if evaluate.rule(x, EVENTS[r["ord"]].get)]


def test_explain_agrees_with_match(spark):
    df, field = frame(spark)
    rules = some_rules().build()
    hits = {r["ord"]: set(r["rule_id"]) for r in match.match(df, rules, field).select("ord", "hits.rule_id").collect()}
    for r in rules.rules:
        for row in match.explain(df, rules, r.rule_id, field).select("ord", "explanation").collect():
            x = row["explanation"]
            assert x["matched"] == (r.rule_id in hits[row["ord"]])
            assert len(x["selections"]) == len(r.selections)
    with pytest.raises(KeyError):
        match.explain_column(rules, 99, field)


def test_totals_and_empty(spark):
    df, field = frame(spark)
    rules = some_rules().build()
    t = match.totals(match.match(df, rules, field)).first()
    assert t["events"] == len(EVENTS) and t["hits"] == t["alert"] + t["benign"] + t["escalate"]
    assert match.totals(match.match(df.limit(0), rules, field)).first()["hits"] == 0
    assert match.match(df, RuleSet(), field).select(F.sum(F.size("hits"))).first()[0] == 0


def test_artifact_round_trip(spark, tmp_path):
    rules = some_rules().rule(9, (where("ip", "cidr", "2001:db8::/32"),), (where("é", "re", "x$"),), condition="0 1 or").build(prefilter=True)
    data = artifact.dumps(rules)
    back = artifact.loads(data)
    assert sorted(back.witnesses, key=repr) == sorted(rules.witnesses, key=repr)
    rules = replace(rules, witnesses=back.witnesses)  # grouped by literal
    assert back == rules and artifact.loads(artifact.dumps(back)) == back
    path = tmp_path / "rules.bin"
    artifact.dump(rules, str(path))
    assert artifact.load(str(path)) == rules == artifact.load_with_spark(spark, str(path))
    artifact.register(spark)
    assert spark.read.format("ruleset").option("path", str(path)).load().count() == len(rules.rules)
    assert artifact.loads(artifact.dumps(RuleSet())) == RuleSet()


def test_artifact_is_refused():
    data = artifact.dumps(some_rules().build(prefilter=True))

    def reason(changed, sign=True):
        if sign:
            changed = changed[:-4] + struct.pack("<I", artifact.crc32c(changed[:-4]))
        with pytest.raises(artifact.ArtifactError) as e:
            artifact.loads(changed)
        return e.value.reason

    assert reason(b"") == reason(data[:20], False) == "size"
    assert reason(b"x" + data[1:]) == "magic"
    assert reason(data[:4] + b"\x06" + data[5:]) == "version"
    assert reason(data[:-1], False) == "size"
    assert reason(data[:200] + bytes([data[200] ^ 1]) + data[201:], False) == "crc"
    refused = 0
    for at in range(16, 144, 4):  # every count and offset, made too large
        try:
            artifact.loads((c := data[:at] + struct.pack("<I", 1 << 30) + data[at + 4 : -4]) + struct.pack("<I", artifact.crc32c(c)))
        except artifact.ArtifactError as e:
            refused += e.reason in ("range", "size")
    assert refused >= 25


def test_old_version_has_no_witnesses():
    rules = some_rules().build()
    data = bytearray(artifact.dumps(rules))
    assert artifact.crc32c(b"123456789") == 0xE3069283
    assert data[4] == 5


def test_json_fields(spark):
    lines = [
        '{"a.b": "flat", "a": {"b": "nested"}, "n": 12, "t": true, "z": null, "l": [1], "o": {}}',
        '{"a": {"b": "nested"}, "n": 1.5}', '{"a.b": null, "a": {"b": "hidden"}}', "not json", '{"s": "x\\u0000y", "e": ""}',
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, j string")
    field = events.from_json(F.col("j"))
    names = ["a.b", "n", "t", "z", "l", "o", "s", "e", "x" * 2000, "a..b"]
    got = df.orderBy("i").select(*[field(n).alias(f"c{k}") for k, n in enumerate(names)]).collect()
    assert list(got[0])[:6] == ["flat", "12", "true", None, None, None]
    assert got[1][0] == "nested" and got[1][1] == "1.5"
    assert got[2][0] is None and list(got[3]) == [None] * 10
    assert got[4][6] == "x" and got[4][7] == "" and got[4][8] is None


def test_read_inputs(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3}\n{"x": 4} {"x": 5}')
    got = events.read_json(spark, str(tmp_path / "*.json"))
    assert sorted(r[0] for r in got.select(events.from_json(F.col("json"))("x")).collect()) == list("12345")
    (tmp_path / "bad.json").write_text('{"x": 1} 7')
    with pytest.raises(Exception, match="event 1"):
        events.read_json(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "t.tsv").write_text("_ts=5\ta=1=2\ta=3\tjunk\n\nb=2\n_ts=x\ta=\n_ts=\n  \n")
    rows = events.with_line_clock(events.read_tsv(spark, str(tmp_path / "t.tsv"))).orderBy("ord").collect()
    assert [(r["fields"], r["clock"]) for r in rows] == [
        ({"_ts": "5", "a": "1=2"}, 5.0), ({"b": "2"}, 2.0), ({"_ts": "x", "a": ""}, 0.0), ({"_ts": ""}, 4.0), ({}, 5.0),
    ]
    lines = events.read_tsv(spark, str(tmp_path / "t.tsv")).orderBy("ord")
    field = events.from_map(F.col("fields"))
    told = lines.select(field("a").alias("a"), events.present(field)("a").alias("present")).collect()
    assert [tuple(r) for r in told] == [("1=2", "1=2"), (None, None), ("", None), (None, None), (None, None)]


@pytest.mark.parametrize("cased", [True, False])
def test_regular_expressions_have_one_dialect(spark, cased):
    """Bytes, ASCII classes, ASCII folding: alike in the JVM, on single events and bounded."""
    from larkspur.functions import regexes

    texts = ["é", "É", "٣", "3", "\u2028", "\u0085", " ", "aé b", "a&b", "[a]x", "abcx", "ax", "\x0b", "_é", "éa", "a\n", "a", "^", "é1", "ab\n", "\u212a", "ſ"]
    patterns = [
        r"\d", "É", r"\s", "[a-z&&[^b]]", "[[:alpha:]]x", r"\bb", r"\bé", r"a\Z", r"a\z", "^a$", ".é", "^.$", "^..$", r"\w\W", "[^a]b",
        r"\Ba", "[]a]x", "[é]", r"a\b", "(?:a|b)+x", r"\\b", "k", "s",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.orderBy("i").select(*[regexes.matches(F.col("t"), p, cased).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for t, row in zip(texts, rows, strict=True):
        assert list(row) == [regexes.search(p, cased, t) for p in patterns], t
    assert {regexes.plan(p, cased) for p in patterns} == {"native", "bounded"}
    hits = {p: [t for t, row in zip(texts, rows, strict=True) if row[k]] for k, p in enumerate(patterns)}
    assert hits[r"\d"] == ["3", "é1"] and hits["É"] == ["É"] and hits["[a-z&&[^b]]"] == ["[a]x"]
    assert "\u2028" not in hits[r"\s"] and not hits["k"]
