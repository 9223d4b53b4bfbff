"""The front end over JSON events: info, match, explain and correlate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import evtime
from .operators import correlate, match
from .plans.compile import skipped_regexes
from .plans.model import Correlation, RuleSet, admitted
from .sources import artifact, corrfile, events
from .streaming.kernel import EVENT_TIME, Caps


class Detector:
    """A rule set, and correlations over its hits.

    Events come as a DataFrame with a column of JSON objects; `match`, `explain`
    and `clocked` also take any other resolver of fields. Matching and explaining
    work on streams as they do on batches.
    """

    def __init__(self, rules: RuleSet, correlations: list[Correlation] = ()):
        self.rules = rules
        self.correlations, self.rejected = admitted(list(correlations))

    @classmethod
    def load(cls, spark: SparkSession, rules: str, correlations: str | None = None) -> "Detector":
        """From a compiled artifact and, optionally, a correlation file."""
        found = []
        if correlations:
            row = spark.read.text(correlations, wholetext=True).first()
            found, _ = corrfile.loads(row[0] if row else "")
        return cls(artifact.load_with_spark(spark, rules), found)

    def info(self, spark: SparkSession) -> DataFrame:
        """A row for each rule."""
        return artifact.rule_table(spark, self.rules)

    def summary(self) -> dict[str, int]:
        return {
            "rules": len(self.rules.rules), "buckets": len(self.rules.buckets), "fields": len(self.rules.fields()),
            "correlations": len(self.correlations), "regexes_skipped": skipped_regexes(self.rules), **self.rejected,
        }

    def match(self, df: DataFrame, json: str | Column = "json", field: events.Resolver | None = None, routed: bool = True, strategy: str = "auto", prefilter: str = "auto", counters: str | None = None) -> DataFrame:
        """df with the hits of each event."""
        return match.match(df, self.rules, field or _json(json), routed, strategy, prefilter=prefilter, counters=counters)

    def explain(self, df: DataFrame, rule_id: int, json: str | Column = "json", field: events.Resolver | None = None) -> DataFrame:
        return match.explain(df, self.rules, rule_id, field or _json(json))

    def clocked(self, df: DataFrame, json: str | Column = "json", order: str = "ord", ref_wall: float = 0, field: events.Resolver | None = None) -> DataFrame:
        """df with each event's time (ts): its own, or the last one before it."""
        resolve = field or _json(json)
        names = {f: f"__time_{i}" for i, f in enumerate(evtime.ALL_FIELDS)}
        wide = df.select("*", *[resolve(f).alias(n) for f, n in names.items()])
        own = wide.withColumn("__own", evtime.own_time(lambda f: F.col(names[f]), ref_wall)).drop(*names.values())
        return evtime.event_clock(own, "__own", order, "ts").drop("__own")

    def correlate(
        self, df: DataFrame, json: str | Column = "json", order: str = "ord", ref_wall: float = 0,
        caps: Caps = EVENT_TIME, how: str = "auto", field: events.Resolver | None = None,
    ) -> DataFrame:
        """Fires over all events that match, with their own times; order is a column
        of numbers that gives the arrival order."""
        resolve = field or _json(json)
        timed = self.clocked(df, json, order, ref_wall, field)
        # Events without hits go where a row is made for each correlation that watches one.
        hits = match.match(timed, self.rules, resolve)
        rows = hits.withColumn("ord", F.col(order)).withColumn("rids", F.transform("hits", lambda h: h["rule_id"]))
        return correlate.correlate(rows, self.correlations, resolve, caps, how)


def _json(column: str | Column) -> events.Resolver:
    return events.from_json(F.col(column) if isinstance(column, str) else column)
