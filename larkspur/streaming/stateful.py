"""Correlation of streams: the step function with its state in Spark's store.

All correlations share one pass over the stream, one exchange and one stateful
operator. Each group of a correlation is a key; its state is the kernel's, pickled in
one value that the store keeps on disk and expires. Events of a key are stepped through
in arrival order within a micro-batch. The group limit and the periodic sweep of a single
instance go over all keys and have no form here: state expires by age instead.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.correlate import described, watched_by_any
from ..plans.model import Correlation, admitted
from ..sources.events import Resolver
from .kernel import Caps, Group

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRED = "c int, ord long, ts double, grp array<string>, observed long, remote boolean"


class Correlator(StatefulProcessor):
    """Steps the groups of all correlations; a key is a correlation's position and a group."""

    def __init__(self, rules: list[Correlation], caps: Caps, ttl_ms: int | None):
        self.rules, self.caps, self.ttl_ms = rules, caps, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("group", "data binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        group = pickle.loads(self.state.get()[0]) if self.state.exists() else Group()
        batch = pd.concat(list(rows)).sort_values("ord", kind="stable")
        at, out, stats = int(key[0]), [], Counter()
        for row in batch.itertuples(index=False):
            observed = group.event(self.rules[at], row.ts, list(row.rids), row.value, self.caps, stats)
            if observed is not None:
                out.append((at, row.ord, row.ts, list(row.grp), observed, group.remote))
        self.state.update((pickle.dumps(group),))
        yield pd.DataFrame(out, columns=["c", "ord", "ts", "grp", "observed", "remote"])

    def close(self) -> None:
        pass


def correlate_stream(
    df: DataFrame,
    rules: list[Correlation],
    field: Resolver,
    caps: Caps = Caps(),
    ttl_ms: int | None = None,
    mode: str = "Append",
) -> DataFrame:
    """Fires of all admitted correlations over a stream of events (ord long, ts,
    rids and fields). ttl_ms: how long an idle group's state is kept (processing
    time; None: for ever).

    Needs the RocksDB state store, which is set in the session, as a stream takes its
    settings when it starts. So is, with ttl_ms, that no batches run without new
    events: state with a time to live asks for one after each batch, and a stream under
    availableNow would not end. Expired state is not read in any batch."""
    good, _ = admitted(rules)
    if not good:
        raise ValueError("no valid correlation")
    conf = df.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if ttl_ms:
        conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = watched_by_any(df, good, field).withColumn("key", F.to_json("grp"))
    found = rows.groupBy("c", "key").transformWithStateInPandas(
        statefulProcessor=Correlator(good, caps, ttl_ms),
        outputStructType=T.StructType.fromDDL(FIRED),
        outputMode=mode,
        timeMode="ProcessingTime" if ttl_ms else "None",
    )
    return described(found, good)
