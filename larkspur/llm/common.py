"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir. A folder of this machine is made only
    where none is set and the executors are threads of this very process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.split("[")[0] == "local":
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="larkspur-checkpoints-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"


def fresh(name: str, *frames: DataFrame) -> str:
    """name, lengthened until no column of frames has it (Spark ignores case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries planned and run within delete their shuffle files as they end, not when
    the driver's garbage collector comes across them. Only for queries whose rows are
    written: nobody reads their shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder; their shuffles are deleted."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()  # planned anew, with the setting


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared checkpoint folder, and its path; its shuffles are deleted."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove_written(spark: SparkSession, path: str) -> None:
    """Deletes a table that `written` made, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(name: str = "text") -> "F.Column":
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Rows of an Arrow batch: at 10,000 (Spark's default) batches of texts, on either
#: side of the pipe, would be most of an executor's memory.
BATCH_ROWS, SPARK_BATCH_ROWS = 1_000, 10_000


def bounded_batches(spark: SparkSession) -> None:
    """Makes this session's Arrow batches small where it has Spark's default: the
    setting is read when a query runs, after the operator has returned. A size
    that the caller has chosen stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == SPARK_BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


#: Bytes of text handed to a kernel at a time; bounds a Python worker's memory.
SLICE_CHARS = 400_000


def map_texts(
    df: DataFrame,
    kernel: Callable[[], Callable[[list[str]], dict[str, list | pa.Array]]],
    fields: list[T.StructField],
    keep: list[str],
    text: str = "text",
) -> DataFrame:
    """keep's columns of df, and the columns that kernel makes of each text.

    kernel() is called once a task and returns a function from a list of texts
    to the new columns. A null text counts as empty. One Arrow pass without a
    shuffle: a lost executor costs the recomputation of its partitions only.
    """
    bounded_batches(df.sparkSession)
    src = fresh("__text", df)
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    made = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        fn = kernel()
        for batch in batches:
            for part in slices(batch, src):
                new = fn(part.column(src).to_pylist())
                cols = [part.column(c) for c in keep]
                for name in made:
                    v, kind = new[name], out.field(name).type
                    cols.append(v if isinstance(v, pa.Array) else pa.array(v, kind))
                yield pa.RecordBatch.from_arrays(
                    [c.cast(out.field(i).type) for i, c in enumerate(cols)], schema=out
                )
        del fn
        give_back_memory()

    return df.select(*keep, text_or_empty(text).alias(src)).mapInArrow(run, schema)


def text_udf(kernel: Callable[[], Callable[[list[str]], pa.Array]], kind: str) -> Callable[[Column], Column]:
    """A function from a column of texts (null: empty) to a column of type kind.

    Other columns stay in the JVM: only texts go to Python, and only results come
    back. kernel() is called once a task and returns a function from texts to an array.
    """
    bounded_batches(SparkSession.getActiveSession())

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = kernel()
        for batch in batches:
            parts = [fn(p.column(0).to_pylist()) for p in slices(pa.record_batch([batch], ["text"]), "text")]
            yield pa.concat_arrays(parts) if parts else fn([])
        del fn
        give_back_memory()

    return lambda column: run(F.coalesce(column.cast("string"), F.lit("")))


def spliced(text: Column, spans: Column, mark: Column) -> Column:
    """text with its spans (an array of structs with start and end, in order of start;
    null: none) replaced by mark, overlapping ones by one."""
    zero = F.lit(0).cast("long")
    reach = F.aggregate(  # how far the spans before each one go
        spans, F.array(zero), lambda ends, s: F.concat(ends, F.array(F.greatest(F.element_at(ends, -1), s["end"])))
    )

    def built(reach: Column) -> Column:
        def before(s: Column, i: Column) -> Column:
            at = F.get(reach, i)
            gap = F.substring(text, (at + 1).cast("int"), F.greatest(zero, s["start"] - at).cast("int"))
            return F.concat(gap, F.when(s["start"] >= at, mark).otherwise(F.lit("")))

        tail = F.substring(text, (F.element_at(reach, -1) + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(spans, before), ""), tail)

    # The reach is computed once, however often it is named.
    return F.when(spans.isNull(), text).otherwise(F.get(F.transform(F.array(reach), built), F.lit(0)))


def give_back_memory() -> None:
    """What a task has freed goes back to the system: workers outlive tasks, and
    the next one may be of another kind."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """batch in slices of about SLICE_CHARS bytes of column."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + SLICE_CHARS, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
