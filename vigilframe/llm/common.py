"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only where none is set (tests) pick one under the warehouse."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


#: rows of a narrow table in one file of a checkpoint
PER_FILE = 50_000


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut lineage with a copy in the shared folder, which outlives any executor. rows: about how many there are at most, where
    that is known: small tables then take few files, whatever the number of shuffle partitions is."""
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(8, rows // PER_FILE))
    return df.checkpoint(eager=True)


def ordinals(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Number all rows from 0 in a total order without putting them in one task.

    Rows are range partitioned and sorted, written to the checkpoint folder, and each partition's
    first number follows from the row counts of the partitions before it. Only those counts, one
    per partition, reach the driver.
    """
    mark = "__mark"
    placed = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()))
    part, row = F.shiftright(mark, 33), F.col(mark).bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, n in counts:
        starts[p], total = total, total + n
    if not starts:
        return placed.withColumn(name, F.lit(None).cast("long")).drop(mark)
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), part)
    return placed.withColumn(name, (offset + row).cast("long")).drop(mark)


#: rows in an Arrow batch at most, so that a batch of long texts stays small on both sides of a Python worker's pipe
BATCH = 256


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows in an Arrow batch to BATCH. It stays so: plans are run later, by whoever writes the result."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def per_text(df: DataFrame, keys: list[str], text: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[bytes], tuple]]) -> DataFrame:
    """Apply a per-text function in Arrow batches. keys pass through; text reaches it as UTF-8 bytes, null as None.

    make() runs once for each task and returns the function; equal consecutive texts aren't cached.
    """
    small_batches(df.sparkSession)
    chosen = df.select(*[F.col(k) for k in keys], F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([chosen.schema[k] for k in keys] + [T.StructField(n, t) for n, t in fields])
    names, width = [n for n, _ in fields], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(t) for _, t in fields]
        apply = make()
        for batch in batches:
            texts = batch.column(width)
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                rows = [apply(x.as_py()) for x in texts.slice(lo, BATCH)]
                columns = [part.column(i) for i in range(width)]
                columns += [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:width], *names])

    return chosen.mapInArrow(run, schema)
