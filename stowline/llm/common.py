"""Helpers shared by the text operators: row keys, checked joins and chunked Arrow mapping."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stowline.session import checkpoint_ready, cut_lineage

#: A table is broadcast only after counting that it has no more rows than this.
BROADCAST_ROWS = 400_000
#: A key with at least so many rows is hot. There are at most rows / HOT_ROWS such keys.
HOT_ROWS = 1_000_000
#: Bytes of text that a task holds as Python objects at a time.
CHUNK_BYTES = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so that later steps neither recompute nor see changes."""
    return cut_lineage(df)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def row_key() -> Column:
    """A number for each row of a table scan.

    It depends on the scan's partitions and row order only, which a recomputed task repeats. It tells equal
    rows apart; nothing that must agree between two applications may depend on more than that.
    """
    return F.monotonically_increasing_id()


def task_numbers(spark: SparkSession, parts: int) -> DataFrame:
    """``part, number``: for each of ``parts`` tasks a number that Spark's hash deals to it, if it deals by an int column to so many.

    Dealt by its own number, a bucket would share its task with others by chance, and one task get several. A task for which
    no number was found, which hardly happens, has no row.
    """
    tried = spark.range(int(parts * (math.log(parts) + 12)) + 64).select(F.col("id").cast("int").alias("number"))
    return tried.groupBy(F.pmod(F.hash("number"), F.lit(parts)).cast("int").alias("part")).agg(F.min("number").alias("number"))


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; stops counting beyond."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], count: str | None = None, how: str = "left",
                rows: int = BROADCAST_ROWS, hot: int = HOT_ROWS) -> DataFrame:
    """Join ``small``, which has one row per key, to ``big`` without gathering a hot key.

    A counted small table is broadcast. Beyond that, the keys with at least ``hot`` rows in ``big`` (``count``
    names the column of ``small`` that says so) are broadcast, a table of at most rows / ``hot`` rows, and the
    rest is shuffled. ``small`` should be cut before. Keys must not be null; ``how`` is left or inner.
    """
    on = list(on)
    if few(small, rows):
        return big.join(F.broadcast(small), on, how)
    if count is None:
        return big.join(small, on, how)
    marked = big.join(F.broadcast(small.where(F.col(count) >= hot).withColumn("_hot", F.lit(True))), on, "left")
    rest = marked.where(F.col("_hot").isNull()).select(*big.columns)
    done = marked.where(F.col("_hot")).drop("_hot")
    return done.unionByName(rest.join(small.where(F.col(count) < hot), on, how))


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def with_arrow(df: DataFrame, column: str, fields: Sequence[T.StructField], make: Callable[[], Callable[[list], Sequence]],
               drop: Sequence[str] = ()) -> DataFrame:
    """Add ``fields`` computed from ``column`` by an Arrow function over chunks of rows.

    ``make()`` runs once per task and returns the function from a list of values to one list or array per field.
    A column of ``df`` with the name of a new field is replaced; those in ``drop`` are left out.
    """
    gone = {f.name for f in fields} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in gone]
    names = [f.name for f in kept]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    out = T.StructType([*kept, *fields])

    def run(batches):
        work = make()
        for batch in batches:
            for part in text_chunks(batch, column):
                made = work(part.column(column).to_pylist())
                new = [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new], [f.name for f in out.fields])

    needed = [*dict.fromkeys([*names, column])]
    return df.select(*needed).mapInArrow(run, out)
