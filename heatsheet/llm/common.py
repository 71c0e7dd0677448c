"""Reading documents and keeping intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, NULL text as empty; other columns cannot clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="heatsheet-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(
    df: DataFrame, name: str, partition_by: str | None = None, files: int | None = None
) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and every
    later read sees the same rows even if executors are lost. ``files`` bounds the number of
    files of a table known to be small; its last stage then has no more tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = (df.coalesce(files) if files else df).write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame, part: str = "") -> None:
    """Delete a table made by ``written`` once nothing will read it again; with ``part``
    (``/column=value``) only that part of a table partitioned by the column."""
    spark = table.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if not name.endswith(part):
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(
    df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]
) -> DataFrame:
    """Apply ``work`` to every Arrow batch of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(released(run), schema)


def released(
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on a partition, after which the worker gives back what Arrow has freed but kept.
    Spark keeps workers for later stages, whose executor would go on paying for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return run


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
    )
