"""Where intermediate tables go: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Held while a table is made: a join takes its sides as they are if they are
#: dealt out by some of its keys, and the files of a shuffle go with its plan.
MAKING = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows of a table that a join sends to all executors, at most.
FEW = 50_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset, a local master (tests)
    gets a temporary folder, and a cluster an error, as its executors could
    not read such a folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir")


@contextmanager
def making(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in MAKING}
    try:
        for k, v in MAKING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialised(df: DataFrame) -> DataFrame:
    """Computed once into the shared folder: later plans start from there.
    Compressed columns take a fraction of a checkpoint's rows; how the rows
    were dealt out is not kept."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with making(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def land(facts: DataFrame, folder: str) -> None:
    """Files of facts that are dealt out by company, added to a folder."""
    with making(facts.sparkSession):
        facts.write.mode("append").option("compression", "zstd").parquet(folder)


def few(df: DataFrame) -> DataFrame:
    """A materialised table, sent to all executors by a join if it is small."""
    df = materialised(df)
    return df.hint("broadcast") if df.count() <= FEW else df


def many(rows: DataFrame) -> DataFrame:
    """A side of a join with a row for each company: by the size of its files
    Spark takes it for small and would send it whole through the driver."""
    return rows.hint("merge")
