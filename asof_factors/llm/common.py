"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the text contracts.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).
    Where it is unset, a local master (tests) gets a temporary folder, and a
    cluster an error, as its executors could not read such a folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """The files of a shuffle go with the plan that wrote them, and not when
    the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "true")
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with swept(df.sparkSession):
        return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: unlike a checkpoint, the
    table keeps nothing of how it came about.  Equalities that a checkpoint
    keeps make the plans of deep recursions slow to build."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(docs: DataFrame) -> list[str]:
    """Its columns, for select()."""
    return [f"`{c.replace('`', '``')}`" for c in docs.columns]


def text_hash(c: Column | str = "text") -> Column:
    """With the id, the key of a row: 64-bit hash of its text (null: empty)."""
    return F.xxhash64(F.coalesce(c, F.lit("")))


def of_row(docs: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``facts`` of rows, whose first two columns are the
    doc_id and the text hash; the other columns must be free."""
    own, key = free(docs, "row_id", "row_hash")
    facts = facts.withColumnsRenamed(dict(zip(facts.columns, (own, key))))
    joined = docs.join(facts, docs["doc_id"].eqNullSafe(facts[own]) & (text_hash(docs["text"]) == facts[key]), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(own, key)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def running_sums(values: Column) -> Column:
    """For each of the ints the sum of those before it, in stretches of about
    the root of their number, so that long arrays take no quadratic time."""

    def body(v: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v))).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), size), lambda i: F.aggregate(F.slice(v, i + 1, size), start, add))
        chain = lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["out"], F.transform(p["out"], lambda x: x + acc["at"])).alias("out"))
        return F.aggregate(parts, start, chain, lambda acc: acc["out"])

    # a lambda's argument is evaluated once, an expression at each use
    return F.get(F.transform(F.array(values), body), F.lit(0))
