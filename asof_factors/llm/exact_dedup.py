"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters (``repartitionByRange``) deal rows out by the first bytes
of their normalised text, its 64-bit hash and a salt from the document's id.
Rows of equal texts are neighbours in that order, and a group of copies of any
size is cut into at most ``salts`` runs.  The external sort of each partition
puts the equal texts of a run next to each other, and the window over it
compares each row's full normalised text with its neighbour's: a run ends where they
differ.  Its first row is its best document, so a run gives one row with its
size and that document; the runs of a text, ``salts`` at most, then meet to
settle the group, and every row learns the result from its own run.  The
splitters see a prefix and a hash instead of whole texts, so that the sample
on the driver stays small.

Defined results: null text counts as empty; all empty texts are one group.
Rows that repeat a doc_id and a text are all returned and one of them is
kept.  Null doc_ids are largest.  An empty table gives an empty result.
Columns other than the id and text columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, free, quoted, sha, table

SALTS = 64
PREFIX = 48


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def _runs(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """doc_id, n_points, text_sha256 and salt of each row, its place ``rn`` in
    its run (1: the best) and the run's size ``n``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    norm = normalise(F.col("text"))
    rows = rows.select(
        "doc_id",
        "text",
        F.substring(norm, 1, PREFIX).alias("prefix"),
        F.xxhash64(norm).alias("h"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    dealt = rows.repartitionByRange("prefix", "h", "salt").select("*", norm.alias("norm"), F.char_length("text").cast("long").alias("n_points")).drop("text")
    run = Window.partitionBy("prefix", "h", "salt", "norm").orderBy(F.desc("n_points"), F.col("doc_id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = dealt.withColumn("rn", F.row_number().over(run)).withColumn("n", F.count(F.lit(1)).over(whole))
    return cut(placed.select("doc_id", "n_points", sha(F.col("norm")).alias("text_sha256"), "salt", "rn", "n"))


def _settled(runs: DataFrame) -> DataFrame:
    """For each run (text_sha256, salt): keep_id, group_size and whether the
    document that stays is in it."""
    best = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("last"), "doc_id", "salt")
    heads = runs.filter("rn = 1").select("text_sha256", "salt", "n", best.alias("best"))
    groups = heads.groupBy("text_sha256").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"), F.collect_list("salt").alias("salts"))
    return groups.select("text_sha256", "group_size", "best", F.explode("salts").alias("salt")).select("text_sha256", "salt", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.salt") == F.col("salt")).alias("here"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each row of ``docs``: its id as ``doc_id``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256`` and ``n_points``.

    Of equal texts the row with the most code points in the original text
    stays, then the one with the smallest id."""
    runs = _runs(docs, id_col, text_col, salts)
    kept = ((F.col("rn") == 1) & F.col("here")).alias("kept")
    return runs.join(_settled(runs), ["text_sha256", "salt"]).select("doc_id", "keep_id", "group_size", kept, "text_sha256", "n_points")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.  Of rows that also
    repeat the id, one stays."""
    own, key, points, at, h, place = free(docs, "kept_id", "kept_sha", "points", "kept_hash", "id_hash", "text_sha")
    runs = _runs(docs, "doc_id", "text", SALTS)
    heads = runs.filter("rn = 1").join(_settled(runs).filter("here"), ["text_sha256", "salt"])
    kept = heads.select(F.xxhash64("doc_id").alias(at), F.col("text_sha256").alias(key), F.col("doc_id").alias(own), F.col("n_points").alias(points))
    marked = docs.select("*", F.xxhash64("doc_id").alias(h), sha(normalise(F.col("text"))).alias(place))
    same = marked["doc_id"].eqNullSafe(kept[own]) & (F.char_length(F.coalesce(marked["text"], F.lit(""))) == kept[points])
    # the window finds its rows dealt and sorted by the join
    once = Window.partitionBy(h, place).orderBy("text")
    joined = marked.join(kept, (marked[h] == kept[at]) & (marked[place] == kept[key]) & same)
    return joined.withColumn(points, F.row_number().over(once)).filter(F.col(points) == 1).select(*quoted(docs))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
