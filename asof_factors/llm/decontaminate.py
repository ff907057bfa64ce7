"""Benchmark decontamination in DataFrame operations only.

Every run of ten normalised words of a benchmark item is a window (a shorter
item is one window).  The set of the windows' 64-bit hashes is broadcast while
their number is below a checked limit; while a document is scanned, the hash of
the window at each of its words is looked up in the set, and a hit is verified
by comparing the words themselves.  Beyond the limit the windows of the
documents are dealt out by hash instead, and candidates verified the same.
Windows hit many times are no hot keys: items are looked up once for each
document and window.

``drop_contaminated`` removes documents; ``remove_spans`` cuts the hit words
out of the original text, which otherwise stays as it is.

Defined results: null and empty texts have no words and no hits; a window
inside several items counts for each of them; repeated rows give repeated
results; null item ids are ignored in item lists but their windows count as
hits.  Empty tables give empty results or no hits.  Other columns of either
table play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, free, of_row, quoted, sha, table, text_hash

WORDS = 10
#: Separators between words: ASCII but digits and letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Window hashes are broadcast up to so many (about 40 bytes each).
BROADCAST_WINDOWS = 2_000_000
#: Window texts and items are broadcast up to this many characters of text.
BROADCAST_CHARS = 64_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def windows_of(benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """Distinct windows: ``window`` text, ``k`` words, ``items`` that hold it."""
    w = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("w") - k + 1)
    each = w.select("item_id", k.alias("k"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.least(F.size("w"), F.lit(size))), " "))).alias("window"))
    return each.groupBy("window", "k").agg(F.collect_set("item_id").alias("items"))


def window_hash(hashes: Column) -> Column:
    """Of the hashes of a window's words."""
    return F.xxhash64(hashes)


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """For each row of ``docs``: doc_id, text_hash (with doc_id the row's
    key), n_words, hits (start, words; sorted) and items (ids, as strings,
    sorted)."""
    windows = cut(windows_of(benchmark, size).withColumn("h", window_hash(hashes_of(F.split("window", " ")))))
    facts = windows.agg(F.sort_array(F.collect_set("k")).alias("ks"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length("window")), F.lit(0)).alias("chars")).first()
    near = windows.select(F.col("h").alias("wh"), F.col("k").alias("wk")).distinct()
    few = facts["n"] <= most
    near = F.broadcast(near) if few else near

    given = docs.select("doc_id", text_hash().alias("text_hash"), words_of(F.col("text")).alias("w"))
    base = given.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"))
    scanned = given.withColumn("hw", hashes_of(F.col("w")))
    at = F.concat(*[_windows_at(k) for k in facts["ks"]]) if facts["ks"] else F.array().cast("array<struct<start:int,k:int,h:bigint>>")
    match = (F.col("at.h") == F.col("wh")) & (F.col("at.k") == F.col("wk"))
    if few:
        found = scanned.select("doc_id", "text_hash", "w", F.explode(at).alias("at")).join(near, match)
    else:
        # windows are dealt out by hash without their text; what matches meets its row's words again
        found = scanned.select("doc_id", "text_hash", F.explode(at).alias("at")).join(near, match)
        found = found.groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("t")).agg(F.collect_set(F.struct("at.start", "at.k")).alias("places"))
        found = given.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t"))).select("doc_id", "text_hash", "w", F.explode("places").alias("at"))
    found = cut(found.select("doc_id", "text_hash", "at.start", "at.k", F.array_join(F.slice("w", F.col("at.start"), F.col("at.k")), " ").alias("window")))

    side = windows.select("window", "items")
    side = F.broadcast(side) if facts["chars"] <= BROADCAST_CHARS else side
    once = found.groupBy("doc_id", "text_hash", "window").agg(F.collect_set(F.struct("start", "k")).alias("places")).join(side, "window")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("items", lambda x: x.cast("string"))))))
    hits = once.groupBy("doc_id", "text_hash").agg(F.array_sort(F.flatten(F.collect_set("places"))).alias("hits"), items.alias("items"))
    none = F.array().cast("array<struct<start:int,k:int>>"), F.array().cast("array<string>")
    hits = hits.toDF("i", "t", "hits", "items")
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t")), "left")
    return joined.select("doc_id", "text_hash", "n_words", F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items"))


def _windows_at(k: int) -> Column:
    starts = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(k).alias("k"), window_hash(F.slice("hw", i, k)).alias("h")))


def covered(hits: Column) -> Column:
    """Words inside any of the sorted ``hits``."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, h: Column) -> Column:
        stop = h["start"] + h["k"]
        fresh = F.greatest(F.lit(0), stop - F.greatest(h["start"], acc["end"]))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["end"], stop).alias("end"))

    return F.aggregate(hits, start, add, lambda acc: acc["n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns."""
    bad = find_hits(docs, benchmark, size).filter(F.size("hits") > 0).select("doc_id", "text_hash").distinct()
    return of_row(docs, bad, "left_anti")


def runs_of(found: DataFrame) -> DataFrame:
    """doc_id, text_hash and ``runs``: the hits of each row as disjoint runs of
    words (first, last), sorted."""
    rows = found.select("doc_id", "text_hash", "hits").dropDuplicates(["doc_id", "text_hash"])
    each = rows.select("doc_id", "text_hash", F.explode("hits").alias("h")).select("doc_id", "text_hash", F.col("h.start").alias("first"), (F.col("h.start") + F.col("h.k") - 1).alias("last"))
    row = Window.partitionBy("doc_id", "text_hash").orderBy("first", "last")
    before = F.max("last").over(row.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(before >= F.col("first") - 1, 0).otherwise(1)).over(row)
    merged = each.withColumn("run", run).groupBy("doc_id", "text_hash", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def cut_words(text: Column, runs: Column) -> Column:
    """The text without the words of the runs and what lies between them; each
    piece that is left keeps its letters, case and punctuation."""
    # text before the first word, then each word with what follows it; in the
    # original text, A-Z belong to words
    between = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lead = F.regexp_extract(text, rf"\A{between}", 0)
    words = F.regexp_extract_all(text, F.lit(rf"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+(?:{between})?"), F.lit(0))
    before = F.transform(runs, lambda r, i: F.coalesce(F.get(runs, i - 1)["last"], F.lit(0)))
    kept = F.transform(F.arrays_zip(before.alias("after"), runs["first"].alias("until")), lambda x: F.array_join(F.slice(words, x["after"] + 1, x["until"] - x["after"] - 1), ""))
    final = F.element_at(runs, -1)["last"]
    rest = F.array_join(F.slice(words, final + 1, F.greatest(F.size(words) - final, F.lit(0))), "")
    return F.concat(lead, F.array_join(kept, ""), rest)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """``docs`` with the words of every hit cut out of ``text``; all other
    text and the clean rows stay as they are."""
    (name,) = free(docs, "runs")
    runs = runs_of(find_hits(docs, benchmark, size).filter(F.size("hits") > 0)).withColumnRenamed("runs", name)
    left = cut_words(F.col("text"), F.col(name))
    return of_row(docs, runs, "left").withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(left)).select(*quoted(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = covered(F.col("hits"))
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha(F.array_join("items", ",")).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT item_id, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS window_
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS window_
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), hit AS (
  SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.window_ = bw.window_ AND dw.k = bw.k
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS ids FROM hit GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
