"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are 64-bit SimHashes of word shingles.  Bits that are correlated
over all distinct fingerprints are grouped into the same partition.  A
fingerprint spends its distance budget unevenly: with radius t and thresholds
t_1..t_m (-1: the partition is not probed), sum(t_i + 1) = t + 1 guarantees
that every neighbour agrees with it in some partition up to t_i bits; dynamic
programming picks the thresholds with the fewest estimated candidates, from
exact counts of partition values.  Probes meet the index by an equi-join, and
candidates are verified on all 64 bits.  How many partitions there are follows
from the number of distinct fingerprints: three of 21 or 22 bits need the
fewest probes, but beyond some 25 million fingerprints they give more
candidates than two of 32 bits.

Dense clusters would still give pairs as the square of their size.  A
fingerprint whose cheapest thresholds promise more candidates than it has
one-bit neighbours, and twice those of a fingerprint that lies nowhere near
others, is instead filed under each of those 65 neighbours: two
fingerprints differ in at most two bits exactly if they share one.  A key then
holds at most 65 fingerprints.  A pair with one side probing is found by that
side's probes, so no link is lost.  (This holds for radius 2; other radii
always probe.)

Links between distinct fingerprints become components by alternating large
and small stars, each round a few aggregations and joins.

Defined results: null and empty texts have fingerprint zero, linked like any
other; texts of fewer words than a shingle are one shingle; repeated rows give
repeated results; a null id is never the smallest.  An empty table gives an
empty result.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, of_row, table

SHINGLE, RADIUS = 3, 2
SEED = 42
#: Candidates beyond which one-bit neighbours are cheaper.
HUB = 65


def fingerprint(text: object, size: int = SHINGLE) -> int:
    """SimHash of A-Z lower-cased words, most significant bit first."""
    words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=">u8")
    set_ = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        set_ += np.unpackbits(h[at : at + 65536].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (signed 64-bit) of each row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(x, size) for x in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "fp": fp})

    given = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text", f"xxhash64(coalesce(`{text_col}`, '')) AS text_hash")
    return given.mapInPandas(work, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def bit_groups(distinct: DataFrame, parts: int) -> list[list[int]]:
    """Bits (0: least significant) in groups of near-equal size, correlated
    bits together.  The driver gets 2,080 sums whatever the table's size."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((64, 64), dtype=np.int64)
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy(np.int64).astype(">i8").view(np.uint8)).reshape(-1, 64)[:, ::-1].astype(np.float64)
            total += np.rint(bits.T @ bits).astype(np.int64)
        i, j = np.triu_indices(64)
        yield pd.DataFrame({"i": i, "j": j, "n": total[i, j]})

    sums = distinct.select("fp").mapInPandas(work, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    n = max(1, distinct.count())
    both = np.zeros((64, 64))
    for r in sums:
        both[r.i, r.j] = both[r.j, r.i] = r.n / n
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for k in range(parts):
        width = (64 - sum(map(len, groups))) // (parts - k)
        order = sorted(left)
        group = [max(order, key=lambda x: (corr[x, order].max(), -x))]
        left.remove(group[0])
        while len(group) < width:
            best = max(sorted(left), key=lambda x: (corr[x, group].mean(), -x))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def part_value(fp: Column, bits: list[int]) -> Column:
    """The bits of a group, packed; runs of adjacent bits move together."""
    out, k = F.lit(0).cast("long"), 0
    while k < len(bits):
        run = 1
        while k + run < len(bits) and bits[k + run] == bits[k] + run:
            run += 1
        piece = F.shiftrightunsigned(fp, bits[k]).bitwiseAND(F.lit((1 << run) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(piece, k))
        k += run
    return out


def allocate(counts: np.ndarray, widths: list[int], n: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (rows by partitions, -1: none) with the fewest estimated
    candidates, and that estimate.  counts: rows by partitions, how many
    fingerprints share the partition's value."""
    rows, m = counts.shape
    cost = np.full((m, radius + 2, rows), np.inf)  # by threshold + 1
    for i, w in enumerate(widths):
        cost[i, 0] = 0
        probes, near = 1.0, counts[:, i].astype(float)
        for t in range(radius + 1):
            if t:
                more = probes * (w - t + 1) / t if t > 1 else float(w)
                near, probes = near + more * n / 2.0**w, probes + more
            cost[i, t + 1] = near + probes
    best = np.full((radius + 2, rows), np.inf)
    best[0] = 0
    choice = np.zeros((m, radius + 2, rows), dtype=np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for total in range(radius + 2):
            for spend in range(total + 1):
                c = best[total - spend] + cost[i, spend]
                better = c < new[total]
                new[total][better] = c[better]
                choice[i, total][better] = spend
        best = new
    out, total = np.zeros((rows, m), dtype=np.int64), np.full(rows, radius + 1)
    for i in range(m - 1, -1, -1):
        spend = choice[i, total, np.arange(rows)]
        out[:, i] = spend - 1
        total = total - spend
    return out, best[radius + 1]


def widths_of(parts: int) -> list[int]:
    return [64 // parts + (i < 64 % parts) for i in range(parts)]


def spread_cost(n: int, parts: int, radius: int = RADIUS) -> float:
    """Estimated probes and candidates of a fingerprint among n random ones."""
    widths = widths_of(parts)
    return float(allocate(np.array([[1 + n / 2.0**w for w in widths]]), widths, n, radius)[1][0])


def parts_for(n: int, radius: int = RADIUS) -> int:
    """The number of partitions with the least estimate."""
    return min(range(1, radius + 3), key=lambda m: spread_cost(n, m, radius))


def _variants(value: Column, width: int, t: Column, radius: int) -> Column:
    """The value and all within t bits of it, for t up to ``radius``."""
    near = F.array(value)
    masks = [[0]]
    for d in range(1, radius + 1):
        masks.append(sorted({m | 1 << k for m in masks[-1] for k in range(width) if not m >> k & 1}))
    out = F.when(t == 0, near)
    for d in range(1, radius + 1):
        flat = F.array(*[F.lit(m).cast("long") for level in masks[: d + 1] for m in level])
        out = out.when(t == d, F.transform(flat, lambda m: value.bitwiseXOR(m)))
    return out


def find_links(fps: DataFrame, radius: int = RADIUS, parts: int | None = None, hub: int = HUB) -> DataFrame:
    """Links a < b between distinct fingerprints (column ``fp``) of at most
    ``radius`` differing bits: all of them, or, in dense clusters, enough to
    join the same fingerprints."""
    n = fps.count()
    parts = parts or parts_for(n, radius)
    groups = bit_groups(fps, parts)
    widths = [len(g) for g in groups]
    index = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), part_value(F.col("fp"), g).alias("value")) for i, g in enumerate(groups)])).alias("p")).select("fp", "p.part", "p.value")
    index = cut(index.repartition("part", "value"))
    shared = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = index.join(shared, ["part", "value"]).groupBy("fp").agg(*[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(parts)])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t, cost = allocate(b[[f"n{i}" for i in range(parts)]].to_numpy(np.int64), widths, n, radius)
            yield pd.DataFrame({"fp": b["fp"], **{f"t{i}": t[:, i] for i in range(parts)}, "cost": cost})

    planned = cut(counted.mapInPandas(work, "fp bigint, " + ", ".join(f"t{i} int" for i in range(parts)) + ", cost double"))
    dense = F.col("cost") > max(hub, 2 * spread_cost(n, parts, radius)) if radius == 2 else F.lit(False)

    def keyed(i: int, g: list[int]) -> Column:
        values = _variants(part_value(F.col("fp"), g), widths[i], F.col(f"t{i}"), radius)
        return F.transform(values, lambda v: F.struct(F.lit(i).alias("part"), v.alias("value")))

    spread = [keyed(i, g) for i, g in enumerate(groups)]
    none = F.array().cast("array<struct<part:int,value:bigint>>")
    probes = planned.filter(~dense).select("fp", F.explode(F.concat(*[F.coalesce(s, none) for s in spread])).alias("p")).select(F.col("fp").alias("q"), "p.part", "p.value")
    differ = F.bit_count(F.col("q").bitwiseXOR(F.col("fp")))
    pairs = probes.join(index, ["part", "value"]).filter((F.col("q") != F.col("fp")) & (differ <= radius)).select(F.least("q", "fp").alias("a"), F.greatest("q", "fp").alias("b"))

    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])
    keys = planned.filter(dense).select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
    hubs = keys.groupBy("key").agg(F.array_sort(F.collect_set("fp")).alias("in")).filter(F.size("in") > 1)
    stars = hubs.select(F.element_at("in", 1).alias("a"), F.explode(F.slice("in", F.lit(2), F.size("in"))).alias("b"))
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (smallest node reachable) of every node of links a < b."""
    links = cut(links)
    seen = None
    while True:
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", "a", "b")
        links = small.select(F.col("m").alias("a"), "b").union(small.filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        links = cut(links)
        now = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if now == seen:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select("a", "a").distinct())
        seen = now


def grouped(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and component_id (smallest doc_id reachable by links) of each
    fingerprint of ``rows`` (doc_id, fp)."""
    firsts = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(find_links(firsts, radius))
    own = firsts.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = own.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(ids, "root").select("fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp and component_id of each row."""
    rows = cut(fingerprints(docs, id_col, text_col, size))
    return rows.join(grouped(rows, radius), "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_first(docs: DataFrame, size: int = 5, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each group the
    one with the smallest doc_id, then text hash."""
    found = near_dedup(docs, size=size, radius=radius)
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    kept = found.groupBy("component_id").agg(F.min(own).alias("k")).select("k.doc_id", "k.text_hash")
    return of_row(docs, kept, "left_semi")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
