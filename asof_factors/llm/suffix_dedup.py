"""Suffix-array dedup: removes byte strings of ``LENGTH`` that occur elsewhere.

Column-wise construction (one symbol per document each round) takes as many
rounds as the longest document has bytes, so whole texts are first cut into
short pieces that keep every possible match together.  A string of LENGTH
bytes holds LENGTH - q + 1 strings of q bytes; the one with the least hash is
its anchor, the same wherever the string occurs.  Neighbouring strings with
one anchor form a piece of at most 2 LENGTH - q bytes, and equal strings lie
in pieces of equal anchors.  Pieces whose anchor occurs once are dropped;
identical pieces are counted and one of them is kept.

The distinct pieces of equal anchors are then a document collection.  Batches
of them, whole anchors at a time, are built column-wise: from the last column
to the first, each round inserts one symbol of every piece into the
collection's Burrows-Wheeler transform and updates the longest common
prefixes.  Pieces are aligned at their anchors, so equal strings start in the
same column and suffixes of different columns need never be ordered: the
transform is kept by columns, and a round reads the last column of the two
sequential files in the task's temporary folder and appends its own.  A suffix
of LENGTH bytes or more that shares LENGTH with a neighbour in its column
starts a repeated string.  (Keeping all columns in one transform gives the same
strings but moves the whole transform each round: see the README.)

An anchor with more than ``MOST`` distinct pieces (a passage shared by very
many documents) would fill one task; its pieces are anchored anew with a
longer q instead, until q is LENGTH, where pieces of one anchor are identical.

Most anchors occur once.  A bitmap of the hashes of the others, of a fixed size,
goes to the tasks, so that most pieces that no join would keep are never
shuffled; as it fills up it lets more pass, and an exact join follows.

Pieces that are alone under their anchor are not sorted: all copies of such a
piece are equal, so it is repeated from end to end.  The column files lie in
the task's own temporary folder; a task that is lost builds them again.

With ``passage``, repeated passages of more than PASSAGE_WORDS words are
counted besides, in a second run over strings of PASSAGE bytes: such passages
may be shorter than LENGTH bytes.

Defined results: null counts as empty; texts shorter than LENGTH keep all
bytes; repeated rows are each other's repeats; a null doc_id is an id like any
other.  An empty table gives an empty result.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, saved, table, text_hash

LENGTH = 400
#: Lengths of anchors, level by level.
ANCHORS = (128, 264, 332, 366, 383, 392, 396, 398, 399, 400)
#: A passage has more than so many words, and no fewer bytes than this.
PASSAGE_WORDS, PASSAGE = 50, 200
PASSAGE_ANCHORS = (64, 132, 166, 183, 192, 196, 198, 199, 200)
#: A sieve has 2 ** SIEVE bits (4 MB), whatever the table's size.
SIEVE = 25
#: Anchors or documents that are looked up by broadcast, at most (8 or 16 bytes each).
BROADCAST_ROWS = 1_000_000
#: Distinct pieces of one anchor that one task sorts, at most.
MOST = 8192
#: Pieces in a batch: no further anchor is added beyond it.
BATCH = 2048
#: A text is anchored in stretches of so many bytes.
STRETCH = 1 << 23

BASE = np.uint64(0x9E3779B97F4A7C15)
POSITION = np.uint64((1 << 24) - 1)


def _powers(n: int, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64."""
    if len(known.get("up", ())) < n:
        size = max(n, 1 << 17)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, x in (("up", BASE), ("down", inverse)):
            known[name] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x))), dtype=np.uint64)
    return known["up"], known["down"]


def pieces(data: bytes, q: int, known: dict[str, np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For each piece its anchor's hash, the first and last start of its
    strings, and the anchor's place after the first start."""
    n, width = len(data), length - q + 1
    if n < length:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    up, down = _powers(n + 1, known)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)))
    h = (total[q:] - total[:-q]) * down[: n - q + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    packed = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(packed) // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(packed)] = packed
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    anchor = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & POSITION).astype(np.int64)
    last = np.concatenate((np.flatnonzero(np.diff(anchor)), [m - 1]))
    first = np.concatenate(([0], last[:-1] + 1))
    return h[anchor[last]], first, last, anchor[last] - first


def all_pieces(data: bytes, q: int, known: dict[str, np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    if len(data) <= STRETCH:
        return pieces(data, q, known, length)
    out = []
    for at in range(0, len(data), STRETCH):
        key, first, last, place = pieces(data[at : at + STRETCH + length - 1], q, known, length)
        out.append((key, first + at, last + at, place))
    return tuple(np.concatenate(x) for x in zip(*out))


def sieve(keys: Column, rows: DataFrame) -> np.ndarray:
    """Bitmap of the long ``keys`` of ``rows``: at most 2 ** (SIEVE - 6) longs."""
    at = F.shiftrightunsigned(keys, 64 - SIEVE)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    words = rows.select(F.floor(at / 64).cast("int").alias("i"), bit.alias("bit")).groupBy("i").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE - 6), np.int64)
    out[words["i"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def passes(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - SIEVE)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def unpacked(docs: DataFrame) -> DataFrame:
    """u1, u2 (hashes of doc_id and text), n = 1 and the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64("doc_id").alias("u1"), F.xxhash64(text).alias("u2"), F.lit(1).cast("long").alias("n"), text.alias("data"))


def packed(docs: DataFrame) -> DataFrame:
    """The same with the text's bytes in zstd, so that shuffles are small."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            b["data"] = [squeeze(x.encode("utf-8", "replace")) for x in b["data"]]
            yield b

    return unpacked(docs).mapInPandas(work, "u1 bigint, u2 bigint, n bigint, data binary")


def _anchored(units: DataFrame, q: int, length: int, often: DataFrame) -> DataFrame:
    """u1, u2, n, key, seg, first, last, place of the pieces of ``units`` (u1,
    u2, n, data) whose anchor is in ``often``, and of a few others."""
    sent = units.sparkSession.sparkContext.broadcast(sieve(F.col("key"), often))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}
        digest, open_ = xxhash.xxh3_64_intdigest, zstandard.ZstdDecompressor().decompress
        for b in batches:
            parts = []
            for u1, u2, n, data in zip(b["u1"], b["u2"], b["n"], b["data"]):
                data = data.encode("utf-8", "replace") if isinstance(data, str) else open_(data)
                key, first, last, place = all_pieces(data, q, known, length)
                keep = passes(key, sent.value)
                key, first, last, place = key[keep], first[keep], last[keep], place[keep]
                if len(key):
                    seg = np.array([digest(data[x:y]) for x, y in zip(first.tolist(), (last + length).tolist())], dtype=np.uint64)
                    size = len(key)
                    parts.append((np.full(size, u1), np.full(size, u2), np.full(size, n), key.view(np.int64), seg.view(np.int64), first, last, place))
            for k in range(0, len(parts), 256):
                cols = [np.concatenate(x) for x in zip(*parts[k : k + 256])]
                yield pd.DataFrame(dict(zip(("u1", "u2", "n", "key", "seg", "first", "last", "place"), cols)))

    return units.mapInPandas(work, "u1 bigint, u2 bigint, n bigint, key bigint, seg bigint, first int, last int, place smallint")


def _counted(units: DataFrame, q: int, length: int) -> DataFrame:
    """key and n over all pieces, summed per batch before the shuffle."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}
        open_ = zstandard.ZstdDecompressor().decompress
        for b in batches:
            keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for n, data in zip(b["n"], b["data"]):
                key = all_pieces(data.encode("utf-8", "replace") if isinstance(data, str) else open_(data), q, known, length)[0]
                keys.append(key)
                counts.append(np.full(len(key), n))
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            yield pd.DataFrame({"key": key.view(np.int64), "n": np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)})

    return units.select("n", "data").mapInPandas(work, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class Columns:
    """The transform and the common prefixes, column after column, in two
    sequential files; a round reads the column before its own."""

    def __init__(self, folder: str):
        self.paths = [os.path.join(folder, x) for x in ("bwt", "lcp")]

    def __enter__(self) -> Columns:
        self.files = [open(p, "w+b") for p in self.paths]
        self.last = 0
        return self

    def __exit__(self, *_: object) -> None:
        for f in self.files:
            f.close()

    def append(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        for f, x in zip(self.files, (bwt, lcp)):
            f.write(x.tobytes())
        self.last = len(bwt)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for f, kind in zip(self.files, (np.uint8, np.int16)):
            f.seek(-self.last * np.dtype(kind).itemsize, os.SEEK_END)
            out.append(np.frombuffer(f.read(), kind))
        return tuple(out)


def repeated_starts(texts: list[bytes], places: list[int], length: int = LENGTH, folder: str | None = None) -> list[np.ndarray]:
    """For each text the starts of strings that another of the distinct texts
    has in the same column; ``places``: the column that all texts share.

    ``order`` holds the texts by their suffixes from the column on; a text that
    ends here comes first.  The transform's column is the symbol before each
    suffix (a byte plus one; no UTF-8 byte is 255), 0 if the text starts here.
    A round sorts it stably, which orders the suffixes one column to the left;
    neighbours of one symbol share one more than the least prefix between
    their old positions."""
    m, size, place = len(texts), np.array([len(t) for t in texts]), np.array(places)
    flat = np.frombuffer(b"\xff" + b"".join(texts), np.uint8) + np.uint8(1)  # 255 plus one is 0
    begin = np.cumsum(size) - size + 1 + place  # of column 0
    low, high = -place, size - place  # columns of each text
    out = [np.zeros(max(0, s - length + 1), bool) for s in size]
    joins: dict[int, list[int]] = {}
    for i in np.argsort(high, kind="stable").tolist():
        joins.setdefault(int(high[i]), []).append(i)
    order = np.zeros(0, np.int64)
    with tempfile.TemporaryDirectory(dir=folder) as inside, Columns(inside) as columns:
        columns.append(np.zeros(0, np.uint8), np.zeros(0, np.int16))
        for x in range(int(high.max(initial=0)), int(low.min(initial=0)) - 1, -1):
            bwt, lcp = columns.read()  # of column x + 1, whose symbols are those of x
            if len(order):
                live = np.flatnonzero(bwt)
                if len(live) < len(order):  # texts that started at x + 1 leave
                    if len(live):
                        lcp = np.minimum.reduceat(lcp[: live[-1] + 1], np.concatenate(([0], live[:-1] + 1)))
                    order, bwt = order[live], bwt[live]
                if len(order):
                    by = np.argsort(bwt, kind="stable")
                    same = np.flatnonzero(bwt[by[1:]] == bwt[by[:-1]]) + 1
                    fresh = np.zeros(len(by), np.int16)
                    if len(same):
                        ends = np.stack((by[same - 1] + 1, by[same] + 1), 1).ravel()
                        fresh[same] = 1 + np.minimum.reduceat(np.append(lcp, np.int16(0)), ends)[::2]
                    order, lcp = order[by], fresh
                else:
                    lcp = np.zeros(0, np.int16)
                near = np.append(lcp >= length, False)
                for i in order[near[:-1] | near[1:]].tolist():
                    out[i][x - low[i]] = True
            if x in joins:
                new = joins[x]
                order = np.concatenate((np.array(new), order))
                lcp = np.concatenate((np.zeros(len(new), np.int16), lcp if len(lcp) else np.zeros(0, np.int16)))
            columns.append(np.where(low[order] < x, flat[begin[order] + x - 1], 0).astype(np.uint8), lcp.astype(np.int16))
    return [np.flatnonzero(o) for o in out]


def runs_of(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte ranges that the strings at sorted ``starts`` cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate(([0], gap + 1))].tolist(), (starts[np.concatenate((gap, [len(starts) - 1]))] + length).tolist()))


def _sorted(content: DataFrame, length: int) -> DataFrame:
    """key, seg and ranges (start, stop in the piece) of pieces (key, seg, n, place, data)."""

    def solve(batch: dict[tuple[int, int], tuple[int, int, bytes]]) -> pd.DataFrame:
        ids, rows = list(batch), list(batch.values())
        found = repeated_starts([d for _, _, d in rows], [p for _, p, _ in rows], length)
        found = [np.arange(len(d) - length + 1) if n > 1 else f for (n, _, d), f in zip(rows, found)]
        ranges = [[{"start": a, "stop": b} for a, b in runs_of(f, length)] for f in found]
        return pd.DataFrame({"key": [k for k, _ in ids], "seg": [s for _, s in ids], "ranges": ranges})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], tuple[int, int, bytes]] = {}
        now = None
        for b in batches:
            for key, seg, n, place, data in zip(b["key"], b["seg"], b["n"], b["place"], b["data"]):
                if key != now and len(held) >= BATCH:
                    yield solve(held)
                    held = {}
                now = key
                held[key, seg] = (n, place, bytes(data))
        if held:
            yield solve(held)

    dealt = content.select("key", "seg", "n", "place", "data").repartition("key").sortWithinPartitions("key", "seg")
    return dealt.mapInPandas(work, "key bigint, seg bigint, ranges array<struct<start:int,stop:int>>")


def _fetched(reps: DataFrame, units: DataFrame, length: int, squeezed: bool = False) -> DataFrame:
    """key, seg, n, place, data of pieces (key, seg, n, place, u1, u2, first, last)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor().compress
        for b in batches:
            rows = []
            for data, wanted in zip(b["data"], b["wanted"]):
                data = open_(data)
                for w in wanted:
                    piece = data[w["first"] : w["last"] + length]
                    rows.append((w["key"], w["seg"], w["n"], w["place"], squeeze(piece) if squeezed else piece))
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=["key", "seg", "n", "place", "data"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["key", "seg", "n", "place", "data"])

    wanted = cut(reps.groupBy("u1", "u2").agg(F.collect_list(F.struct("key", "seg", "n", "place", "first", "last")).alias("wanted")))
    units = units.join(_small(wanted.select("u1", "u2")), ["u1", "u2"], "left_semi")
    return units.select("u1", "u2", "data").join(wanted, ["u1", "u2"]).select("data", "wanted").mapInPandas(work, "key bigint, seg bigint, n bigint, place int, data binary")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _repeats(source: DataFrame, units: DataFrame, level: int, length: int, anchors: tuple[int, ...], most: int) -> DataFrame:
    """u1, u2, start, stop of repeated byte ranges of ``units``; ``source``
    holds the same, packed or not."""
    q = anchors[level]
    # cut, so that both sides of the join are dealt anew and hot anchors can be split
    often = cut(_counted(source, q, length).filter("n > 1").select("key"))
    held = cut(_anchored(source, q, length, often).join(often, "key"))
    kinds = cut(held.groupBy("key", "seg").agg(F.sum("n").alias("n"), F.min(F.struct("u1", "u2", "first", "last", "place")).alias("rep")).select("key", "seg", "n", "rep.*"))
    several = _small(cut(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")))
    # a piece that is alone under its anchor equals all its copies
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.col("last") - F.col("first") + length).cast("int").alias("stop")))
    alone = kinds.join(several, "key", "left_anti").select("key", "seg", whole.alias("ranges"))
    mixed = cut(kinds.join(several, "key"))
    ranges = alone.unionByName(_sorted(_fetched(mixed.filter(F.col("kinds") <= most), units, length), length))
    dense = mixed.filter(F.col("kinds") > most)
    if level + 1 < len(anchors) and not dense.isEmpty():
        below = saved(_fetched(dense, units, length, True).dropDuplicates(["key", "seg"]).select(F.col("key").alias("u1"), F.col("seg").alias("u2"), "n", "data"))
        deeper = _repeats(below, below, level + 1, length, anchors, most)
        ranges = ranges.unionByName(saved(deeper).groupBy("u1", "u2").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("ranges")).select(F.col("u1").alias("key"), F.col("u2").alias("seg"), "ranges"))
    told = held.join(ranges, ["key", "seg"]).select("u1", "u2", "first", F.explode("ranges").alias("r"))
    return told.select("u1", "u2", (F.col("first") + F.col("r.start")).alias("start"), (F.col("first") + F.col("r.stop")).alias("stop"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, anchors: tuple[int, ...] = ANCHORS, most: int = MOST) -> DataFrame:
    """u1, u2 (hashes of doc_id and text) and the sorted ranges (start, stop
    in bytes; they may touch or overlap) that repeat, of rows that have any."""
    found = _repeats(unpacked(docs), packed(docs), 0, length, anchors, most)
    return found.groupBy("u1", "u2").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("ranges"))


def merged(ranges: object) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in ranges if ranges is not None else ():
        if out and r["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["stop"])
        else:
            out.append([r["start"], r["stop"]])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchors: tuple[int, ...] = ANCHORS, most: int = MOST, with_kept: bool = True, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (start, stop), kept_sha256, the kept bytes if
    ``with_kept``, and if ``passage`` is given, ``passages``: the runs (start,
    stop) of more than PASSAGE_WORDS words that repeat in strings of so many
    bytes, of each row."""
    ranges = repeated_ranges(docs, length, anchors, most)
    if passage:
        more = repeated_ranges(docs, passage, PASSAGE_ANCHORS if passage == PASSAGE else (passage,), most)
        ranges = ranges.join(more.withColumnRenamed("ranges", "more"), ["u1", "u2"], "full")
    else:
        ranges = ranges.withColumn("more", F.lit(None).cast("array<struct<start:int,stop:int>>"))
    ranges = cut(ranges)
    mixed = F.xxhash64("u1", "u2")
    sent = docs.sparkSession.sparkContext.broadcast(sieve(mixed, ranges))
    ids = docs.select("doc_id", F.xxhash64("doc_id").alias("u1"), text_hash().alias("u2"), F.coalesce("text", F.lit("")).alias("data")).withColumn("mixed", mixed)
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:int,stop:int>>"
    result = f"n_bytes bigint, spans {spans}, kept_sha256 string, kept binary, passages {spans}"
    names = ["n_bytes", "spans", "kept_sha256", "kept", "passages"]

    def solved(data: bytes, found: object, more: object) -> tuple:
        named = lambda spans: [{"start": x, "stop": y} for x, y in spans]
        spans = merged(found)
        kept, at = [], 0
        for x, y in spans:
            kept.append(data[at:x])
            at = y
        left = b"".join([*kept, data[at:]])
        long = [(x, y) for x, y in merged(more) if whole_words(data, x, y) > PASSAGE_WORDS]
        return len(data), named(spans), hashlib.sha256(left).hexdigest(), left if with_kept else None, named(long)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows that surely have no ranges are done; texts of others are packed."""
        small = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            meets = passes(b["mixed"].to_numpy(np.int64).view(np.uint64), sent.value)
            rows = []
            for x, m in zip(b["data"], meets):
                x = x.encode("utf-8", "replace")
                rows.append((small(x), None, None, None, None, None) if m else (None, *solved(x, None, None)))
            out = pd.DataFrame(rows, columns=["data", *names])
            out["n_bytes"] = out["n_bytes"].astype("Int64")
            for k, c in enumerate(("doc_id", "u1", "u2")):
                out.insert(k, c, b[c].array)
            yield out

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = pd.DataFrame([solved(open_(data), found, more) for data, found, more in zip(b["data"], b["ranges"], b["more"])], columns=names)
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    # read twice below, and dealt out by its text only where it may have ranges
    begun = cut(ids.mapInPandas(first, f"doc_id {kind}, u1 bigint, u2 bigint, data binary, {result}"))
    joined = begun.filter("data IS NOT NULL").join(ranges, ["u1", "u2"], "left").select("doc_id", "data", "ranges", "more")
    return begun.filter("data IS NULL").select("doc_id", *names).unionByName(joined.mapInPandas(work, f"doc_id {kind}, {result}"))


def whole_words(data: bytes, start: int, stop: int) -> int:
    """Words of a text that lie in a range as a whole."""
    words = len(data[start:stop].split())
    cut_first = start > 0 and not data[start - 1 : start].isspace() and not data[start : start + 1].isspace()
    cut_last = stop < len(data) and not data[stop : stop + 1].isspace() and not data[stop - 1 : stop].isspace()
    return words - cut_first - cut_last


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"), with_kept=False, passage=PASSAGE)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["stop"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", F.size("passages").cast("long").alias("n_passages"))
