"""Alignment of two tokenizers' tokens by lockstep vectorised merging.

Tokenizer A is a byte-level BPE, B a SentencePiece model; both cover a space
and the text.  All documents of a batch advance together: one NumPy state
vector holds each document's pointers into its A and B tokens, and each step
moves the pointer whose token ends first, or both where they end together.
There the group of tokens is cut and emitted with its links, all its A-B
pairs, and documents at their end leave the vector.

Both tokenizers read each distinct stretch from a space to the next once per
task.  That gives the ids of the whole text where no two tokens of white space
meet at the space; other texts are encoded whole.  As tokens of both sides end
with a stretch, a long document takes several places in the state vector, each
from the start of a stretch.

How many documents hold an id pair linked is counted over the whole corpus as
a Spark aggregation; each document's links then meet the counts in a join,
by broadcast where the counts are few.

Defined results: null and empty texts, and texts that one of the tokenizers
does not give back byte by byte (U+2581 reads as a space in B), have no
tokens: zeros and no hash.  Repeated rows give repeated results and each
counts as a document.  An empty table gives an empty result.  Other columns
play no part.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: Where the vocabularies lie, unless the session's settings name other paths;
#: read on the driver only and sent along (3 MB).
SETTING_A, SETTING_B = "spark.asof_factors.alignment.a", "spark.asof_factors.alignment.b"
PATH_A, PATH_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: How a byte-level BPE of this kind splits texts before merging (a fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a stretch from which on merging is left to the vocabulary's own library.
LONG = 1000
#: Characters of a batch of documents that advance together.
BATCH_CHARS = 750_000
#: A task forgets its stretches beyond so many tokens, to bound its memory.
CACHE_TOKENS = 3_000_000
#: Tokens of a document for one place in the state vector, about.
PLACE = 512
#: Groups with more links are counted by distinct ids; links are made for so
#: many groups at once.
WIDE, GROUPS = 4096, 65_536
#: Pair counts that are looked up by broadcast, at most (16 bytes each).
BROADCAST_PAIRS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for:
    printable Latin-1 characters are themselves, the others follow U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, each with the bytes of its ids."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.quick = Tokenizer.from_str(a), None
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters, words = byte_letters(), self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for w, i in words.items():
            self.bytes_a[i] = bytes(map(letters.__getitem__, w)) if all(c in letters for c in w) else w.encode()
        # where ids are merge ranks, another library gives the same ids four times as fast
        model = json.loads(a)["model"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if [words.get(m.replace(" ", "")) for m in merges] == list(range(256, 256 + len(merges))):
            import tiktoken

            self.quick = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a[: 256 + len(merges)])}, special_tokens={}).encode_ordinary
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        # whether every stretch between spaces can be encoded for itself
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces)

    @staticmethod
    def read(a: str, b: str) -> tuple[str, bytes]:
        with open(a, encoding="utf-8") as f, open(b, "rb") as g:
            return f.read(), g.read()

    def encode(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For A and B the joined ids of a space and each text and how many
        each has, and whether both give it back."""
        texts_a = [" " + t for t in texts]
        whole = [t.encode() for t in texts_a]
        lengths, every = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole)), b"".join(whole)
        if self.quick and lengths.max(initial=0) < LONG:
            a = [self.quick(t) for t in texts_a]
        else:
            a = [e.ids for e in self.a.encode_batch_fast(texts_a, add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        out, same = [], np.ones(len(texts), dtype=np.int8)
        for ids, size, known in ((a, self.size_a, self.bytes_a), (b, self.size_b, self.bytes_b)):
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = list(chain.from_iterable(ids))
            out.append((np.array(flat, dtype=np.int32), n))
            # lengths of all texts and the joined bytes; each text only where these differ
            ends = np.concatenate(([0], np.cumsum(size[out[-1][0]])))[np.concatenate(([0], np.cumsum(n)))]
            if not np.array_equal(np.diff(ends), lengths) or b"".join(map(known.__getitem__, flat)) != every:
                same &= np.array([b"".join(map(known.__getitem__, x)) == w for x, w in zip(ids, whole)], dtype=np.int8)
        return out, same


class Stretches:
    """Ids of stretches of text, each encoded once; arrays grow side by side."""

    #: Spaces, besides double ones and those at the ends, at which a text
    #: cannot be split.
    together = re.compile(r"\s \s")

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        # ids as they stand in a document's groups, before and after the last of a group
        sides = ((len(tokenizers.bytes_a), b",|"), (len(tokenizers.bytes_b), b",;"))
        self.words = tuple(np.array([b"%d%c" % (i, sign) for i in range(n)], dtype=object) for n, signs in sides for sign in signs)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.ends, self.same = (array("i"), array("i")), (array("q", [0]), array("q", [0])), array("b")

    def split(self, text: str) -> list[str]:
        # printable texts have no white space but spaces
        whole = "  " in text or text[:1] == " " or text[-1:] == " " or not text.isprintable() and self.together.search(text)
        return [text] if whole or not self.tokenizers.apart else text.split(" ")

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the texts' stretches, and how many each text has."""
        if len(self.flat[0]) + len(self.flat[1]) > CACHE_TOKENS:
            self.clear()
        split = [self.split(t) for t in texts]
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        words = list(chain.from_iterable(split))
        found = list(map(self.index.get, words))
        fresh = list({w for w, k in zip(words, found) if k is None}) if None in found else []
        for at in range(0, len(fresh), 8192):
            part = fresh[at : at + 8192]
            ids_n, same = self.tokenizers.encode(part)
            self.index.update(zip(part, range(len(self.same), len(self.same) + len(part))))
            self.same.frombytes(same.tobytes())
            for flat, ends, (ids, many) in zip(self.flat, self.ends, ids_n):
                ends.frombytes((len(flat) + np.cumsum(many)).tobytes())
                flat.frombytes(ids.tobytes())
        found = map(self.index.__getitem__, words) if fresh else found
        return np.fromiter(found, dtype=np.int64, count=len(words)), n

    def ids(self, side: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined ids of stretches, and how many each has."""
        ends = np.frombuffer(self.ends[side].tobytes(), dtype=np.int64)
        n = ends[which + 1] - ends[which]
        return np.frombuffer(self.flat[side].tobytes(), dtype=np.int32)[spread(ends[which], n)].astype(np.int64), n


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of n numbers."""
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, last_a: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """At each step the groups that end in it: place, first and last A token,
    first and last B token.  The places' tokens lie one after the other in
    both sequences of end offsets; no place is empty."""
    place, a, b, last = np.arange(len(first_a)), first_a.copy(), first_b.copy(), last_a
    from_a, from_b = a.copy(), b.copy()
    while len(place):
        x, y = ends_a[a], ends_b[b]
        cut = x == y
        if cut.any():
            yield place[cut], from_a[cut], a[cut], from_b[cut], b[cut]
        left = ~cut | (a < last)
        a += x <= y
        b += y <= x
        np.copyto(from_a, a, where=cut)
        np.copyto(from_b, b, where=cut)
        if not left.all():
            place, a, b, last, from_a, from_b = (v[left] for v in (place, a, b, last, from_a, from_b))


def links(groups: tuple[np.ndarray, ...], ids_a: np.ndarray, ids_b: np.ndarray, wide: int = WIDE) -> Iterator[tuple[np.ndarray, ...]]:
    """Place, A id, B id and number of the links of the groups."""
    place, a, last_a, b, last_b = groups
    na, nb = last_a - a + 1, last_b - b + 1
    n = na * nb
    for k in np.flatnonzero(n > wide):
        xs, cx = np.unique(ids_a[a[k] : last_a[k] + 1], return_counts=True)
        ys, cy = np.unique(ids_b[b[k] : last_b[k] + 1], return_counts=True)
        yield np.full(len(xs) * len(ys), place[k]), np.repeat(xs, len(ys)), np.tile(ys, len(xs)), np.outer(cx, cy).ravel()
    if (n > wide).any():
        place, a, b, nb, n = (v[n <= wide] for v in (place, a, b, nb, n))
    if (n > 1).any():
        at = spread(np.zeros_like(n), n)
        nb = np.repeat(nb, n)
        place, a, b = np.repeat(place, n), np.repeat(a, n) + at // nb, np.repeat(b, n) + at % nb
    yield place, ids_a[a], ids_b[b], np.ones(len(a), dtype=np.int64)


def joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts))


def digests(groups: tuple[np.ndarray, ...], ids_a: np.ndarray, ids_b: np.ndarray, bounds: np.ndarray, words: tuple[np.ndarray, ...]) -> list[str]:
    """Hash of each document's groups; ``groups`` in order of the text,
    ``bounds`` in the sequence of both sides' tokens."""
    _, a, last_a, b, last_b = groups
    comma_a, bar_a, comma_b, semi_b = words
    text = np.empty(len(ids_a) + len(ids_b), dtype=object)
    at_a = np.arange(len(ids_a)) + np.repeat(b, last_a - a + 1)
    at_b = np.arange(len(ids_b)) + np.repeat(last_a + 1, last_b - b + 1)
    text[at_a], text[at_b] = comma_a[ids_a], comma_b[ids_b]
    text[at_a[last_a]], text[at_b[last_b]] = bar_a[ids_a[last_a]], semi_b[ids_b[last_b]]
    return [hashlib.sha256(b"".join(text[x:y])[:-1]).hexdigest() for x, y in zip(bounds[:-1], bounds[1:])]


def align(texts: list[str], stretches: Stretches) -> dict[str, list]:
    """Columns n_a, n_b, n_groups, n_links, groups_sha256, pairs, times."""
    tokenizers = stretches.tokenizers
    size_a, size_b = len(tokenizers.bytes_a), len(tokenizers.bytes_b)
    every, n = stretches(texts)
    text_of = np.repeat(np.arange(len(texts)), n)
    bad = np.bincount(text_of, weights=np.frombuffer(stretches.same, dtype=np.int8)[every] == 0, minlength=len(texts)) > 0
    good = ~bad & np.array([t != "" for t in texts])
    out = {"n_a": np.zeros(len(texts), dtype=np.int64), "n_b": np.zeros(len(texts), dtype=np.int64), "n_groups": np.zeros(len(texts), dtype=np.int64), "n_links": np.zeros(len(texts), dtype=np.int64)}
    empty = np.array([], dtype=np.int64)
    hashes, pairs, times = [""] * len(texts), [empty] * len(texts), [empty.astype(np.int32)] * len(texts)
    if good.any():
        every, text_of = every[good[text_of]], (np.cumsum(good) - 1)[text_of[good[text_of]]]
        docs = np.flatnonzero(good)
        (ids_a, len_a), (ids_b, len_b) = stretches.ids(0, every), stretches.ids(1, every)
        n_a, n_b = (np.bincount(text_of, weights=x, minlength=len(docs)).astype(np.int64) for x in (len_a, len_b))
        # places in the state vector: each document from every PLACE-th token on
        ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
        at = (ends_a - len_a - (np.cumsum(n_a) - n_a)[text_of]) // PLACE
        new = np.flatnonzero(np.concatenate(([True], (np.diff(text_of) != 0) | (np.diff(at) != 0))))
        first_a, first_b = (ends_a - len_a)[new], (ends_b - len_b)[new]
        doc_of = text_of[new]
        found, linked, waiting, many = [], [], [], 0
        for step in lockstep(np.cumsum(tokenizers.size_a[ids_a]), np.cumsum(tokenizers.size_b[ids_b]), first_a, first_b, np.append(first_a[1:], len(ids_a)) - 1):
            waiting.append(step)
            many += len(step[0])
            if many > GROUPS:
                found.append(joined(waiting))
                linked += links(found[-1], ids_a, ids_b)
                waiting, many = [], 0
        if waiting:
            found.append(joined(waiting))
            linked += links(found[-1], ids_a, ids_b)
        groups = joined(found)
        order = np.full(len(ids_a), -1)
        order[groups[2]] = np.arange(len(groups[2]))
        groups = tuple(x[order[order >= 0]] for x in groups)
        for d, h in zip(docs, digests(groups, ids_a, ids_b, np.concatenate(([0], np.cumsum(n_a + n_b))), stretches.words)):
            hashes[d] = h
        place, x, y, many = joined(linked)
        key = (doc_of[place] * size_a + x) * size_b + y
        if many.max() == 1:
            key, many = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key)
            key, starts = np.unique(key[order], return_index=True)
            many = np.add.reduceat(many[order], starts)
        doc, key = key // (size_a * size_b), key % (size_a * size_b)
        bounds = np.searchsorted(doc, np.arange(len(docs) + 1))
        for k, d in enumerate(docs):
            pairs[d], times[d] = key[bounds[k] : bounds[k + 1]], many[bounds[k] : bounds[k + 1]].astype(np.int32)
        out["n_a"][docs], out["n_b"][docs] = n_a, n_b
        out["n_groups"][docs] = np.bincount(doc_of[groups[0]], minlength=len(docs))
        out["n_links"][docs] = np.add.reduceat(many, bounds[:-1])
    return {**out, "groups_sha256": hashes, "pairs": pairs, "times": times}


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct
    linked id pairs of each document: pairs (A id times the size of B, plus B
    id) and times (links of each)."""
    conf = docs.sparkSession.conf
    sent = docs.sparkSession.sparkContext.broadcast(Tokenizers.read(a or conf.get(SETTING_A, PATH_A), b or conf.get(SETTING_B, PATH_B)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # its rounds over millions of strings would take a fifth of the time; no cycles arise
        stretches = Stretches(Tokenizers(*sent.value))
        for given in batches:
            texts = [x if isinstance(x, str) else "" for x in given["text"]]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            while order:
                size, part = 0, []
                while order and (not part or size + len(texts[order[-1]]) <= BATCH_CHARS):
                    size += len(texts[order[-1]])
                    part.append(order.pop())
                yield pd.DataFrame({"doc_id": given["doc_id"].iloc[part].array, **align([texts[i] for i in part], stretches)})

    given = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return given.mapInPandas(work, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, documents that hold it linked, and whether no other pair of its A
    id is in more documents."""
    counts = saved(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")))
    a = F.floor(F.col("pair") / size_b).alias("a")
    highest = counts.groupBy(a).agg(F.max("n_docs").alias("highest"))
    return counts.select("pair", "n_docs", a).join(highest, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))


def cross_alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None, broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    session = docs.sparkSession
    b = b or session.conf.get(SETTING_B, PATH_B)
    size_b = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    aligned = saved(align_documents(docs, id_col, text_col, a, b).withColumn("row", F.monotonically_increasing_id()))
    counts = saved(pair_counts(aligned, size_b))
    known = F.broadcast(counts) if counts.count() <= broadcast else counts
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.times")
    sums = each.join(known, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("bigint").alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).cast("bigint").alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return aligned.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_alignment(table(spark, sf_dir, "documents"))
