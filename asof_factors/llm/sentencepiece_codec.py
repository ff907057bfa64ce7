"""SentencePiece encoding and decoding by a Viterbi pass over shared prefixes.

White space becomes the mark U+2581 and the marked text is cut where no piece
of the vocabulary crosses.  Each batch sorts its distinct marked words, which
is a trie in depth-first order: a word keeps the forward states of the prefix
it shares with the word before and extends them to its own end, where the
best path is read off backwards.

The public vocabulary at hand is of the merge kind (BPE with byte fallback),
so a path's score is that of its merges: a last piece is reachable after a
prefix's best last piece exactly if merging the two pieces' characters gives
them back, all other paths score minus infinity, and one survives.  Plain
sums of piece scores would give other segmentations than the vocabulary's
own library; this gives the same ids.

Defined results: null counts as empty; an empty text has no pieces; characters
outside the vocabulary become byte pieces; repeated rows give repeated
results; an empty table gives an empty result.  Other columns play no part.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Where the vocabulary lies, unless the session's SETTING names another path;
#: read on the driver only and sent along as plain tables (3 MB).
SETTING = "spark.asof_factors.sentencepiece.model"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A task forgets its words beyond so many, to bound its memory.
CACHE_WORDS = 1_000_000
#: Texts that a task takes out of an Arrow batch at once.
TEXTS = 512


class Vocabulary:
    """Pieces with merge ranks, and which pairs of them may stand side by side."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_from: int, special: set[int]):
        self.pieces, self.bytes_from = pieces, bytes_from
        own = range(bytes_from, bytes_from + 256)
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special and i not in own}
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.encoded = [bytes([i - bytes_from]) if i in own else p.encode() for i, p in enumerate(pieces)]
        self.fits: dict[int, bool] = {}
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            lengths.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: (*sorted(v - {1}, reverse=True), 1) for k, v in lengths.items()}
        self.whole = {i for p, i in self.ids.items() if self.merge(p) == [p]}
        # letters by the pattern below that some piece joins to other characters
        letter = re.compile(r"[^\W\d_]").match
        odd = {c for p in self.ids for a, b in zip(p, p[1:]) if a != MARK and bool(letter(a)) != bool(letter(b)) for c in (a, b) if letter(c)}
        odd = re.escape("".join(sorted(odd)))
        self.words = re.compile(rf"{MARK}*[^\W\d_{odd}]+|{MARK}*(?:[^\w{MARK}]|[_{odd}])+|{MARK}+|\d|.", re.S)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(p.get_piece_size())
        first = next(i for i in n if p.is_byte(i))
        return cls([p.id_to_piece(i) for i in n], [p.get_score(i) for i in n], first, {i for i in n if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)})

    @classmethod
    def of(cls, tables: dict[str, object]) -> Vocabulary:
        """From ``vars`` of another one."""
        new = cls.__new__(cls)
        new.__dict__.update(tables, fits={})
        return new

    def merge(self, text: str) -> list[str]:
        """Merge characters, the best rank first and leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, float("inf")), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pair(self, a: int, b: int) -> bool:
        """Whether merging the characters of two pieces gives the two back:
        no merge crosses from one to the other before both are whole."""
        key = a * len(self.pieces) + b
        if (known := self.fits.get(key)) is None:
            left, none, rank = self.pieces[a], float("inf"), self.rank.get
            parts = [*left, *self.pieces[b]]
            ranks = [rank(x + y, none) for x, y in zip(parts, parts[1:])]
            border, known = len(left) - 1, True
            while (best := min(ranks)) < none:
                k = ranks.index(best)
                if k == border:
                    known = False
                    break
                border -= k < border
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del ranks[k]
                if k:
                    ranks[k - 1] = rank(parts[k - 1] + parts[k], none)
                if k < len(ranks):
                    ranks[k] = rank(parts[k] + parts[k + 1], none)
            self.fits[key] = known
        return known

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of sorted distinct words, depth-first through their trie."""
        out: dict[str, list[int]] = {}
        # of each prefix: id and size of its last piece; id -1: bytes
        last, sizes, before = [-1], [0], ""
        ids, lengths, whole, fits, width, one = self.ids.get, self.lengths.get, self.whole, self.fits.get, len(self.pieces), (1,)
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], sizes[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for size in lengths(word[end - 2 : end], one) if end > 1 else one:
                    start = end - size
                    if start < 0 or (piece := ids(word[start:end])) is None:
                        continue
                    if start == 0:
                        good = piece in whole
                    elif (left := last[start]) < 0:
                        good = True
                    elif (good := fits(left * width + piece)) is None:
                        good = self.pair(left, piece)
                    if good:
                        last.append(piece)
                        sizes.append(size)
                        break
                else:
                    last.append(-1)
                    sizes.append(1)
            path, end = [], len(word)
            while end:
                if (piece := last[end]) < 0:
                    path.extend(self.bytes_from + b for b in reversed(word[end - 1].encode()))
                else:
                    path.append(piece)
                end -= sizes[end]
            path.reverse()
            out[word] = path
            before = word
        return out

    def split(self, text: str) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def marked(self, ids: list[int]) -> bytes:
        """The marked text that ``ids`` stand for."""
        return b"".join(map(self.encoded.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text that ``ids`` came from."""
        return self.marked(ids).decode("utf-8", "replace").replace(MARK, " ")[1:]


class Encoder:
    """Encodes batch after batch and remembers words, as packed ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.cache = vocabulary, {}

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids of each text, and the text that they decode to."""
        split = [self.vocabulary.split(t) for t in texts]
        words = set(chain.from_iterable(split))
        fresh = words.difference(self.cache)
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache, fresh = {}, words
        self.cache |= {w: array("i", ids).tobytes() for w, ids in self.vocabulary.encode_words(sorted(fresh)).items()}
        found = [np.frombuffer(b"".join(map(self.cache.__getitem__, ws)), dtype=np.int32) for ws in split]
        return found, [self.vocabulary.decode(ids.tolist()) for ids in found]


def model_of(spark: SparkSession) -> str:
    return spark.conf.get(SETTING, MODEL)


def clean(x: object) -> str:
    return x if isinstance(x, str) else ""


def encoded(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """doc_id, ids, same and round_trip of a batch of doc_id and text.  Only
    TEXTS texts at once become Python strings; the others stay in Arrow."""
    for k in range(0, batch.num_rows, TEXTS):
        part = batch.slice(k, TEXTS)
        texts = [clean(x) for x in part.column("text").to_pylist()]
        ids, back = encoder(texts)
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
        same = pa.array([d == t.replace(MARK, " ") for d, t in zip(back, texts)])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, same, pa.array([d == t for d, t in zip(back, texts)])], ["doc_id", "ids", "same", "round_trip"])


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, ids, ``same`` (whether they decode to the text with its marks
    U+2581 read as spaces) and ``round_trip`` (whether to the text itself)."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary.load(model or model_of(docs.sparkSession))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.of(sent.value))
        for b in batches:
            yield from encoded(encoder, b)

    given = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return given.mapInArrow(work, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, ids array<int>, same boolean, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(vars(Vocabulary.load(model or model_of(encoded.sparkSession))))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary.of(sent.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [vocabulary.decode([] if i is None else list(i)) for i in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(work, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the comma-joined ids), round_trip."""
    done = encode_documents(table(spark, sf_dir, "documents"))
    return done.selectExpr("doc_id", "CAST(size(ids) AS bigint) AS n_pieces", "sha2(array_join(transform(ids, x -> CAST(x AS string)), ','), 256) AS ids_sha256", "round_trip")
