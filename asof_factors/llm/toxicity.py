"""Toxicity scores of deobfuscated text.

One pass over the documents counts words, and so the character trigrams of all
letters there are (the model grows with the corpus), and gathers the tokens
that look disguised: signs or digits among letters or at either end of them,
signs and digits alone, letters repeated three times or more, letters spaced
out one by one.  Each distinct token becomes a lattice: a sign offers the
letters it may stand for, a run of one letter may be one, two or all of them,
and each gap of a spaced-out run may close or stay a space.  The trigram counts
that its arcs need are joined to it, and Viterbi decoding finds the path of
the least channel cost and model cost, at whatever length.  A trigram that was
seen seldom falls back on how often its last letter occurs.

The restored words are scored with the words of the text: stems (whole words
and prefixes of four to six letters) whose presence speaks for label 1.
Their log-odds are learned from a bounded sample of labelled rows (``SAMPLE``
rows, those of the smallest hashes of their ids), near copies once: rows
that share a minimal shingle hash count as one.

Defined results: null and empty texts have the score of a text without any
stem; rows without an id are never learned from nor held out; repeated rows
give repeated results; several labels of a document count each; without
labelled rows every score is the prior of one half, below the threshold only
if labels say so.  An empty table gives an empty result.  Columns other than
doc_id and text play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, of_row, table, text_hash

#: Labelled rows that stems are learned from, at most.
SAMPLE = 30_000
#: Stems: rows of label 1 that hold it, least log-odds.
LEAST_ROWS, LEAST_ODDS = 5, 4.2
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
#: Rows (token or key of a document) that are looked up by broadcast, at most.
BROADCAST_ROWS = 500_000
#: Distinct words, and stems, that a task holds before it hands their counts on.
WORDS_HELD, STEMS_HELD = 100_000, 400_000

# What a sign may stand for, and what a substitution costs.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
SUBSTITUTE, KEEP_SIGN, COLLAPSE, KEEP_RUN = 0.5, 12.0, 0.3, 1.5
#: Weight of a letter's own frequency against what follows a context.
BACK_OFF = 2.0

SIGNS, LETTER = re.escape("".join(LEET)), r"[^\W\d_]"
DISGUISED = re.compile(rf"{LETTER}[{SIGNS}]+{LETTER}|(?<!\S)[0-9@$!|+€]+{LETTER}|{LETTER}[0-9@$|+€]+(?!\S)|(?<!\S)[{SIGNS}]{{3,}}(?!\S)|({LETTER})\1\1")
ONE = r"(?:[^\W_]|[@$!|+€])"
SPACED = re.compile(rf"(?<![^\W_]){ONE}(?P<gap>[ .\-_*]){ONE}(?:(?P=gap){ONE}){{2,}}(?![^\W_])")
GAPS = set(" .-_*")
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: A letter's bits in the code of a trigram; 0 is the edge of a word.
BITS = 21
LOW = (1 << BITS) - 1


def suspects(text: str) -> set[str]:
    """The distinct tokens of a text that look disguised."""
    out = {m[0].lower() for m in SPACED.finditer(text)}
    at = 0
    while m := DISGUISED.search(text, at):
        start, at = m.start(), m.end()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        while at < len(text) and not text[at].isspace():
            at += 1
        out.add(text[start:at].strip(".,;:?\"'()[]{}").lower())
    out.discard("")
    return out


def trigrams(words: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the trigrams of counted words, edges included."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(("\0\0" + "\0\0".join(words) + "\0").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes + 2)[: len(points) - 2]
    code = points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:]
    # a code across two words has an edge in the middle and none before it
    own = (points[1:-1] > 0) | (points[:-2] == 0) & (points[2:] > 0)
    code, at = np.unique(code[own], return_inverse=True)
    return code, np.bincount(at, weight[own], len(code)).astype(np.int64)


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text_hash, tokens) and rows of trigram
    counts (code, n), of one pass over the texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for b in batches:
            tokens = []
            for x in b["text"]:
                x = _text(x)
                seen.update(NOT_LETTERS.sub(" ", x.lower()).split())
                tokens.append(sorted(suspects(x)))
                if len(seen) > WORDS_HELD:
                    yield counted(seen)
                    seen = Counter()
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "text_hash": b["text_hash"].array, "tokens": pd.Series(tokens, dtype=object), "code": pd.array([None] * len(b), "Int64"), "n": pd.array([None] * len(b), "Int64")})
        yield counted(seen)

    def counted(seen: Counter[str]) -> pd.DataFrame:
        code, n = trigrams(seen)
        none = pd.Series([None] * len(code), dtype=object)
        return pd.DataFrame({"doc_id": none, "text_hash": none, "tokens": none, "code": code, "n": n})

    return docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInPandas(work, f"doc_id {kind}, text_hash bigint, tokens array<string>, code bigint, n bigint")


class Lattice:
    """A token as runs, each with what it may be at what channel cost."""

    def __init__(self, token: str):
        spaced = SPACED.fullmatch(token)
        gap = spaced["gap"] if spaced else None
        self.runs = []
        for m in re.finditer(r"(.)\1*", token, re.S):
            c, k = m[0][0], len(m[0])
            if gap is not None and c == gap:
                self.runs.append([("", 0.0), (" ", 0.0)])
            elif c.isalpha():
                once = [(c, {1: 0.0, 2: 3.0}.get(k, COLLAPSE * (k - 1))), (c * 2, KEEP_RUN if k == 1 else COLLAPSE * (k - 2) if k > 2 else 0.0)]
                self.runs.append(once[:1] if k == 1 else once if k < 3 else [*once, (m[0], KEEP_RUN * (k - 2))])
            elif c in LEET:
                self.runs.append([(x * j, SUBSTITUTE * k + 0.3 * (k - j)) for x in LEET[c] for j in range(1, min(k, 2) + 1)] + [("", KEEP_SIGN * k)])
            else:
                self.runs.append([("", 0.1 * k)])

    @staticmethod
    def arcs(state: int, piece: str) -> tuple[list[int], int]:
        """Codes of the trigrams on the way, and the state after it."""
        codes = []
        for c in piece:
            z = 0 if c == " " else ord(c)
            if z or state & LOW:  # a second edge changes nothing
                codes.append(state << BITS | z)
                state = (state << BITS | z) & (1 << 2 * BITS) - 1 if z else 0
        return codes, state

    def codes(self) -> set[int]:
        """The trigrams of all paths."""
        states, found = {0}, set()
        for options in self.runs:
            fresh = set()
            for s in states:
                for piece, _ in options:
                    codes, t = self.arcs(s, piece)
                    found.update(codes)
                    fresh.add(t)
            states = fresh
        return found | {s << BITS for s in states}

    def decode(self, cost: dict[int, float]) -> str:
        """The text of the best path; ``cost``: of each trigram."""
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for options in self.runs:
            fresh: dict[int, tuple[float, tuple]] = {}
            for s, (so_far, path) in states.items():
                for piece, more in options:
                    codes, t = self.arcs(s, piece)
                    total = so_far + more
                    for c in codes:
                        total += cost[c]
                    if t not in fresh or total < fresh[t][0]:
                        fresh[t] = (total, (path, piece))
            states = fresh
        _, path = min((total + cost[s << BITS], path) for s, (total, path) in states.items())
        out = []
        while path:
            path, piece = path
            out.append(piece)
        return "".join(reversed(out))


def restored(scanned: DataFrame) -> DataFrame:
    """token and word (what it most likely hides) of the distinct tokens."""
    counts = scanned.filter("code IS NOT NULL").groupBy("code").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    contexts = counts.groupBy(F.shiftright("code", BITS).alias("context")).agg(F.sum("n").alias("m"))
    # one row for each letter of the corpus
    letters = {r.z: r.n for r in counts.groupBy(F.col("code").bitwiseAND(F.lit(LOW)).alias("z")).agg(F.sum("n").alias("n")).collect()}
    total = sum(letters.values())
    sent = scanned.sparkSession.sparkContext.broadcast(letters)

    def need(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b["token"].iloc[k : k + 256]
                found = [sorted(Lattice(t).codes()) for t in part]
                yield pd.DataFrame({"token": np.repeat(part.to_numpy(object), list(map(len, found))), "code": [c for f in found for c in f]})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = []
            # arrays of numbers: as structs, a batch's arcs take fifteen times the memory
            for token, codes, ns, ms in zip(b["token"], b["codes"], b["ns"], b["ms"]):
                cost = {}
                for code, n, m in zip(codes.tolist(), ns.tolist(), ms.tolist()):
                    share = (sent.value.get(code & LOW, 0) + 0.5) / (total + 1)
                    cost[code] = -math.log((n + BACK_OFF * share) / (m + BACK_OFF))
                words.append(Lattice(token).decode(cost))
            yield pd.DataFrame({"token": b["token"], "word": words})

    tokens = scanned.select(F.explode("tokens").alias("token")).distinct()
    arcs = tokens.mapInPandas(need, "token string, code bigint").join(_small(counts), "code", "left").withColumn("context", F.shiftright("code", BITS)).join(_small(cut(contexts)), "context", "left")
    arc = F.struct("code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    each = arcs.groupBy("token").agg(F.collect_list(arc).alias("arcs"))
    return cut(each.select("token", F.col("arcs.code").alias("codes"), F.col("arcs.n").alias("ns"), F.col("arcs.m").alias("ms")).mapInPandas(solve, "token string, word string"))


def words_of(text: str) -> str:
    """Words in lower case between single spaces."""
    return f" {NOT_LETTERS.sub(' ', text.lower())} "


def stems_of(words: str) -> set[str]:
    found = set()
    for w in set(words.split()):
        found.add(f" {w} ")
        found.update(f" {w[:k]}" for k in PREFIXES if len(w) >= k)
    return found


def _text(x: object) -> str:
    return x if isinstance(x, str) else ""


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def learn_stems(docs: DataFrame, scanned: DataFrame, words: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Log-odds of stems, and the log-odds of a text without any."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = F.broadcast(cut(known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)))  # at most ``sample`` rows of two numbers

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = xxhash.xxh64_intdigest
        for b in batches:
            plain = [words_of(_text(x)) for x in b["text"]]
            least = [min((h(" ".join(s[k : k + 3])) for k in range(max(1, len(s) - 2))), default=0) for s in map(str.split, plain)]
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "text_hash": b["text_hash"].array, "toxic": b["toxic"].array, "plain": plain, "least": np.array(least, dtype=np.uint64).view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_hash().alias("text_hash"), "text").join(chosen, "doc_id").mapInPandas(prepare, f"doc_id {kind}, text_hash bigint, toxic int, plain string, least bigint")
    hidden = scanned.select("doc_id", "text_hash", F.explode("tokens").alias("token")).join(chosen.select("doc_id").distinct(), "doc_id")
    hidden = hidden.join(words, "token").groupBy("doc_id", "text_hash").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("more"))
    rows = rows.join(hidden, ["doc_id", "text_hash"], "left").withColumn("words", F.concat("plain", F.coalesce("more", F.lit("")), F.lit(" ")))
    once = rows.groupBy("least").agg(F.min_by("words", F.xxhash64("words")).alias("words"), F.max("toxic").alias("toxic"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: list[Counter[str]] = [Counter(), Counter()]
        for b in batches:
            for words, toxic in zip(b["words"], b["toxic"]):
                n[toxic > 0].update(stems_of(words_of(words)))
                n[toxic > 0][""] += 1
                if len(n[0]) + len(n[1]) > STEMS_HELD:
                    yield _counted(n)
                    n = [Counter(), Counter()]
        if n[0] or n[1]:
            yield _counted(n)

    counts = cut(once.select("words", "toxic").mapInPandas(count, "stem string, n0 bigint, n1 bigint").groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    base = counts.filter("stem = ''").first()
    if base is None:
        return {}, 0.0
    odds = F.log((F.col("n1") + 0.5) / F.lit(base.n1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(base.n0 + 1.0))
    found = counts.filter((F.col("n1") >= LEAST_ROWS) & (F.col("stem") != "") & (odds >= LEAST_ODDS)).select("stem", odds.alias("odds"))
    # as many as the sample's bound allows
    return {r.stem: r.odds for r in found.collect()}, math.log((base.n1 + 0.5) / (base.n0 + 0.5))


def _counted(n: list[Counter[str]]) -> pd.DataFrame:
    keys = list(n[0].keys() | n[1].keys())
    return pd.DataFrame({"stem": keys, "n0": [n[0][k] for k in keys], "n1": [n[1][k] for k in keys]})


class Finder:
    """The words of a text that hold a stem, with the odds of the strongest."""

    def __init__(self, stems: dict[str, float]):
        self.find = ahocorasick.Automaton() if stems else None
        if self.find is not None:
            for s, odds in stems.items():
                self.find.add_word(s, (s, odds))
            self.find.make_automaton()

    def __call__(self, text: str) -> list[dict]:
        if self.find is None or not text:
            return []
        words, best = words_of(text), {}
        for end, (stem, odds) in self.find.iter(words):
            start = end - len(stem) + 1
            word = words[start : words.index(" ", start + 1)]
            best[word] = max(odds, best.get(word, 0.0))
        return [{"word": w, "odds": o} for w, o in best.items()]


def score_documents(docs: DataFrame, corpus: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text_hash (with doc_id the row's key) and score of each row of
    ``docs``.  ``corpus``: the documents that the character model and the stems
    are learned from."""
    scanned = cut(scan(corpus))
    words = restored(scanned)
    stems, prior = learn_stems(corpus, scanned, words, labels, sample)
    if docs is not corpus:
        scanned = cut(scan(docs).unionByName(scanned.filter("code IS NOT NULL")))
        words = restored(scanned)
    sent = docs.sparkSession.sparkContext.broadcast(stems)
    hit = "array<struct<word:string,odds:double>>"

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Finder(sent.value)
        for b in batches:
            b[b.columns[-1]] = [find(_text(x)) for x in b.iloc[:, -1]]
            yield b.rename(columns={b.columns[-1]: "hits"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInPandas(look, f"doc_id {kind}, text_hash bigint, hits {hit}")
    telling = cut(words.mapInPandas(look, f"token string, hits {hit}").filter(F.size("hits") > 0))
    hidden = scanned.select("doc_id", "text_hash", F.explode("tokens").alias("token")).join(_small(telling), "token")
    hidden = cut(hidden.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("hits")).alias("more")))
    extra = _small(hidden).toDF("i", "t", "more")
    both = plain.join(extra, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t")), "left")
    # of each distinct word the largest odds: sorted by word, then odds, the last counts
    hits = F.array_sort(F.array_distinct(F.concat("hits", F.coalesce("more", F.lit(None).cast(hit), F.array().cast(hit)))))
    named = both.select("doc_id", "text_hash", hits.alias("hits"))
    last = F.filter("hits", lambda h, i: F.coalesce(F.get("hits", i + 1)["word"] != h["word"], F.lit(True)))
    z = F.lit(prior) + F.aggregate(last, F.lit(0.0), lambda x, h: x + h["odds"])
    return named.select("doc_id", "text_hash", (1 / (1 + F.exp(-z))).alias("score"))


def keep_clean(docs: DataFrame, corpus: DataFrame, labels: DataFrame, reject: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``reject``, with their columns."""
    bad = cut(score_documents(docs, corpus, labels).filter(F.col("score") >= reject).select("doc_id", "text_hash").distinct())
    return of_row(docs, _small(bad), "left_anti")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_documents(docs, docs, labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
