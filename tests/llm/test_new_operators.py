"""MinHash near-dedup, clustering and token alignment against brute force, and
on awkward tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from asof_factors.llm import minhash_dedup, near_links, token_alignment, vector_clusters
from pyspark.sql import functions as F

from test_any_table import LONG, NAMES, TEXTS

from test_small_cases import docs


# ---- near-dedup


def shingle_set(text, size):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def components(texts, size):
    sets, parent = [shingle_set(t, size) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def edited(rng, base, n, word):
    out = list(base)
    for k in rng.sample(range(len(base)), n):
        out[k] = word()
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    few = ["alpha", "beta", "gamma", "delta"]
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = [None, "", " \t", "a", "A", "a b c", "a b c d", "A B c  d"]
    for n in (12, 60, 150):
        base = [word() for _ in range(n)]
        # edits from a small vocabulary at few places, so that copies share their differences
        for _ in range(120 if n == 60 else 20):
            out.append(" ".join(edited(rng, base, rng.randint(0, max(1, n // 12)), lambda: rng.choice(few))))
    passage = [word() for _ in range(50)]
    return out + [" ".join([word() for _ in range(rng.randint(5, 60))] + passage) for _ in range(60)]


@pytest.mark.parametrize(("hub", "apart"), [(32, 256), (8, 8)])
def test_components_against_brute_force(spark, texts, hub, apart, monkeypatch):
    monkeypatch.setattr(near_links.link_buckets, "__defaults__", (hub, apart, None))
    monkeypatch.setattr(near_links, "LEVELS", 2)
    monkeypatch.setattr(minhash_dedup.near_dedup, "__defaults__", (*minhash_dedup.near_dedup.__defaults__[:-1], hub))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_dedup(docs(spark, texts)).collect()}
    assert got == components(texts, 4)


def test_every_bin_fills_and_agreement_is_similarity():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 5, 40, 3000)]
    out = minhash_dedup.sketches(sets, 264)
    assert (out != minhash_dedup.NONE).all()
    assert (minhash_dedup.sketches([sets[3]], 264)[0] == out[3]).all()
    gaps = []
    for _ in range(40):
        a = rng.integers(0, 2**63, 200, dtype=np.uint64)
        k = rng.integers(20, 180)
        b = np.concatenate((a[:k], rng.integers(0, 2**63, 200 - k, dtype=np.uint64)))
        x, y = minhash_dedup.sketches([np.unique(a), np.unique(b)], 264)
        gaps.append((x == y).mean() - k / (400 - k))
    assert abs(np.mean(gaps)) < 0.015 and np.std(gaps) < 0.045


def test_near_dedup_of_awkward_tables(spark):
    extra = ", ".join(f"`{c}` string" for c in [*NAMES, "node", "size", "bands"])
    d = spark.createDataFrame([(i, t, *["clash"] * (len(NAMES) + 3)) for i, t in TEXTS], f"doc_id long, text string, {extra}")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_dedup(d).collect())
    # a null id is never the smallest; the long texts share 3 of 4 shingles
    assert got == {(1, 1, True): 2, (2, 1, False): 1, (3, 3, True): 1, (4, 4, True): 1, (None, None, True): 2, (5, 5, True): 1, (6, 6, True): 1}
    assert minhash_dedup.near_dedup(d.limit(0)).collect() == []


# ---- clustering


def lloyd(vectors, ids, k, rounds):
    """The contract's rounds in plain integers."""
    x = [[int(np.floor(256 * float(v))) for v in row] for row in vectors]
    order = sorted(range(len(x)), key=lambda i: hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest())[:k]
    c = [x[i] for i in order]
    near = lambda row: min((sum((a - b) ** 2 for a, b in zip(row, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(row)[1] for row in x]
        c = [[sum(col) // len(col) for col in zip(*m)] if (m := [r for r, o in zip(x, own) if o == j]) else c[j] for j in range(len(c))]
    return {i: near(row)[::-1] for i, row in zip(ids, x)}, c


@pytest.mark.parametrize(("bits", "broadcast"), [(6, 10**6), (2, 0)])
def test_clusters_against_plain_rounds(spark, bits, broadcast):
    rng = np.random.default_rng(bits)
    middle = rng.normal(size=(4, 8))
    vectors = [(middle[k % 4] + rng.normal(size=8) * 0.3).astype(np.float32).tolist() for k in range(150)]
    vectors += vectors[:5] + [[0.0] * 8] * 3
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    found, centroids = vector_clusters.cluster_vectors(df, dimensions=8, clusters=7, rounds=2, bits=bits, broadcast=broadcast)
    want, means = lloyd(vectors, list(range(len(vectors))), 7, 2)
    assert {r.vec_id: (r.cluster, r.distance) for r in found.collect()} == want and centroids.tolist() == means
    out = vector_clusters.with_digests(found, centroids).collect()
    assert {r.inertia for r in out} == {sum(d for _, d in want.values())}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, means[r.cluster])).encode()).hexdigest() for r in out)


def test_cells_bound_their_values():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 6, 9):
        v = rng.integers(-300, 300, size=(400, 5))
        v[:, 4] = 7
        cells = vector_clusters.Cells(v.min(axis=0), v.max(axis=0), bits)
        numbers = cells.unpack(cells.pack(v))
        at = np.arange(5)
        assert ((cells.least[numbers, at] <= v) & (v <= cells.most[numbers, at])).all()
        c = rng.integers(-300, 300, size=(9, 5))
        distance = ((v[:, None] - c) ** 2).sum(axis=2)
        possible = vector_clusters.candidates(cells, numbers, cells.tables(c), c)
        assert possible[distance == distance.min(axis=1, keepdims=True)].all()


def test_clusters_of_awkward_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, None), (3, []), (4, [0.5]), (5, [0.5, nan]), (6, [inf, 0.5]), (7, [None, 0.5]), (None, [3.0, -1.0]), (8, [3e38, -3e38]), (9, [-0.001, 0.0])]
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<float>, row string, cells string")
    found, centroids = vector_clusters.cluster_vectors(df, dimensions=2, clusters=40, rounds=1)
    got = sorted((r.vec_id is None, r.vec_id, r.cluster, r.distance) for r in vector_clusters.with_digests(found, centroids).collect())
    assert [g[1] for g in got] == [1, 1, 8, 9, None] and all(g[3] == 0 for g in got) and len(centroids) == 5
    found, centroids = vector_clusters.cluster_vectors(df.limit(0), dimensions=2)
    assert vector_clusters.with_digests(found, centroids).collect() == []


# ---- alignment


@pytest.fixture(scope="module")
def tokenizers():
    return token_alignment.Tokenizers(*token_alignment.Tokenizers.read(token_alignment.PATH_A, token_alignment.PATH_B))


ODD = [None, "", " ", "a  b", " lead", "trail ", "x ▁ y", "▁", "tab\t tab", "nl\n \nx", "a\n b \n c", "日本語 テスト 😀😀 é", "w" * 5000, "\x1c \x1c", "it's 'll <|endoftext|> </s> <s>", "é" * 300, "the cat sat", "the cat sat", "the dog sat. The cat", LONG, "0x00 \x00 <0x41>", "   ", "x   y"]


def one(t, text):
    """Tokens, groups and links of a text by plain loops; None: no tokens."""
    a, b, whole = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text), (" " + text).encode()
    if not text or b"".join(t.bytes_a[i] for i in a) != whole or b"".join(t.bytes_b[i] for i in b) != whole:
        return None
    ends = [np.cumsum([len(known[i]) for i in ids]).tolist() for ids, known in ((a, t.bytes_a), (b, t.bytes_b))]
    groups, x, y = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append((a[x:p], b[y:q]))
        x, y = p, q
    return a, b, groups, collections.Counter((i, j) for g in groups for i in g[0] for j in g[1])


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_alignment_against_plain_loops(spark, tokenizers, broadcast):
    rng = random.Random(2)
    bits = ["the", "cat", "naïve", "Straße", "日本", "😀", "foo_bar", "x9", "\n", "\t", " ", "--", "don't", "▁"]
    texts = ODD + [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    found = [one(tokenizers, t or "") for t in texts]
    holds = collections.Counter(p for f in found if f for p in f[3])
    highest = collections.defaultdict(int)
    for (a, _), n in holds.items():
        highest[a] = max(highest[a], n)
    want = {}
    for k, f in enumerate(found):
        if f is None:
            want[k] = (0, 0, 0, 0, 0, 0, "")
            continue
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in f[2])
        want[k] = (len(f[0]), len(f[1]), len(f[2]), sum(f[3].values()), sum(n for p, n in f[3].items() if holds[p] == highest[p[0]]), sum(n * holds[p] for p, n in f[3].items()), hashlib.sha256(text.encode()).hexdigest())
    got = token_alignment.cross_alignment(docs(spark, texts).repartition(3), broadcast=broadcast).collect()
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got} == want
    assert sum(f is None for f in found) >= 5


def test_lanes_and_wide_groups(tokenizers, monkeypatch):
    monkeypatch.setattr(token_alignment, "PLACE", 3)
    monkeypatch.setattr(token_alignment, "GROUPS", 5)
    monkeypatch.setattr(token_alignment, "LONG", 4)
    text = ["one two three four five six seven " * 9 + "x", "日本語" * 7, "é"]
    stretches = token_alignment.Stretches(tokenizers)
    for wide in (4096, 0):
        monkeypatch.setattr(token_alignment.links, "__defaults__", (wide,))
        got = token_alignment.align(text, stretches)
        for k, t in enumerate(text):
            f = one(tokenizers, t)
            assert dict(zip(got["pairs"][k].tolist(), got["times"][k].tolist())) == {a * len(tokenizers.bytes_b) + b: n for (a, b), n in f[3].items()}
            assert got["n_groups"][k] == len(f[2])


def test_the_quick_encoder_gives_the_librarys_ids(tokenizers):
    texts = [" " + t for t in ODD if t]
    assert tokenizers.quick is not None
    assert [tokenizers.quick(t) for t in texts] == [e.ids for e in tokenizers.a.encode_batch(texts, add_special_tokens=False)]


def test_alignment_of_awkward_tables(spark):
    extra = ", ".join(f"`{c}` string" for c in [*NAMES, "row", "pairs"])
    d = spark.createDataFrame([(i, t, *["clash"] * (len(NAMES) + 2)) for i, t in TEXTS], f"doc_id long, text string, {extra}")
    got = token_alignment.cross_alignment(d).collect()
    assert len(got) == len(TEXTS) and sum(r.n_a == 0 for r in got) == 3
    assert token_alignment.cross_alignment(d.filter(F.lit(False))).collect() == []
