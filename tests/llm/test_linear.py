"""Work in proportion to the input where one key or one document is large."""

import random
import time

from asof_factors.llm import decontaminate, pii

from test_small_cases import docs


def test_one_address_in_many_documents(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    texts = [" ".join([*(word() for _ in range(5)), "no@reply.org", *(word() for _ in range(5))]) for _ in range(2000)] + [word() for _ in range(2000)]
    d = docs(spark, texts).repartition(4)
    pii.find_spans(docs(spark, texts[:3])).collect()
    began = time.time()
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_spans(d).collect()}
    assert all(0 in got[i] for i in range(2000)) and all(got[i] == [] for i in range(2000, 4000))
    assert time.time() - began < 60


def test_popular_entities_give_the_same_spans(spark, monkeypatch):
    rng = random.Random(2)
    people = [("".join(rng.choice("abcdefghij") for _ in range(8)), f"m{k}@site.org") for k in range(12)]
    filler = lambda: " ".join(rng.choice(["the", "of", "and", "river", "stone", "report", "of"]) for _ in range(rng.randint(2, 9)))
    texts = [f"{filler()} {name} {mail} {filler()}" for name, mail in people for _ in range(rng.randint(2, 9))] + [f"{filler()} all@site.org {filler()}" for _ in range(80)] + [filler() for _ in range(150)]
    runs = []
    for most in (64, 0, 10**9):
        monkeypatch.setattr(pii, "POPULAR", most)
        runs.append(sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in pii.find_spans(docs(spark, texts)).collect()))
    assert runs[0] == runs[1] == runs[2] and any(s[0] == pii.TERM for _, ss in runs[0] for s in ss)


def test_a_long_document_beyond_the_broadcast(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(20000)]
    bench = spark.createDataFrame([(k, " ".join(words[k * 2000 : k * 2000 + 12])) for k in range(5)], "item_id long, text string")
    d = docs(spark, [" ".join(words), " ".join(words[:5]), None])
    began = time.time()
    far = sorted((r.doc_id, r.n_words, [tuple(h) for h in r["hits"]], r["items"]) for r in decontaminate.find_hits(d, bench, most=0).collect())
    assert time.time() - began < 60
    near = sorted((r.doc_id, r.n_words, [tuple(h) for h in r["hits"]], r["items"]) for r in decontaminate.find_hits(d, bench).collect())
    assert far == near and len(far[0][2]) == 15 and far[0][3] == ["0", "1", "2", "3", "4"]
