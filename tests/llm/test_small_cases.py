"""Every operator against a brute-force version on small, awkward tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from asof_factors.llm import chat_format, decontaminate, exact_dedup, html_extract, pii, sentencepiece_codec, simhash_dedup, suffix_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, spans string"


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", 1, "clash", "clash") for i, t in zip(ids, texts)], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(4)
    long = prose(rng, 3000)
    near = [long[:400] + prose(rng, 3) + long[430:] for _ in range(6)]
    passage = prose(rng, 120)
    return [None, "", " \t\n", "a", long, long, long.replace(" ", "\n"), *near, prose(rng, 40) + passage + prose(rng, 30), passage, prose(rng, 5) + passage, "ab " * 900, "ab " * 900, "é😀 " * 300]


# ---- op1


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), edges, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("most", [8192, 1])
def test_suffix_dedup(spark, awkward, most):
    got = suffix_dedup.remove_repeats(docs(spark, awkward), most=most).collect()
    own = {r.doc_id: (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in got}
    assert own == dict(enumerate(brute_repeats(awkward, 400)))


def test_passages_of_more_than_fifty_words(spark):
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long, short = text(51), text(48)
    texts = [f"{text(9)} {long} {text(3)}", f"{text(20)} {long}", f"{text(9)} {short} {text(3)}", f"{short} {text(4)}", text(200), None]
    got = suffix_dedup.remove_repeats(docs(spark, texts), passage=suffix_dedup.PASSAGE).collect()
    assert {r.doc_id: (len(r.passages), len(r.spans)) for r in got} == {0: (1, 0), 1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_columns_against_brute_force():
    rng = random.Random(0)
    for _ in range(40):
        texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 12))})
        places = [rng.randint(0, len(t)) for t in texts]
        seen = collections.Counter((i - p, t[i : i + 5]) for t, p in zip(texts, places) for i in range(len(t) - 4))
        want = [[i for i in range(len(t) - 4) if seen[i - p, t[i : i + 5]] > 1] for t, p in zip(texts, places)]
        assert [g.tolist() for g in suffix_dedup.repeated_starts(texts, places, 5)] == want


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(docs(spark, ["x"]).limit(0)).count() == 0


# ---- op2


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    words = [prose(rng, 1) for _ in range(400)]
    texts, toxic = [], []
    for i in range(600):
        bad = i % 4 == 0
        body = [rng.choice(words) for _ in range(30)]
        if bad:
            body[5] = rng.choice(["zzidiotz", "qqmoronq"])
        texts.append(" ".join(body))
        toxic.append(int(bad))
    d = docs(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(d, d, labels).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [i for i in range(600) if got[i].out]
    assert held and all((got[i].score >= 0.3) == bool(toxic[i]) for i in held)
    assert got[600].score == got[601].score and 0 <= got[600].score < 0.3
    kept = toxicity.keep_clean(d, d, labels)
    assert kept.columns == d.columns and kept.count() == 452
    assert toxicity.score_documents(d.limit(0), d.limit(0), labels).count() == 0


def test_deobfuscation(spark):
    text = "what an idiot and moron, you loser; stupid trash clown; ass größe дурак. a to be of the in it is " * 50
    cases = [("1d10t", "idiot"), ("m.o.r.o.n", "moron"), ("l0$er", "loser"), ("stuuuupid", "stupid"), ("tr@5h", "trash"), ("c l o w n", "clown"), ("lo" + "o" * 50 + "ser", "loser"), ("a$$", "ass"), ("455", "ass"), ("1diot", "idiot"), ("m0r0n", "moron"), ("größ3", "größe"), ("дуууурак", "дурак"), ("y o u i d i o t", "you idiot"), ("y o u s t u p i d c l o w n", "you stupid clown")]
    cases.append(("t r a s h i d i o t " * 20 + "y o u", " ".join(["trash idiot"] * 20 + ["you"])))
    given = [text, *(f"hey {hidden}  there" for hidden, _ in cases), "plain words stay, (really) so: 1 2", None, ""]
    scanned = toxicity.cut(toxicity.scan(docs(spark, given)))
    words = {r.token: r.word for r in toxicity.restored(scanned).collect()}
    assert {h: words.get(h) for h, _ in cases} == dict(cases)
    assert all(not r.tokens for r in scanned.filter(f"doc_id > {len(cases)}").collect())


def test_trigrams_grow_with_the_words():
    code, n = toxicity.trigrams(collections.Counter({"ab": 3, "é": 2, "abc": 1}))
    at = lambda x, y, z: ord(x) << 42 | ord(y) << 21 | ord(z)
    e = "\0"
    assert dict(zip(code.tolist(), n.tolist())) == {at(e, e, "a"): 4, at(e, "a", "b"): 4, at("a", "b", e): 3, at(e, e, "é"): 2, at(e, "é", e): 2, at("a", "b", "c"): 1, at("b", "c", e): 1}


def test_toxicity_awkward_rows(spark):
    given = ["1d10t " * 30000, "x", "x", "", None, "5" * 50000, "a " * 20000]
    d = docs(spark, given, [1, 2, 2, 3, None, 5, 6]).withColumnRenamed("lang", "score").withColumnRenamed("source", "row_id")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score_documents(d, d, labels).collect()} == {0.5}
    kept = toxicity.keep_clean(d, d, labels, reject=0.6)
    assert kept.columns == d.columns and kept.count() == 7 and toxicity.keep_clean(d, d, labels).count() == 0


# ---- op3


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) for k in range(64)]
    return sum(1 << k for k, b in enumerate(bits) if 2 * b > len(shingles))


def test_simhash(spark, awkward):
    base = random.Random(9).getrandbits(64)
    got = simhash_dedup.near_dedup(docs(spark, awkward)).collect()
    assert all(r.fp & (2**64 - 1) == brute_fingerprint(awkward[r.doc_id]) for r in got)
    rng = random.Random(8)
    fps = {base} | {base ^ 1 << a ^ 1 << b for a, b in (rng.sample(range(64), 2) for _ in range(120))} | {rng.getrandbits(64) for _ in range(300)} | {0, 3, 2**63, 2**64 - 1}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    for hub in (1, 65, 10**9):
        links = simhash_dedup.find_links(spark.createDataFrame([(f,) for f in signed], "fp long"), hub=hub)
        roots = {r.node: r.root for r in simhash_dedup.components(links).collect()}
        parent = {f: f for f in signed}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(signed):
            for b in signed[i + 1 :]:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        assert all(roots.get(f, f) == find(f) for f in signed)


def test_thresholds_keep_the_pigeonhole_sum():
    counts = np.random.default_rng(1).integers(1, 500, (200, 3))
    t, cost = simhash_dedup.allocate(counts, [22, 21, 21], 10**6)
    assert ((t + 1).sum(axis=1) == 3).all() and (cost > 0).all()
    assert [simhash_dedup.parts_for(10**k) for k in (0, 3, 6, 9, 10)] == [3, 3, 3, 2, 2]


# ---- op4

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            if kind == "card" and (not 13 <= len(d) <= 19 or sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_spans(spark):
    rng = random.Random(3)
    bits = ["a", "b.", "@", ".", "..", "_", "%", "22", "256", "0001", "-", " ", "  ", "+", "(", ")", "4111111111111111", "é", "😀", "5500 0000 0000 0004", "1.2.3.4", "a@b.c", "+1 (212) 555-0100"]
    texts = [None, "", *["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(800)]]
    d = docs(spark, texts).select("doc_id", pii._joined(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s"))
    assert [(r.doc_id, r.s) for r in d.collect() if r.s != brute_spans(texts[r.doc_id])] == []
    huge = ["a@b.c " * 40000, "1 " * 30000, "a." * 40000 + "@b" + ".c" * 40000, "9" * 80000]
    assert [r[0] for r in docs(spark, huge).select(F.size(pii.base_spans(F.col("text")))).collect()][:3] == [40000, 0, 1]


def test_terms_that_disclose(spark):
    rng = random.Random(6)
    texts = [f"{prose(rng, 8)} common near zorblax x@y.org common {prose(rng, 8)}" for _ in range(3)] + [f"common {prose(rng, 20)}" for _ in range(40)]
    got = pii.find_spans(docs(spark, texts)).collect()
    assert {s.value for r in got for s in r.spans if s.kind == pii.TERM} >= {"zorblax"}
    assert "common" not in {s.value for r in got for s in r.spans if s.kind == pii.TERM}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert "[EMAIL]" in clean[0] and "zorblax" not in clean[0] and clean[10] == texts[10]


# ---- op5


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "x <s>[user] \\0 </s>"), (1, 0, "user", None), (1, 2, None, ""), (2, None, "we[ird> ", "a\\1b"), (2, 3, "assistant", "😀 ok"), (2, 3, "assistant", "😀 ok")]
    t = chat_format.text_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    chats = chat_format.format_chats(t).withColumn("back", chat_format.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in chats.collect()}
    assert [tuple(x) for x in got[1].back] == [("user", ""), ("assistant", "x <s>[user] \\0 </s>"), ("", "")]
    assert [tuple(x) for x in got[2].back] == [("we[ird> ", "a\\1b"), ("assistant", "😀 ok"), ("assistant", "😀 ok")]
    m = got[1].loss_mask[0]
    assert len(got[1].loss_mask) == 1 and got[1].formatted[m.start - 1 : m.start - 1 + m.size] == "x \\1s\\2\\3user\\4 \\00 \\1/s\\2"


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3://a.png", 7840.0), ("audio", None, "b.wav", 2.0), (None, "end", None, None), ("document", None, None, None)]
    t = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [])], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chats(t).first()
    assert r.formatted == "<s>[user] see <image:2><audio:3>end<document:5> </s><s>[assistant]  </s>"
    assert [(a.n, a.type, a.ref, a.tokens) for a in r.attachments] == [(2, "image", "s3://a.png", 10), (3, "audio", "b.wav", 50), (5, "document", None, 0)] and r.expanded_tokens == 60


def test_chat_of_many_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"text {i}") for i in range(5000)]
    t = chat_format.text_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = chat_format.format_chats(t).first()
    assert [r.formatted[m.start - 1 : m.start - 1 + m.size] for m in r.loss_mask] == [x[3] for x in rows if x[2] == "assistant"]
    assert chat_format.format_chats(t.limit(0)).count() == 0


# ---- op6


def test_decontamination(spark):
    rng = random.Random(2)
    items = [prose(rng, 30), prose(rng, 4), "", None, prose(rng, 12)]
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").lower()) for x in items]
    texts = [None, "", "É é", items[0].upper().replace(" ", ",  "), prose(rng, 9) + " " + items[1] + " x", " ".join(items[0].split()[:9]), " ".join(items[4].split()[1:11]) + " " + items[4], items[0][:60] * 3]
    b = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(items)], "item_id long, text string, hits string")
    got = {r.doc_id: r for r in decontaminate.find_hits(docs(spark, texts), b).withColumn("n", decontaminate.covered(F.col("hits"))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hit, ids = set(), set()
        for j, iw in enumerate(words):
            k = min(10, len(iw))
            for s in range(len(iw) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == iw[s : s + k]:
                        hit |= set(range(p, p + k))
                        ids.add(str(j))
        assert (got[i].n_words, got[i].n, got[i].items) == (len(w), len(hit), sorted(ids)), i
    assert decontaminate.drop_contaminated(docs(spark, texts), b).columns == docs(spark, texts).columns
    assert decontaminate.find_hits(docs(spark, texts), b.limit(0)).filter(F.size("hits") > 0).count() == 0
    spans = {r.doc_id: r.text for r in decontaminate.remove_spans(docs(spark, texts), b).collect()}
    assert spans[3] == "" and spans[2] == "É é" and spans[4].endswith(" x") and spans[4].startswith(texts[4].split()[0])


# ---- op7


def test_html():
    page = '<html><head><title>no</title></head><body><header>Site</header><nav><a href="/">Home, now.</a></nav><article><header><h1>A &amp; B</h1></header><p>One,\n two. &lt;x&gt;<p>Three <b>bold</b>, four.<script>var a="</p>"</script><aside>no, no.</aside><div class="ad">buy, now.</div></article><footer>&copy; x</footer><!-- <p>c</p> --></body></html>'
    assert html_extract.extract(page) == "A & B\nOne, two. <x>\nThree bold, four."
    assert [html_extract.extract(x) for x in (None, "", "<", "<p", "plain")] == ["", "", "<", "", "plain"]
    generic = '<body><div id="sidebar">s, s.</div><div id="c"><h2>T</h2><p>Long text, with commas. And more.</p><p>More text, again, here.</p><div class="comments"><p>c, c.</p></div></div><div class="cookie-notice">ok, ok.</div>'
    assert html_extract.extract(generic) == "T\nLong text, with commas. And more.\nMore text, again, here."
    assert html_extract.extract("<div>" * 5000 + "deep, text." + "</div>" * 5000) == "deep, text."


# ---- op8


def test_urls(spark):
    urls = [None, "", "x", "http://", "http://A.com/en/1", "http://example.com/en/7?x=//y", "http://example.com/en/8", "http://b.example.net/de/82", "http://net/de/", "http://xnet/de/", "http://org/es", "http://a.org/es/", "ftp://casino.org/es#://", "http://my-casino.fr/", "http://casinos.fr/", "http://a.com/EN/"]
    d = spark.createDataFrame([(i // 2, u, "clash", "clash") for i, u in enumerate(u for u in urls for _ in (0, 1))], "page_id long, url string, html string, rule string")
    rules = url_filter.SITE_RULES + url_filter.PATTERN_RULES
    got = url_filter.judge(d, rules).collect()
    assert len(rules) > 1000 and len(got) == 2 * len(urls) and max(r.n_run for r in got) < 80
    assert sorted(got, key=str) == sorted(url_filter.judge(d, rules, inline=0).collect(), key=str)
    assert url_filter.judge(d.limit(0), rules).count() == 0
    own = {r.page_id: (r.host, r.path, r.rule if r.rank == 1 else None, r.verdict) for r in got}
    assert own[0] == own[1] == own[2] == own[3] == ("", "", None, "allow")
    assert own[4] == ("a.com", "/en/1", "com/en/", "block") and own[5] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert [own[i][2] for i in range(6, 13)] == ["com/en/", "example.net/de/8", "net/de/", None, None, "org/es/", "org/es"[:0] or None]
    assert own[12][3] == own[13][3] == "block" and own[14][3] == own[15][3] == "allow"


# ---- op9


def test_exact_dedup(spark):
    texts = ["a b", "ab", None, "", " ", "a\u00a0b", "ab  ", "x", "x"]
    ids = [5, 3, 9, 8, 7, 1, 4, 2, 2]
    got = exact_dedup.exact_dedup(docs(spark, texts, ids)).collect()
    own = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    assert own == [(1, 1, 1, True), (2, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True), (5, 4, 3, False), (7, 7, 3, True), (8, 7, 3, False), (9, 7, 3, False)]
    d = docs(spark, texts, ids)
    kept = exact_dedup.drop_exact_copies(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 7]
    assert exact_dedup.exact_dedup(d.limit(0)).count() == 0


# ---- op10


def test_sentencepiece(spark, awkward):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rng = random.Random(1)
    texts = awkward + ["".join(rng.choice("ab cde\n.,²▁ü日x1") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    got = sentencepiece_codec.encode_documents(docs(spark, texts)).collect()
    assert all(list(r.ids) == p.encode(texts[r.doc_id] or "") and r.same for r in got)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(docs(spark, texts))).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
