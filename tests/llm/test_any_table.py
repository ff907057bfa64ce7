"""Every public function on tables with clashing columns, nulls, repeated rows,
ties, a very long text, and on empty tables."""

import os
import subprocess
import sys

import corpus_pipeline
import pytest
from asof_factors.llm import chat_format, common, decontaminate, exact_dedup, html_extract, pii, sentencepiece_codec, shingle_join, simhash_dedup, suffix_dedup, toxicity, url_filter

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NAMES = ["__id", "__hash", "__score", "row_id", "row_hash", "text_hash", "kept_sha", "runs", "spans", "n", "key", "fp", "hits", "score", "place", "verdict", "rule", "ids"]
LONG = "word idiot a@b.co " * 5000
TEXTS = [(1, "one two three four five six seven eight nine ten a@b.co"), (1, "one two three four five six seven eight nine ten a@b.co"), (2, "one two three four five six seven eight nine ten a@b.co"), (3, None), (4, ""), (None, "x"), (None, None), (5, LONG), (6, LONG + "end")]


@pytest.fixture(scope="module")
def tables(spark):
    extra = ", ".join(f"`{c}` string" for c in NAMES)
    docs = spark.createDataFrame([(i, t, *["clash"] * len(NAMES)) for i, t in TEXTS], f"doc_id long, text string, {extra}")
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten a", "c"), (None, "x", "c"), (2, None, "c")], "item_id long, text string, window string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(i, f"http://a.casino.com/en/{i}", "<p>" + (t or "") + "</p>" if i else None, *["clash"] * len(NAMES)) for i, t in TEXTS], f"page_id long, url string, html string, {extra}")
    turns = spark.createDataFrame([(i, 0, "user", t, *["clash"] * len(NAMES)) for i, t in TEXTS], f"conv_id long, turn long, role string, text string, {extra}")
    return docs, bench, labels, pages, turns


#: Functions that give back rows of the table with all its columns.
KEEPS = {
    "toxicity": lambda d, b, l: toxicity.keep_clean(d, d, l),
    "exact": lambda d, b, l: exact_dedup.drop_exact_copies(d),
    "simhash": lambda d, b, l: simhash_dedup.keep_first(d),
    "shingles": lambda d, b, l: shingle_join.keep_first(d),
    "drop_contaminated": lambda d, b, l: decontaminate.drop_contaminated(d, b),
    "remove_spans": lambda d, b, l: decontaminate.remove_spans(d, b),
    "sanitise": lambda d, b, l: pii.sanitise(d),
}
#: Rows that stay: of the nine, copies and near copies go, or contaminated ones.
LEFT = {"toxicity": 9, "exact": 5, "drop_contaminated": 5, "remove_spans": 9, "sanitise": 9}


@pytest.mark.parametrize("name", KEEPS)
def test_rows_keep_their_columns(tables, name):
    docs, bench, labels, _, _ = tables
    out = KEEPS[name](docs, bench, labels.filter("false") if name == "toxicity" else labels)
    if name == "toxicity":
        out = toxicity.keep_clean(docs, docs, labels.filter("false"), reject=0.6)
    assert out.columns == docs.columns
    assert all(r["__id"] == "clash" for r in out.collect())
    if name in LEFT:
        assert out.count() == LEFT[name], name
    assert KEEPS[name](docs.limit(0), bench, labels).count() == 0


#: Functions that give a row for each row of the table.
ROWS = {
    "suffix": lambda d, b, l, p, t: suffix_dedup.remove_repeats(d),
    "toxicity": lambda d, b, l, p, t: toxicity.score_documents(d, d, l),
    "simhash": lambda d, b, l, p, t: simhash_dedup.near_dedup(d),
    "pii": lambda d, b, l, p, t: pii.find_spans(d),
    "hits": lambda d, b, l, p, t: decontaminate.find_hits(d, b),
    "exact": lambda d, b, l, p, t: exact_dedup.exact_dedup(d),
    "pieces": lambda d, b, l, p, t: sentencepiece_codec.encode_documents(d),
    "html": lambda d, b, l, p, t: html_extract.extract_pages(p),
    "urls": lambda d, b, l, p, t: url_filter.judge(p, url_filter.SITE_RULES + url_filter.PATTERN_RULES),
}


@pytest.mark.parametrize("name", ROWS)
def test_a_row_for_each_row(tables, name):
    docs, bench, labels, pages, turns = tables
    assert len(ROWS[name](docs, bench, labels, pages, turns).collect()) == len(TEXTS)  # all columns, none pruned
    assert ROWS[name](docs.limit(0), bench, labels, pages.limit(0), turns).count() == 0


def test_chats(tables):
    turns = tables[4]
    got = {r.conv_id: r.n_turns for r in chat_format.format_chats(chat_format.text_turns(turns)).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: 1, None: 2, 5: 1, 6: 1}


def test_stages_in_order(spark, tables, tmp_path):
    docs, bench, labels, _, _ = tables
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, str(tmp_path))
        seen.append((name, docs.count()))
    # the benchmark passage and "x" are contaminated; the long texts share 3 of 4 shingles
    assert [n for _, n in seen] == [5, 5, 3, 3] and seen[-1][0] == "sentencepiece"


def test_scores_of_paths_decide(monkeypatch):
    page = "<body><div><a href='/'>Home</a> <a href='/x'>More of this</a></div><div><h2>Title</h2><p>Long text, with commas, and more. Much more of it.</p><p>Again, a text, to read.</p></div><div><a>Terms, privacy</a></div></body>"
    assert html_extract.extract(page) == "Title\nLong text, with commas, and more. Much more of it.\nAgain, a text, to read."
    import numpy as np

    monkeypatch.setattr(html_extract, "path_scores", lambda p: (np.ones(len(p.nodes)), 0.5))
    assert "Home" in html_extract.extract(page)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_folder(Session())


def test_the_rest_works_without_these(tmp_path):
    script = "import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') or k == 'pipeline' for k in n); e.oracle_sql()"
    for x in ("__spark_entry__.py", "asof_factors"):
        subprocess.run(["cp", "-r", f"{ROOT}/{x}", str(tmp_path)], check=True)
    (tmp_path / "asof_factors" / "llm").rename(tmp_path / "gone")
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-1500:]
