"""op10 decodes each document's ids and compares them with its own text."""

import os
import subprocess
import sys

import pyarrow as pa
from asof_factors.llm import sentencepiece_codec

from test_small_cases import docs

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_text_with_the_mark_does_not_return(spark, tmp_path):
    texts = ["a b", "bars ▁▂▃", "▁", None, "", " x  é\n", "日"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.round_trip for r in sentencepiece_codec.op10_sentencepiece(spark, str(tmp_path)).collect()}
    assert got == {i: "▁" not in (t or "") for i, t in enumerate(texts)}


def test_each_text_is_decoded():
    v = sentencepiece_codec.Vocabulary.load()
    v.encoded[v.ids["▁the"]] = b"?"
    found, back = sentencepiece_codec.Encoder(v)(["of the day", "of a day"])
    assert back == [v.decode(i.tolist()) for i in found] and back[0] != "of the day" and back[1] == "of a day"


def test_workers_need_not_import_the_package(tmp_path):
    """A session started elsewhere, whose workers do not find the package."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from asof_factors.llm import sentencepiece_codec as s
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(1, "of the day"), (2, None)], "doc_id long, text string")
got = s.decode_documents(s.encode_documents(docs)).collect()
assert sorted((r.doc_id, r.text) for r in got) == [(1, "of the day"), (2, "")]
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_batch_is_not_turned_into_strings_whole(monkeypatch):
    """A batch of 10,000 documents lay in a task twice, in Arrow and as strings."""
    monkeypatch.setattr(sentencepiece_codec, "TEXTS", 4)
    v, at_once = sentencepiece_codec.Vocabulary.load(), []
    encoder = sentencepiece_codec.Encoder(v)
    texts = ["a b", None, "", "▁", "x  é\n", "of the day", "日", "end", "of", ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": [*range(9), None], "text": texts})
    found = sentencepiece_codec.encoded(lambda t: at_once.append(len(t)) or encoder(t), batch)
    rows = pa.Table.from_batches(found).to_pylist()
    assert at_once == [4, 4, 2] and [r["doc_id"] for r in rows] == [*range(9), None]
    assert [r["ids"] for r in rows] == [i.tolist() for i in encoder([t or "" for t in texts])[0]]
    assert [r["round_trip"] for r in rows] == [t != "▁" for t in texts] and all(r["same"] for r in rows)
