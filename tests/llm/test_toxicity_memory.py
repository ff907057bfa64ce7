"""Toxicity: what a task holds is bounded, whatever the size of a batch."""

from itertools import islice, product
from string import ascii_lowercase

from asof_factors.llm import toxicity


def test_counts_are_handed_on_within_a_batch(spark):
    """A batch of 250,000 distinct words was counted whole."""
    words = map("".join, product(ascii_lowercase, repeat=4))
    docs = spark.createDataFrame([(i, " ".join(islice(words, 5000))) for i in range(50)], "doc_id bigint, text string").coalesce(1)
    rows = toxicity.scan(docs).filter("code IS NOT NULL").select("code", "n").collect()
    assert len(rows) > len({r.code for r in rows})
    assert sum(r.n for r in rows) == 250_000 * 5  # with an edge before, and one after
