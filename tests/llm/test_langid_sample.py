"""The labelled sample of language identification: null ids, copies, equal lengths."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ticklattice.llm import langid


def sentence(rng, letters, words=40):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(words))[:200].ljust(200, letters[0])


@pytest.mark.parametrize("kinds", [1, 30, 3000])
def test_a_language_of_equal_lengths_without_ids_is_learned(spark, kinds):
    """Many rows without a doc_id, all of one length, of few or many distinct texts; one text a third of the rows."""
    rng = random.Random(kinds)
    texts = [sentence(rng, "abcdeo") for _ in range(kinds)]
    rows = [(None, texts[k % kinds] if k % 3 else texts[0], "aa") for k in range(3000)]
    rows += [(k, sentence(rng, "mnpqruv"), "bb") for k in range(200)]
    rows += [(1, None, "aa"), (2, "123", "aa"), (3, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    learned = dict(langid.train(df, sample_docs=20))
    assert set(learned) == {"aa", "bb"} and all(0 < len(v) <= langid.LANGUAGE_BYTES for v in learned.values())
    assert langid.train(df, sample_docs=20) == langid.train(df.repartition(2).withColumn("doc_id", F.lit(7)), sample_docs=20)
    wanted = spark.createDataFrame([(10, sentence(rng, "abcdeo")), (10, sentence(rng, "mnpqruv")), (None, "  "), (None, None)], "doc_id long, text string")
    got = [r["lang_pred"] for r in langid.identify(wanted, langid.train(df, sample_docs=20), keep=["text"]).orderBy(F.col("text").isNull(), F.desc("text")).collect()]
    assert sorted(got) == ["aa", "bb", "und", "und"]


def test_the_sample_is_bounded_before_it_is_collected(spark, monkeypatch):
    """Distinct texts are cut to twice sample_docs in the plan."""
    rng = random.Random(1)
    df = spark.createDataFrame([(sentence(rng, "abcd"), "aa") for _ in range(500)], "text string, lang string")
    seen = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(out := collect(self)) or out)
    langid.train(df, sample_docs=5)
    assert max(len(x) for x in seen) <= 10


def test_nothing_labelled(spark):
    assert langid.train(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")) == []
