"""From raw documents to token ids: five stages, each on all that the one before it kept.

Counted with the training-data operators in ``ticklattice/llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklattice.llm import decontam, langid, nearcopies, pii, piece, queries, shared


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str], list]:
    """``docs`` with all columns but doc_id and text under names that no operator uses, those names, and the way back."""
    aside = {c: f"__aside_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    renamed = docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns])
    return renamed, list(aside.values()), [F.col(aside.get(c, c)).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; those without a letter (empty ones too), or with a null text, go.

    Learns from the rows with a lang that aren't held out; with none of them nothing is identified and all go.  Whole texts
    of any length are judged; equal texts fare alike; doc_id may be null or repeat; other columns may have any name.
    """
    rows, others, back = _aside(docs)
    training = langid.train(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    found = langid.identify(rows, training, keep=["text", *others])
    return found.filter(F.col("lang_pred") != "und").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): that with the smallest doc_id.

    SimHash links and, for what lies beyond their radius, MinHash bands name pairs; every pair is checked by its whole sets.

    Rows count by themselves, whatever their doc_id: no text is lost because its doc_id repeats or is null (null goes last).
    Null and empty texts have no words and are copies of one another.  Other columns may have any name.
    """
    rows, _, back = _aside(docs)
    return nearcopies.one_of_each(rows).select(*back)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; one that holds any window of it goes.

    Null and empty texts hold none and stay, as all do with an empty benchmark.  Whole texts of any length are searched;
    equal texts fare alike; doc_id may be null or repeat; other columns may have any name.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, others, back = _aside(docs)
    found = decontam.decontaminate(rows, benchmark, keep=["text", *others])
    return found.filter("not contaminated").select(*back)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data; n_chars follows the new text.

    Every row stays, null and empty texts as they are; equal entities get equal surrogates in all rows.  Whole texts of any
    length are searched; doc_id may be null or repeat; other columns may have any name.
    """
    rows, _, back = _aside(docs)
    key = spark.conf.get(pii.KEY_CONF, queries.DEMONSTRATION_KEY)
    out = pii.replace(rows, key=key).select(*back)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (null: none), and digests of ids and of the decoded text; doc_id, lang and source stay beside them.

    Whole texts of any length are encoded; equal texts get equal ids; doc_id may be null or repeat.
    """
    return piece.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=[c for c in ("lang", "source") if c in docs.columns])


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL cannot express the stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
