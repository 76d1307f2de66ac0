"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, benchmark decontamination, mixing.

A stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import decontaminate, lines, mixing, shingles, simhash, toxicity
from lathe.llm.common import scratch, shared_dir, spare, table


def beside(docs: DataFrame, added: list[str], operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``operate`` keeps, with the columns of ``docs`` only: those that are named like one of ``added`` step aside meanwhile."""
    taken = {x.lower() for x in added}
    clash = [c for c in docs.columns if c.lower() in taken]
    aside = dict(zip(clash, spare([*docs.columns, *added], *(f"_{c}" for c in clash)), strict=True))
    return operate(docs.withColumnsRenamed(aside)).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.3; labels train the model on the documents that the stage is given.

    Null and empty texts score 0 and stay; rows that repeat one another share their
    score; without usable labels nothing goes; an empty table gives none.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return beside(docs, ["toxicity", "offending"], lambda d: toxicity.score_documents(d, model).where("toxicity < 0.3"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fuzzy repeats of lines go; a document that had text and has none left goes with them. n_chars follows the text.

    Null and empty texts hold no line and stay. The first occurrence by doc_id, text
    hash and line stays; rows that repeat both id and text are one document, all of
    whose rows stay or go alike. An empty table gives none.
    """

    def operate(d):
        found = lines.dedup_lines(d).where("n_removed = 0 or trim(text) <> ''")
        return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))

    return beside(docs, ["n_lines", "n_removed"], operate)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose 5-word shingles have a Jaccard similarity of 0.8 or more.

    That of the smallest doc_id, nulls last. Null, empty and blank texts are one
    group. A doc_id that comes with several texts is several documents; rows that
    repeat both are one. An empty table gives none.
    """
    return simhash.keep_one(docs, groups=shingles.near_copies)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; rows that repeat one another stay or go
    alike; an empty benchmark or table removes nothing.
    """
    bench = table(spark, sf_dir, "benchmark")
    return beside(docs, ["n_words", "hit_spans", "items"], lambda d: decontaminate.decontaminate(d, bench).where(F.size("items") == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked source, language and topic shares; each row with its weight and expected copies.

    A document is repeated where more of it than there is is wanted. Null and empty
    texts have no tokens; null sources and languages are values of their own; rows
    that share a doc_id share their draw. Columns named like the new ones (topic,
    n_tokens, weight, expected) are replaced. An empty table gives none.
    """
    mixed = mixing.mix(docs.drop("topic"), mixing.document_dims()).where("sampled")
    mixed = mixed.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copies", "sampled", "residual")
    return mixed.withColumns({"weight": F.round("weight", 6), "expected": F.round("expected", 6)})


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# Trained scores, edit and shingle similarity have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage stored meanwhile is deleted then."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
