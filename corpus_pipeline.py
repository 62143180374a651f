"""The corpus pipeline: five stages over ``documents``, each written and read again.

toxicity     documents that the factorization machine rejects go
line_dedup   lines that many documents repeat stay in one document
near_dups    of documents whose fingerprints link (3 words, 3 bits) the smallest doc_id stays
mixing       sources are mixed to their target weights; rows are documents' pieces of a mix block
packing      pieces are packed into bins; the last stage returns their places
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import shared_folder, table
from faultline.llm.line_dedup import line_dedup
from faultline.llm.mixing import mix_sources
from faultline.llm.packing import best_fit_packing
from faultline.llm.simhash import drop_simhash_duplicates
from faultline.llm.toxicity import fit_machine, held_out, score_toxicity


def _beside(docs: DataFrame, own: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs``, whose columns but ``own`` meanwhile have names that no operator uses."""
    aside = {c: c if c in own else f"_beside_{i}" for i, c in enumerate(docs.columns)}
    done = work(docs.select(*[docs[c].alias(name) for c, name in aside.items()]))
    return done.select(*[F.col(name).alias(c) for c, name in aside.items()])


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine does not reject, unchanged.

    Null and empty texts have the machine's bias as a score, alike for all; very long texts are scored
    whole; rows are judged each by its text, repeated or not; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    machine = fit_machine(docs, labels)
    return _beside(docs, ("doc_id", "text"), lambda d: score_toxicity(d, machine).filter("predicted = 0"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stay elsewhere; n_chars is counted anew where lines went.

    A null text that loses nothing stays null; a null doc_id keeps a line only if no other holds it;
    rows that repeat a doc_id keep or lose alike; an empty table stays empty.
    """

    def work(d: DataFrame) -> DataFrame:
        cleaned = line_dedup(d)
        if "n_chars" not in d.columns:
            return cleaned
        counted = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        return cleaned.withColumn("n_chars", counted.cast(d.schema["n_chars"].dataType))

    return _beside(docs, ("doc_id", "text", "n_chars"), work)


def _near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, unchanged: the smallest doc_id's, nulls last.

    Null and empty texts have one fingerprint and are one group; of repeated rows one stays; very long
    texts count whole; an empty table stays empty.
    """
    return drop_simhash_duplicates(docs, words=3, radius=3)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents' pieces of the mix: ``text`` is a piece, n_chars its length, other columns are the document's.

    Texts without words, null ones too, are in no piece; rows that repeat are documents of their
    own; a null source is the last one; an empty table stays empty.
    """
    return _beside(docs, ("doc_id", "text", "source", "n_chars"), mix_sources)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place: see ``best_fit_packing``, which states nulls, long texts and repeats."""
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("line_dedup", _line_dedup),
    ("near_dups", _near_dups),
    ("mixing", _mixing),
    ("packing", _packing),
]

#: A learned score, fingerprints and a random draw have no SQL form; tests/llm/test_pipeline.py
#: checks every stage on its own input instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
