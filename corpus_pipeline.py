"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents;
the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import session
from lexmill.llm import exact_dedup, language, near_dedup, packing, quality
from lexmill.llm.registry import table, tokenizer_path

#: A document stays if its quality score is at least this.
LEAST_QUALITY = 0.7
SEQUENCE = 2048


def held(docs: DataFrame) -> DataFrame:
    """Every row as one struct column `row`, so that no name of an input's column can clash with those that a stage adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: those without letters (null and empty texts too), or that no learned languages fit, go.

    Repeated rows are judged one by one; null ids aren't learned from, but judged; an empty table stays empty.
    """
    session.tune(spark)
    found = language.classify(held(docs), language.fit(docs), "row.text", out="found")
    return found.filter((F.col("found.lang") != language.UNDETERMINED) & F.col("found.fits")).select("row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on `labels`, rates as good.

    Null and empty texts get the score of a text without features; repeated rows and null ids are judged one by one; without
    labels every score is 0.5, so nothing stays; an empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(held(docs), model, "row.text", out="score").filter(F.col("score") >= LEAST_QUALITY).select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id.

    Null and empty texts are equal; a null id stays only where its group has no other; of rows with equal id and text one
    stays; an empty table stays empty.
    """
    kept = exact_dedup.content_groups(docs).filter("kept").select("id", "text_sha256")
    rows = held(docs).withColumn("sha", F.sha2(exact_dedup.normalise(F.col("row.text")), 256)).withColumn("own", F.col("row.doc_id"))
    rows = rows.join(kept, F.col("own").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("text_sha256")), "left_semi")
    return rows.dropDuplicates(["own", "sha"]).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, whether its ids are null or repeat or not; equal rows are one document.

    Texts without words are alone and stay; an empty table stays empty.
    """
    session.tune(spark)
    found = near_dedup.near_duplicates(docs)
    kept = found.filter("kept").select("id", "text_key").distinct()
    rows = held(docs).withColumn("key", F.xxhash64("row.text")).withColumn("own", F.col("row.doc_id"))
    rows = rows.join(kept, F.col("own").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key")), "left_semi")
    return rows.dropDuplicates(["own", "key"]).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    Null and empty texts are one piece, the end id; null and repeated ids have pieces of their own; an empty table gives none.
    """
    session.tune(spark)
    rows = packing.pieces(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=SEQUENCE)
    rows = session.cut(rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.pack(rows, SEQUENCE, ["doc_id", "piece", "start"])


STAGES = [
    ("language_id", known_language),
    ("quality_classifier", good_quality),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("best_fit_packing", packed),
]

#: SQL can't express language inference, the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next. An empty table gives no pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = session.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
