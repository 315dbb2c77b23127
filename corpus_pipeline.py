"""Documents to packed training sequences, in five stages.

Null and empty texts have no evidence of toxicity, are equal to each other and to blank ones in exact dedup, have no near
copies and no personal data, and are packed as one end token. Null ids are ids of their own. Of repeated rows one stays.
Very long texts are read whole, an empty table gives no sequences, and other columns stay as they are, whatever their
names, until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmat.llm import bitmap, exact_dedup, ngram_join, packing, pii, scratch, toxicity
from quillmat.llm.queries import pii_key, tokenizer


def chosen(docs: DataFrame, decided: DataFrame, once: bool = True) -> DataFrame:
    """Rows of ``docs`` whose id and text ``decided`` (doc_id, text_md5, kept) keeps.

    Where a row is kept and another with the same id and text is not, one of them stays (``once``); any, if other
    columns differ. Only rows that may be dropped, by a bitmap of those that are, are joined; the others' texts aren't
    sent anywhere.
    """
    decided = scratch.table(decided.select("doc_id", "text_md5", "kept"), "decided")
    own, number, text = (bitmap.free(docs, x) for x in ("_md5", "_id", "_kept"))
    key = lambda text: F.xxhash64("doc_id", text)
    rows = docs.withColumn(own, F.md5(F.coalesce("text", F.lit(""))))
    gone = decided.where("NOT kept").select(key("text_md5").alias("_hash"))
    bits = bitmap.sized(gone.count())
    keep = bitmap.thinned(decided.where("kept"), key("text_md5"), gone, bits).select(F.col("doc_id").alias(number), F.col("text_md5").alias(text))
    same = F.col("doc_id").eqNullSafe(F.col(number)) & (F.col(own) == F.col(text))
    return bitmap.within(rows, key(own), gone, keep, same, ["doc_id", own] if once else None, bits).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return chosen(docs, toxicity.score(docs, labels).withColumn("kept", F.col("predicted") == 0), once=False)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks the longest stays."""
    return chosen(docs, exact_dedup.dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles link at 0.8 or more the document with the smallest id stays."""
    return chosen(docs, ngram_join.link(docs, n=5, num=80, den=100))


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms under the key that the session's ``spark.quillmat.pii.secret`` holds in hexadecimal."""
    return pii.pseudonymise(docs, pii_key(spark), count_col=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens. Workers that have run the stages before keep fewer stretches."""
    return packing.pack(docs, tokenizer(), kept=100_000)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("PII", hide_persons), ("best-fit packing", pack)]
#: SQL expresses neither the models nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again; what only a stage before needed is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left: list = []
    for name, step in STAGES[:-1]:
        with scratch.noted() as made:
            docs = scratch.table(step(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.delete(left + made[:-1])  # all but the stage's result
        left = made[-1:]
    out = STAGES[-1][1](spark, docs, sf_dir)  # has read its input by now
    scratch.delete(left)
    return out
