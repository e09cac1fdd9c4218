"""Corpus pipeline: language ID, near-dedup, decontamination, secret redaction, tokenisation.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever other columns docs has. Stages learn from, and judge, what the
one before kept. A row is named by its id and its text, so rows of one id with different texts are judged apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deltaloom.llm import bpe, decontaminate, langid, secrets, simhash
from deltaloom.llm._shared import small_batches, training_part, write_out

#: A document stays if its language is known and has at least this share of the probability.
LEAST_SCORE = 0.5
#: Row keys are broadcast up to this number (16 MB), and joined by shuffle beyond it.
BROADCAST_KEYS = 2_000_000
_KEY = "pipeline_row_key"


def _row_key() -> Column:
    """A long for a row's id and text; rows that repeat both share it."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_KEY, _row_key())


def _bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified.

    Null and empty texts, and those without a letter, go; very long ones are scored whole. A null id or lang stays (a null lang
    teaches nothing). Ties go to the smaller language name. Repeated rows are judged alike. An empty table stays empty.
    """
    small_batches(spark)
    held = F.coalesce(training_part(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held), "doc_id", "text", "lang")
    found = langid.identify(docs, model, carry=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Null and empty texts are equal to each other. Very long texts are compared whole. Rows that repeat id and text
    are one document, so one of them stays; of rows of one id with different texts each stays or goes by its own text. Rows with a null
    id cannot be named, are in no group and stay. Ties go to the smallest id. An empty table stays empty.
    """
    small_batches(spark)
    found = simhash.similar_documents(_keyed(docs.select("doc_id", "text")), carry=(_KEY,))
    marks = found.groupBy(_KEY).agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("n"))
    marks, _ = write_out(marks.where("not kept or n > 1").select(_KEY, "kept"), "pipeline-marks")
    gone, again = _bounded(marks.select(_KEY)), _bounded(marks.where("kept").select(_KEY))
    rows = _keyed(docs)
    once = rows.join(again, _KEY, "left_semi").dropDuplicates([_KEY])
    return rows.join(gone, _KEY, "left_anti").unionByName(once).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none. Very long texts are searched whole. Rows are judged each by its own text, those
    with a null id and repeated ones included. An empty table, or an empty benchmark, leaves all as it is.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(_keyed(docs.select("doc_id", "text")), items, id_col=_KEY)
    gone, _ = write_out(found.select(_KEY).distinct(), "pipeline-leaks")
    return _keyed(docs).join(_bounded(gone), _KEY, "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars counted anew.

    Null and empty texts stay as they are. Very long texts are scanned whole. Spans that overlap are masked once. Null ids and
    repeated rows stay. An empty table stays empty.
    """
    small_batches(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit integers), and digests of them and of the decoded text.

    Null and empty texts have no ids. Very long texts are encoded whole. Of equal ranks the leftmost pair is merged. Null
    ids stay, and so does every repeated row. An empty table gives an empty result.
    """
    small_batches(spark)
    coded = bpe.encode_decode(docs)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secret_scan), ("tokens", tokens)]
#: The stages hold trained models and hashes that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what lies between two stages is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = write_out(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
