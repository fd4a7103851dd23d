"""A training-data pipeline over documents; STAGES run in order, each on all that its predecessor kept.

Language identification drops what no language fits (and labels rows without a language), the n-gram Jaccard join leaves one document of
each group of near copies, personal data get pseudonyms, sources are mixed to a temperature under which none is read more than
MAX_REPETITION times as often as another and none loses a document, and the byte-level BPE encodes what is left.

Defined cases: an empty table passes through; a row without a doc_id is kept unless it has no language; rows of a doc_id are one document,
which stays or goes as a whole, and its rows with equal texts leave one; columns beyond those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearwell import ship
from nearwell.llm import bpe, langid, mixing, ngram_jaccard, pii
from nearwell.llm.common import bounded_batches, materialize
from nearwell.llm.queries import ranks_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.2  # below it no language is near
MAX_REPETITION = 1.5
ORACLE_SQL = None  # profiles, keyed permutations and tokens are beyond SQL: the tests compare with brute force


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    bounded_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language (not `und`, score of MIN_SCORE or more); a null lang becomes the predicted one."""
    _prepare(spark)
    docs = docs.select(*COLUMNS)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    found = langid.predict(docs, langid.fit(docs.where(~held)))
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component; of a doc_id's rows with one text the least stays."""
    _prepare(spark)
    docs = docs.select(*COLUMNS)
    found = ngram_jaccard.components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    found = materialize(spark, found, "found")
    # as a merge join at every size: texts are dealt out once, and a doc_id of very many rows can be split
    kept = docs.join(found.where("component_id <> doc_id").select("doc_id").hint("merge"), "doc_id", "left_anti")
    repeated = materialize(spark, found.where("component_id = doc_id and rows > 1").select("doc_id"), "repeated")
    if repeated.take(1):
        one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("of"))
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(one.select("doc_id", "text", "of.lang", "of.source", "of.n_chars"))
    return kept.select(*COLUMNS)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms for personal data and secrets; n_chars follows the text."""
    _prepare(spark)
    out = pii.protect(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, so that the sources have the weights of the temperature mix; every document is read at least once."""
    _prepare(spark)
    return mixing.mix(docs.select(*COLUMNS), max_repetition=MAX_REPETITION, seed=1).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decodes (the bytes decoded from ids are the text's)."""
    _prepare(spark)
    coded = bpe.tokenised(docs.select("doc_id", "lang", "source", "text"), ranks_file())
    same = F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("decodes"))


STAGES = [("language identification", language), ("n-gram Jaccard join", near_duplicates), ("PII", privacy), ("source mixing", mixture), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage's are written as a table and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(spark, docs, f"stage{k}")
    return docs
