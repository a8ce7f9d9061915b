"""A corpus pipeline: each stage applies one operator to all documents that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All stages but the last return the columns of documents. The last returns one row of token and text digests per document
copy. SQL can express neither the classifiers nor the mixing; the tests hold the pipeline against a plain version.

Defined results: a null or empty text is judged like any other, grouped with nothing and, having no words, left out of the
mix; a null id is no document of a group and stays; rows that repeat an id and a text are one document from the third
stage on; texts of any length go through whole; an empty table gives an empty result; further columns, whatever their
names, reach the last stage, which returns digests alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, jaccard_join, mixture, quality_classifier, toxicity
from quernstone.session import table, written

TOKENIZER = "word_bpe_49k.json"
QUALITY_FROM = 0.3
TOXIC_FROM = 0.7


def _free(docs: DataFrame, name: str) -> str:
    """``name`` with underscores in front, until no column of the documents has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model, score = quality_classifier.train(docs, table(spark, sf_dir, "labels")), _free(docs, "score")
    return quality_classifier.add_scores(docs, model, score).where(F.col(score) >= QUALITY_FROM).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model, score = toxicity.train(docs, table(spark, sf_dir, "labels")), _free(docs, "score")
    return toxicity.add_scores(docs, model, score).where(F.col(score) < TOXIC_FROM).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; a document without an id stays.

    A document is an id with a text: texts that share an id are grouped by what they hold. Of rows that agree in both, and
    of texts of one group that share its smallest id, one stays by a fixed order.
    """
    # the whole row stands aside, so that its columns' names are free
    hashed = docs.where("doc_id IS NOT NULL").select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    # an id is its own key; only further texts of a reused one get hashes, so that the join sees ids in their order
    several = hashed.groupBy("doc_id").agg(F.min("h").alias("first"), F.max("h").alias("last")).where("first <> last")
    key = F.when(F.col("h") == F.coalesce("first", "h"), F.col("doc_id")).otherwise(F.xxhash64("doc_id", F.col("row.text")))
    named = hashed.join(written(several.select("doc_id", "first"), "reused"), "doc_id", "left").select("row", "doc_id", key.alias("key"))
    groups = jaccard_join.join_components(named.select("key", F.col("row.text").alias("text")), id_column="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    stay = groups.join(named.select("key", "doc_id").distinct(), "key").groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("least")).select("least.key")
    single = named.join(stay, "key").groupBy("key").agg(F.min("row").alias("row")).select("row.*")
    return single.select(*docs.columns).union(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    words = _free(docs, "words")
    # the mix replaces columns that are called like those it adds, so the documents' own go through it under other names
    own = {c: _free(docs, "_" + c.lower()) for c in docs.columns if c.lower() in ("source_size", "target", "rate", "copies", "taken")}
    mixed = mixture.mix(docs.withColumnsRenamed(own).withColumn(words, mixture.word_count("text")), size_column=words)
    many = mixed.where("copies > 0").withColumn(words, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return many.drop("source_size", "target", "rate", "copies", "taken").withColumnsRenamed({new: old for old, new in own.items()}).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", one_of_each_group),
    ("mixing sources", mix_sources),
    ("bpe encode and decode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, f"stage{at}")
    return docs
