"""The corpus pipeline: quality filter, language filter, near-duplicate removal, packing.

Each stage takes the documents that its predecessor kept; all but the last return the columns they were given, whatever
these are. What a stage returns is written as a Parquet table in the shared folder and read again for the next one. A
table without rows goes through all stages and comes out without rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import language_id, ngram_join, packing, quality
from sparkloom.llm.common import crc32_mod, drop_table, materialize, table
from sparkloom.llm.queries import with_crc32

#: A document goes where its quality is below this.
MIN_QUALITY = 0.5
#: Documents are near duplicates from this Jaccard coefficient of their word shingles on; op6's own contract is 3, 90.
SHINGLE_WORDS, PERCENT = 5, 80


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of quality 0.5 or more; labels of the corpus are joined to what is there.

    A row is judged by its text alone: null and empty texts get the score of an empty passage, repeated rows stay or go
    together, null ids are no hindrance (they have no label). Without any label all rows stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", lambda i: crc32_mod(i, 3) != 1)
    return quality.keep(docs, model, MIN_QUALITY)


def filter_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a learned language; ``und`` goes (null and empty texts, texts without a letter), and so does text that no
    language claims, as it is no nearer to what was learned than chance would have it. Repeated rows stay or go together, null ids are no hindrance. Without any lang all rows stay."""
    model = language_id.fit(docs, lambda i: crc32_mod(i, 5) != 0)
    return language_id.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest id, one without an id last; of equal rows, one.

    Rows are grouped by their texts: an id with several texts may have several survivors, and a null id may have one.
    Null and empty texts are near duplicates of nothing but rows that are equal in id and text."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").isEmpty():
        groups = materialize(ngram_join.ngram_jaccard_join(docs, k=SHINGLE_WORDS, percent=PERCENT))
        # Ids of kept documents have no bound, so they are merged with, never broadcast.
        return docs.join(groups.where("doc_id = component_id").select("doc_id").hint("merge"), "doc_id", "left_semi").select(docs.columns)
    # Ids that don't tell the rows apart: a hash of id and text does.
    keyed = docs.withColumn("row_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    groups = ngram_join.ngram_jaccard_join(keyed, "row_key", k=SHINGLE_WORDS, percent=PERCENT)
    groups = materialize(groups.groupBy("row_key").agg(F.min("component_id").alias("component_id"), F.count("*").alias("c")))
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key", "c")
    first = keyed.select("row_key", "doc_id").join(groups.hint("merge"), "row_key").groupBy("component_id").agg(F.min(rank).alias("first"))
    kept = materialize(first.select("first.row_key", "first.c"))
    out = keyed.join(kept.where("c = 1").hint("merge"), "row_key", "left_semi")
    repeated = keyed.join(kept.where("c > 1").hint("merge"), "row_key", "left_semi").dropDuplicates(["row_key"])
    return out.unionByName(repeated).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, as op10 returns them; null and empty texts are one token, repeated rows are packed each."""
    return with_crc32(packing.pack_documents(docs))


STAGES = [("quality classifier", filter_quality), ("language identification", filter_language), ("n-gram Jaccard join", drop_near_duplicates), ("packing", pack)]

#: Learned classifiers and a tokenizer are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    kept = None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if kept is not None:
            drop_table(kept)
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)
