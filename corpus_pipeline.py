"""Corpus preparation: quality, exact and near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes what
each returns as Parquet in the shared folder and reads it again for the next. All stages but the
last return the columns of documents; a document is a row, and its doc_id may be null or repeated.
Null texts count as empty in every stage; an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.llm import quality
from culvert.llm.decontaminate import decontaminate
from culvert.llm.exact_dedup import exact_dedup
from culvert.llm.exchange import deleted, settled, written
from culvert.llm.ngram_join import ngram_jaccard_components
from culvert.llm.packing import pack
from culvert.llm.queries import table, word_bpe

#: Scores below this are of documents to reject.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (9) does not reject. Labels of rows whose crc32 of the
    id is 0 modulo 5 are not learned from."""
    learned = docs.filter(~quality.held_out("doc_id", 5, 0))
    weights = quality.fit(learned, table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).filter(F.col("score") >= LEAST_QUALITY).select(docs.columns)


def _one_each(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row of rows for each key, the longest text first: columns."""
    length = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), length).alias("row"))
    return best.select(*(F.col("row")[c].alias(c) for c in columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (8). The operator keeps all rows of a group that have
    the id to keep, or no id where that is null; of those the one with the most code points stays."""
    found = written(exact_dedup(docs).filter("kept").select(*docs.columns, "text_sha256", "group_size"))
    alone = found.filter("group_size = 1").select(docs.columns)
    return alone.unionByName(_one_each(found.filter("group_size > 1"), "text_sha256", docs.columns))


def _text_code() -> Column:
    """Names a text, where doc_id may be null or repeated: 64 bits, as the operators' own codes."""
    return F.xxhash64(F.lit("text"), F.col("text").cast("string"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-equal texts (10): of the smallest doc_id, null last; of the
    texts with that id, any. Empty texts stay. The component is of the text, whatever the row's id."""
    keyed = docs.withColumn("text_code", _text_code())
    parts = ngram_jaccard_components(keyed.select(F.col("text_code").alias("doc_id"), "text"), width=5, percent=75)
    parts = parts.select(F.col("doc_id").alias("text_code"), "n_shingles", "component_id").distinct()
    rows = keyed.groupBy("text_code", "doc_id").agg(F.count("*").alias("n")).join(parts, "text_code")
    rows = written(rows.select(F.col("doc_id").alias("own_id"), "text_code", "n", "n_shingles", "component_id"))
    first = F.min(F.struct(F.col("own_id").isNull().alias("last"), "own_id", "text_code", "n")).alias("f")
    first = rows.filter("n_shingles > 0").groupBy("component_id").agg(first).select("f.own_id", "f.text_code", "f.n")
    blank = rows.filter("n_shingles = 0").select("own_id", "text_code", F.lit(1).alias("n"))
    stays = written(first.unionByName(blank).withColumnRenamed("text_code", "own_code"))
    same = lambda own: (keyed.text_code == own.own_code) & keyed.doc_id.eqNullSafe(own.own_id)
    once, repeated = stays.filter("n = 1"), stays.filter("n > 1")
    kept = keyed.join(once, same(once), "left_semi").select(docs.columns)
    if repeated.isEmpty():
        return kept
    return kept.unionByName(_one_each(keyed.join(repeated, same(repeated), "left_semi"), "text_code", docs.columns))


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs (4), by their texts, whatever their ids."""
    keyed = docs.withColumn("text_code", _text_code())
    found = decontaminate(keyed.select(F.col("text_code").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), width=10, near=False)
    gone = found.filter("contaminated").select(F.col("doc_id").alias("text_code")).distinct()
    return keyed.join(gone, "text_code", "left_anti").select(docs.columns)


def pack_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids (1), with their ids."""
    return pack(docs, word_bpe(), with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmarks),
    ("packing", pack_all),
]
#: The classifier and the tokenizer can't be written in SQL; tests/llm holds the stages against
#: plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote on its way is deleted once its result is
    written, and that one when the next is; the tables of the last stage stay, as its rows are lazy."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, new = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if path:
            deleted(spark, path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
