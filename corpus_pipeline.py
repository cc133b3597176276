"""A training corpus from documents: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it as Parquet to the shared
folder and reads it again for the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.llm.common import scratch, set_aside, table, written_order
from chronosift.llm.langid import UNKNOWN, identify
from chronosift.llm.line_dedup import remove_runs
from chronosift.llm.near_dedup import BROADCAST_IDS, near_duplicates
from chronosift.llm.packing import pack_documents
from chronosift.llm.pfair_mix import mix

#: Target weights of the mixture by source; None: bytes to the power 1 / 2.
WEIGHTS = None


#: Phrases (behind the first) a letter of the best language from which on a text is in none of the languages
#: learned. Their own texts have about 0.17; an unknown script has 1.
FOREIGN = 0.6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts, texts without letters, and those that no language parses.

    A text whose best language needs more than FOREIGN phrases a letter goes, if there are labelled texts to
    learn from at all; without any, only letterless texts go. A null lang becomes the language found; others stay.
    Repeated rows meet the same fate; an empty table stays empty; extra columns stay, whatever their names.
    """
    names = [f"__{x}" for x in ("lang", "sure", "rate")]
    while set(names) & set(docs.columns):
        names = [f"_{x}" for x in names]
    found, sure, rate = names
    marked = identify(docs, learn=F.lit(True), keep=docs.columns, found=found, sure=sure, rate=rate)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    stays = F.when(F.col(found) == UNKNOWN, letters).otherwise(F.col(rate) <= FOREIGN)
    known = F.coalesce("lang", F.when(F.col(found) != UNKNOWN, F.col(found)))
    return marked.filter(stays).select(*[known.alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def _aside(stage):
    """The stage on documents whose extra columns have names that it doesn't work with."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        renamed, aside = set_aside(docs, ["doc_id", "text", "lang", "source", "n_chars"])
        return stage(spark, renamed, sf_dir).withColumnsRenamed(aside).select(*docs.columns)

    run.__doc__, run.__name__ = stage.__doc__, stage.__name__
    return run


@_aside
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated runs of lines, and documents of which nothing else was left.

    The first occurrence of a run stays (by doc_id, then text, then place); rows of one id and text lose the same; a null text
    stays null and its row stays; n_chars follows where a text changed; an empty table stays empty; extra columns stay, whatever their names.
    """
    # the row number keeps the optimiser from working the text out again for each use in the filter
    lean = remove_runs(docs).withColumn("__at", F.monotonically_increasing_id()).filter((F.col("__at") >= 0) & ((F.col("removed_runs") == 0) | (F.trim("text") != "")))
    n = F.when(F.col("removed_runs") > 0, F.char_length("text").cast("long"))
    return lean.withColumn("n_chars", F.coalesce(n, F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (the least id), and one row of each id.

    Of rows with one id the first by a hash of all columns stays; rows with a null id stay, and so do null and
    wordless texts; an empty table stays empty; extra columns stay, whatever their names.
    """
    gone = scratch(near_duplicates(docs).filter("NOT kept").select("doc_id").distinct(), "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    several = scratch(kept.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "several")
    if not several.isEmpty():
        one = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
        kept = kept.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("row.*"))
    return kept.select(*docs.columns)


@_aside
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents into the order of the mixture; files and rows follow it.

    A null source is a source of its own; ties in a source go by hash; every row stays, repeated ones too; an empty table
    stays empty; extra columns stay, whatever their names.
    """
    return mix(docs, WEIGHTS).repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens, which follow the written order.

    A null or empty text is its end token; repeated rows are packed each; an empty table gives no rows; other columns go.
    """
    placed, n = written_order(docs.select("doc_id", "text"), "__mixed")
    return pack_documents(placed, position="__mixed", positions=n).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL expresses none of language ID, chosen paths and packing; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
