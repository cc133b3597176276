"""Ranked lexical search over document shards with precomputed integer impacts.

A document's words are those of common.cut_words. One pass counts N, the documents with at least one word, and L,
all their words with repeats. A second pass cuts the documents into shards of at most SHARD_BYTES of text (or one longer
text) and writes one row a shard: its ids, its sorted terms, and postings in compressed rows (`starts` of each
term, `docs` within the shard, `impacts`). With n words in a document, m = 25 + (75 n N) div L, and a posting's impact is
(10^9 tf) div (1000 tf + 8 m): it depends on no other document but by N and L, so the index holds it ready.

A search takes its items in blocks of at most BLOCK_BYTES of text (or one longer item), each of which goes to all shards. The
documents that hold a block's terms are counted first (df, from `starts` alone); w = floor(1000 ln((2 N + 2) / (2 df + 1))).
Then each shard adds up an item's terms one at a time in a dense array, w times impact times the term's repeats in the item, and
keeps the k best: by argpartition, and where more than k reach the k-th score, those of the least ids. A
window with a limit merges the shards' rows; no task sees more than k rows of each shard it merges.

Defined results: null and empty texts, and texts without words, are no documents and match nothing; rows with equal ids are documents of their
own; a null id ranks behind others of its score; equal item rows are one item, rows of one item_id with different
texts are items of their own; items without words, and terms that no document holds, give no rows; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, cut_words, rank_within, small_batches

#: Text of a shard, and of a block of items with ITEM_BYTES counted for each besides.
SHARD_BYTES, BLOCK_BYTES, ITEM_BYTES = 2 << 20, 1 << 20, 256
#: Shards in a row group of the index: a reader decodes a group whole, and Parquet's own limit comes after 100 shards at the earliest.
GROUP_SHARDS = 4
_SHARD = "ids array<long>, terms array<binary>, starts array<int>, docs array<int>, impacts array<int>"


@dataclass
class Index:
    """A written index and what holds for all of it."""

    shards: DataFrame
    documents: int
    words: int


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The values of a column of arrays in its first row."""
    column = batch.column(name)
    return column.values.slice(column.offsets[0].as_py(), column.offsets[1].as_py() - column.offsets[0].as_py())


def _ints(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def postings(texts: pa.Array, documents: int, words: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted terms, the start of each term's postings, and the postings' rows and impacts."""
    said, n = cut_words(texts)
    coded = said.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    keys, tf = np.unique(place[np.asarray(coded.indices)] * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
    term, row = np.divmod(keys, max(1, len(n)))
    m = 25 + (75 * n.astype(np.int64) * documents) // max(1, words)
    tf = tf.astype(np.int64)
    return coded.dictionary.take(pa.array(order)), np.searchsorted(term, np.arange(len(order) + 1)), row, (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])


def build_index(docs: DataFrame, tables: Tables, *, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents, written to the shared folder."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = words = 0
            for part in small_batches([batch], "text"):
                n = cut_words(part.column("text"))[1]
                held, words = held + np.count_nonzero(n), words + int(n.sum())
            yield pa.RecordBatch.from_pydict({"documents": pa.array([held], pa.int64()), "words": pa.array([words], pa.int64())})

    found = rows.select("text").mapInArrow(count, "documents long, words long").agg(F.sum("documents"), F.sum("words")).head()
    documents, words = (int(x or 0) for x in found)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, "text", SHARD_BYTES):
            terms, starts, row, impacts = postings(part.column("text"), documents, words)
            if len(terms):
                yield pa.RecordBatch.from_arrays(
                    [_ints(part.column("id"), pa.int64()), _ints(terms, pa.binary()), _ints(starts, pa.int32()), _ints(row, pa.int32()), _ints(impacts, pa.int32())],
                    ["ids", "terms", "starts", "docs", "impacts"],
                )

    return Index(tables.store(rows.mapInArrow(build, _SHARD), "lexical-index", group_rows=GROUP_SHARDS), documents, words)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best scores above 0, of equal ones those with the least ids (ids sort as given)."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        said = scores[found]
        least = said[np.argpartition(said, len(said) - k)[len(said) - k]]
        over, level = found[said > least], found[said == least]
        found = np.concatenate((over, level[np.argsort(ids[level], kind="stable")[: k - len(over)]]))
    return found


def _block(rows: list, known: dict[bytes, int], documents: int) -> list[list[tuple[int, int]]]:
    """For each item its (term, weight) pairs; known has each term's df, documents is N."""
    place = {t: i for i, t in enumerate(known)}
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in known.items() if df}
    return [[(place[t], c * weight[t]) for t, c in terms.items() if weight.get(t)] for terms in rows]


def search(index: Index, items: DataFrame, tables: Tables, *, item_id: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item."""
    spark = items.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item"), F.coalesce(text, F.lit("")).alias("text")).distinct().withColumns({"all": F.lit(0), "bytes": F.octet_length("text") + ITEM_BYTES})
    n = asked.count()
    placed = rank_within(asked, "all", ["item", "text"], [(0, n)], weight="bytes", before="before", key_type="int")
    blocks = tables.store(placed.select("item", "text", "rank", F.floor(F.col("before") / BLOCK_BYTES).alias("block")), "items")
    merged = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = None
    for number in range((blocks.agg(F.max("block")).head()[0] if n else -1) + 1):
        held = blocks.filter(F.col("block") == number).orderBy("rank").collect()
        said, counts = cut_words(pa.array([r["text"] for r in held], pa.string()))
        words, at = said.to_pylist(), 0
        terms = []
        for c in counts:
            terms.append(Counter(words[at : at + c]))
            at += c
        every = sorted({t for x in terms for t in x})

        def holders(batches: Iterator[pa.RecordBatch], every=every) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(every), np.int64)
            wanted = pa.array(every, pa.binary())
            for batch in batches:
                for i in range(batch.num_rows):
                    part = batch.slice(i, 1)
                    starts = np.asarray(_column(part, "starts"))
                    place = pc.index_in(wanted, value_set=_column(part, "terms")).fill_null(-1).to_numpy()
                    df += np.where(place >= 0, starts[place + 1] - starts[place], 0)
            yield pa.RecordBatch.from_pydict({"term": pa.array(np.flatnonzero(df), pa.int32()), "df": pa.array(df[df > 0], pa.int64())})

        counted = {r["term"]: r["df"] for r in index.shards.select("terms", "starts").mapInArrow(holders, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        known = {t: counted.get(i, 0) for i, t in enumerate(every)}
        weights = _block(terms, known, index.documents)

        def rank(batches: Iterator[pa.RecordBatch], every=every, weights=weights) -> Iterator[pa.RecordBatch]:
            wanted = pa.array(every, pa.binary())
            for batch in batches:
                for i in range(batch.num_rows):
                    part = batch.slice(i, 1)
                    given = _column(part, "ids")
                    ids = given.fill_null(np.iinfo(np.int64).max).to_numpy()
                    starts, docs, impacts = (np.asarray(_column(part, c)) for c in ("starts", "docs", "impacts"))
                    place = pc.index_in(wanted, value_set=_column(part, "terms")).fill_null(-1).to_numpy()
                    query, rows, scores = [], [], []
                    for q, pairs in enumerate(weights):
                        total = np.zeros(len(ids), np.int64)
                        for t, w in pairs:
                            p = place[t]
                            if p >= 0:
                                s = slice(starts[p], starts[p + 1])
                                total[docs[s]] += impacts[s].astype(np.int64) * w
                        top = best(total, ids, k)
                        query.append(np.full(len(top), q, np.int32))
                        rows.append(top)
                        scores.append(total[top])
                    if query:
                        taken = np.concatenate(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), given.take(pa.array(taken)), pa.array(np.concatenate(scores))], ["query", "doc_id", "score"])

        found = index.shards.mapInArrow(rank, "query int, doc_id long, score long").withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= k)
        names = F.broadcast(blocks.filter(F.col("block") == number).select("item", F.col("rank").alias("nth")))  # as many as a block has
        first = held[0]["rank"] if held else 0
        ranked = found.withColumn("nth", F.col("query") + F.lit(first)).join(names, "nth").select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        ranked = tables.store(ranked, "ranked", keep=True)
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
