"""Product codes of vectors by weighted Lloyd rounds over distinct integer parts.

A component x becomes the integer floor(4096 x), a vector PARTS consecutive parts of equal length. Equal parts of a position
become one row with a weight, aggregated before the shuffle, so that copies of a vector cost nothing further. A codebook starts as
the parts of the ENTRIES least ids. Each round assigns the distinct rows to their codebook's nearest entry (ties to the
lower index) where they lie, and sends a count and the sums of each entry to the driver: PARTS x ENTRIES rows, added up
on the way. Entries become floors of means; unused ones stay. In the end codes and errors go back to the vectors by a join
on (position, part): values that more than one row in HEAVY holds are at most PARTS x HEAVY, are broadcast and shuffle
no vector; the others meet in a shuffle whose keys are all small. Labels are treated in the same way.

All arithmetic is exact: parts whose differences could overflow 64 bits are done in Python's integers.

Defined results: vectors that are null or hold a null or non-finite component are dropped, as are those of another length than most
(of equally many the shorter); a length that PARTS doesn't divide is filled up with zeros, which add no error; with fewer vectors than
ENTRIES there are as many entries; rows with equal ids, or copies, each get a row; a null id comes after all others; equal labels are summed,
nulls together; integers beyond 2^62 are held at that, and errors at 2^63 - 1; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

PARTS, ENTRIES, ROUNDS, SCALE, HEAVY = 8, 16, 6, 4096, 1000
_MOST, _LONG = 1 << 62, (1 << 63) - 1
_SLICE = 8192


def whole(x: Column) -> Column:
    """floor(SCALE x) as a long, held within 2^62."""
    scaled = F.floor(x * SCALE)
    return F.when(x.cast("double") >= _MOST / SCALE, F.lit(_MOST)).when(x.cast("double") <= -_MOST / SCALE, F.lit(-_MOST)).otherwise(scaled.cast("long"))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry and the squared distance, exactly."""
    limit = max((int(np.abs(x).max()) for x in (rows, book) if x.size), default=0)
    if 4 * limit * limit * max(1, rows.shape[1]) < _LONG:
        near = np.zeros((len(rows), len(book)), np.int64)
        for j in range(rows.shape[1]):
            near += (rows[:, j, None] - book[None, :, j]) ** 2
        own = near.argmin(axis=1)
        return own, near[np.arange(len(rows)), own]
    near = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in book] for r in rows], object).reshape(len(rows), len(book))
    own = np.array([int(np.argmin(r)) for r in near], np.int64)
    return own, np.array([min(int(near[i, j]), _LONG) for i, j in enumerate(own)], np.int64)


def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with their positions and their parts as a matrix."""
    for batch in batches:
        for s in range(0, batch.num_rows, _SLICE):
            some = batch.slice(s, _SLICE)
            yield some, some.column("at").to_numpy(), some.column("part").flatten().to_numpy().reshape(some.num_rows, length)


def _summed(length: int, books: list[np.ndarray]):
    """Counts and sums of the entries of all positions over a task's distinct rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [[0] * len(b) for b in books]
        total = [[[0] * length for _ in b] for b in books]
        for some, at, parts in _slices(batches, length):
            weight = some.column("weight").to_numpy()
            for p in np.unique(at):
                mine, w = parts[at == p], weight[at == p]
                own, _ = nearest(mine, books[p])
                exact = len(mine) == 0 or int(np.abs(mine).max()) * int(w.sum()) < _LONG
                for e in np.unique(own):
                    count[p][e] += int(w[own == e].sum())
                    held = mine[own == e], w[own == e, None]
                    sums = (held[0] * held[1]).sum(axis=0) if exact else (held[0].astype(object) * held[1].astype(object)).sum(axis=0)
                    total[p][e] = [a + int(b) for a, b in zip(total[p][e], sums, strict=True)]
        used = [(p, e) for p, c in enumerate(count) for e, n in enumerate(c) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in used], pa.int32()), pa.array([x[1] for x in used], pa.int32()), pa.array([count[p][e] for p, e in used], pa.int64()), pa.array([[Decimal(v) for v in total[p][e]] for p, e in used], pa.list_(pa.decimal128(38, 0)))],
            ["at", "entry", "n", "sums"],
        )

    return add


def _coded(length: int, books: list[np.ndarray]):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, at, parts in _slices(batches, length):
            own, error = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for p in np.unique(at):
                own[at == p], error[at == p] = nearest(parts[at == p], books[p])
            yield pa.RecordBatch.from_arrays([some.column("at"), some.column("part"), some.column("weight"), pa.array(own, pa.int32()), pa.array(error, pa.int64())], ["at", "part", "weight", "entry", "error"])

    return code


def join_weighted(rows: DataFrame, values: DataFrame, keys: list[str], total: int, heavy: int = HEAVY) -> DataFrame:
    """Inner join of rows with values, which have one row a key and its rows' number as `weight`.

    Keys that more than one row in `heavy` holds are fewer than heavy (a position): they are broadcast. Keys are never null.
    """
    often = values.filter(F.col("weight") * heavy > total).drop("weight")
    rare = values.filter(F.col("weight") * heavy <= total).drop("weight")
    told = [c for c in often.columns if c not in keys]
    first = rows.join(F.broadcast(often.withColumn("__often", F.lit(True))), keys, "left")
    done = first.filter(F.col("__often")).select(*rows.columns, *told)
    rest = first.filter(F.col("__often").isNull()).select(*rows.columns)
    return done.unionByName(rest.join(rare, keys).select(*rows.columns, *told))


def vector_codes(rows: DataFrame, tables: Tables, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, entries (an index a part), error, label_error of every vector kept; and the final codebooks, one a part."""
    spark = rows.sparkSession
    x = F.col("vector")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    good = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label")).filter(x.isNotNull() & finite)
    lengths = good.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").head(1)
    if not lengths:
        kind = rows.schema[label].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id long, label {kind}, entries array<int>, error long, label_error long"), []
    d, n = lengths[0]["d"], lengths[0]["n"]
    length = -(-d // parts)
    filled = F.concat(F.transform("vector", whole), F.array_repeat(F.lit(0).cast("long"), parts * length - d))
    # a number a row, fixed by being written
    kept = tables.store(good.filter(F.size("vector") == d).select(F.monotonically_increasing_id().alias("row"), "id", "label", filled.alias("whole")), "vectors")
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("at"), F.slice("whole", p * length + 1, length).alias("part"))))
    exploded = kept.select("row", cut.alias("v")).select("row", "v.at", "v.part")
    distinct = tables.store(exploded.groupBy("at", "part").agg(F.count(F.lit(1)).alias("weight")), "parts")

    first = kept.orderBy(F.asc_nulls_last("id"), "whole").select("whole").limit(entries).collect()
    start = np.array([r["whole"] for r in first], np.int64).reshape(len(first), parts, length)
    books = [start[:, p].copy() for p in range(parts)]
    for _ in range(rounds):
        sums = distinct.mapInArrow(_summed(length, books), "at int, entry int, n long, sums array<decimal(38,0)>")
        each = sums.groupBy("at", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(length)])
        for r in each.collect():  # parts x entries rows at most
            books[r["at"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(length)]

    coded = tables.store(distinct.mapInArrow(_coded(length, books), "at int, part array<long>, weight long, entry int, error long"), "coded")
    told = join_weighted(exploded, coded, ["at", "part"], n)
    held = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG)).cast("long")
    each = told.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda e: e["entry"]).alias("entries"), held.alias("error"))
    found = tables.store(kept.select("row", F.col("id").alias("vec_id"), "label").join(each, "row").drop("row"), "codes")
    named = found.withColumns({"__null": F.col("label").isNull(), "__label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    labels = tables.store(named.groupBy("__null", "__label").agg(F.count(F.lit(1)).alias("weight"), held.alias("label_error")), "labels")
    out = join_weighted(named, labels, ["__null", "__label"], n).select("vec_id", "label", "entries", "error", "label_error")
    return tables.store(out, "coded-vectors", keep=True), books


def books_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries' components, by part, entry and position within the part."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()
