"""Approximate nearest neighbours by adaptive dimension scan within inverted lists.

Largest inner products become least distances by one more component: vectors are divided by the greatest norm and a
vector x gets sqrt(1 - |x|^2); a query, whose length doesn't matter, is divided by its own and gets 0. A random rotation
then spreads every difference evenly over the components, which are kept in column blocks. Lists come from k-means on a
bounded sample, but every vector is in its list and every list is complete.

A query first scans its NEAR nearest lists in full; its k-th best there is its limit. Any other list is
probed unless the hypothesis that it holds something within the limit is untenable: a member at
distance r from the centre c is at sqrt(|q - c|^2 + r^2 - 2 s |q - c| r / sqrt(D)) for a cross term s that is near standard
normal after the rotation, and a list is left out if even s = REACH_Z leaves all r of the list beyond the limit. Within
a list the distances to all candidates are built up block by block: after d of D
components a candidate is abandoned if sqrt(D / d * partial) exceeds (1 + EPSILON / sqrt(d)) times
the query's limit. What survives is scored by the exact inner product of the original vectors, in double precision.

Lists grow with the root of the number of vectors, and are dealt out in blocks of at most BLOCK_ROWS vectors; queries
go to every block of their lists, so a vector that a third of all rows share is many tasks' work. A task holds
one block of vectors while queries stream past it. Each block keeps a query's k best.

Defined results: vectors that are null, zero or hold a null or non-finite component, or are of
another length than most, take no part; equal scores go to the smaller id; rows with equal ids are
separate candidates, but none is a candidate of a query with its id; equal query rows are one query, and rows of one id
with different vectors are queries with ranks of their own; inner products that overflow are infinite scores (where they
cancel out, the lowest); with fewer than k candidates all are found; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

#: Vectors that k-means is fitted on (in expectation), lists at most, and rounds.
SAMPLE_ROWS, MAX_LISTS, ROUNDS = 20_000, 4096, 8
#: A list has LIST_ROWS vectors at least, else LIST_ROOT times the root of the number of all.
LIST_ROWS, LIST_ROOT, NEAR, BLOCK_ROWS, COLUMNS, EPSILON, REACH_Z = 400, 4, 4, 4096, 16, 2.1, 1.5


#: One pair in so many of a block is many.
DENSE = 8
#: Values that pairs of a query and a vector gather at a time.
PAIR_VALUES = 1 << 21


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    near = (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.argpartition(near, k - 1, axis=1)[:, :k] if k < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))


def fit(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """k-means centres of a sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([_nearest(sample[s : s + 8192], centres)[:, 0] for s in range(0, len(sample), 8192)])
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow on the way."""
    big = np.abs(x).max(axis=1)
    return big * np.sqrt(((x / big[:, None]) ** 2).sum(axis=1))


def probes(near: np.ndarray, limit: np.ndarray, least: np.ndarray, most: np.ndarray, d: int, z: float = REACH_Z) -> np.ndarray:
    """Which lists (columns) may hold something within each query's limit, by squared distances to their centres."""
    side = np.sqrt(np.maximum(near, 0))
    slope = z / np.sqrt(d) * side
    r = np.clip(slope, least[None, :], most[None, :])
    return near + r * r - 2 * slope * r <= (limit**2)[:, None] + 1e-9


def _by_pairs(f, q: np.ndarray, v: np.ndarray, width: int, most: int = PAIR_VALUES) -> np.ndarray:
    """f over pairs of rows, so many pairs at a time that what it gathers stays within `most` values."""
    step, out = max(1, most // max(1, width)), np.empty(len(q))
    for s in range(0, len(q), step):
        out[s : s + step] = f(q[s : s + step], v[s : s + step])
    return out


def scan(queries: np.ndarray, limit: np.ndarray, vectors: np.ndarray, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) index pairs of rotated vectors that survive the adaptive scan against limits."""
    d = vectors.shape[1]
    part = None
    q = v = None
    for s in range(0, d, columns):
        e = min(s + columns, d)
        a, b = queries[:, s:e], vectors[:, s:e]
        if part is None:
            near = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
            bound = limit**2 * (1 + epsilon / np.sqrt(e)) ** 2 * e / d + 1e-9
            q, v = np.nonzero(near <= bound[:, None])
            part = near[q, v]
        else:
            if len(q) * DENSE > len(a) * len(b):  # most are still candidates: a product of matrices costs less than gathering rows
                part = part + np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)[q, v]
            else:
                part = part + _by_pairs(lambda i, j, a=a, b=b: ((a[i] - b[j]) ** 2).sum(axis=1), q, v, e - s)
            bound = limit**2 * ((1 + epsilon / np.sqrt(e)) ** 2 * e / d if e < d else 1 + 1e-9) + 1e-9
            keep = part <= bound[q]
            q, v, part = q[keep], v[keep], part[keep]
    return q, v


def _foremost(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that can be among the k best of their query: where there are many, those that a product of matrices puts near or above the k-th."""
    if len(q) * DENSE <= len(queries) * len(vectors) or len(vectors) <= k:
        return q, v
    with np.errstate(over="ignore", invalid="ignore"):
        about = queries @ vectors.T
        slack = 1e-9 * np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1]
    if not (np.isfinite(about).all() and np.isfinite(slack)):
        return q, v
    allowed = np.full(about.shape, -np.inf)
    allowed[q, v] = about[q, v]
    least = np.partition(allowed, len(vectors) - k, axis=1)[:, len(vectors) - k]
    keep = about[q, v] >= least[q] - slack
    return q[keep], v[keep]


def best(queries: np.ndarray, names: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of the k best of the pairs of each query; none with the query's own id."""
    q, v = pairs
    other = names[q] != ids[v]
    q, v = _foremost(queries, vectors, q[other], v[other], k)
    with np.errstate(over="ignore", invalid="ignore"):
        score = _by_pairs(lambda i, j: (queries[i] * vectors[j]).sum(axis=1), q, v, queries.shape[1])
    score = np.where(np.isnan(score), -np.inf, score)
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[v[keep]], score[keep]


def search(rows: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, near: int = NEAR, reach_z: float = REACH_Z, list_rows: int = LIST_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that each query finds, nearest first."""
    spark = rows.sparkSession
    good = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(usable(F.col("x")) & F.col("id").isNotNull())
    lengths = good.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").head(1)
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = lengths[0]["d"], lengths[0]["n"]
    good = scratch(good.filter(F.size("x") == d), "vectors")
    big = F.array_max(F.transform("x", F.abs))
    norm = big * F.sqrt(F.aggregate(F.transform("x", lambda v: v / big), F.lit(0.0), lambda s, v: s + v * v))
    longest = min(good.agg(F.max(norm)).head()[0], 1.7e308)
    turn = rotation(d + 1)
    share = min(1.0, SAMPLE_ROWS / n)
    drawn = good.filter(F.pmod(F.xxhash64("id", "x"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("id", "x").distinct().toPandas().sort_values("id")["x"]

    def turned(x: np.ndarray) -> np.ndarray:
        x = x / longest
        return np.column_stack([x, np.sqrt(np.maximum(1 - (x**2).sum(axis=1), 0))]) @ turn

    def asking(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x / norms(x)[:, None], np.zeros(len(x))]) @ turn

    lists = int(max(1, min(MAX_LISTS, n // max(list_rows, int(LIST_ROOT * n**0.5)))))
    centres = fit(turned(np.vstack(drawn.to_list())), lists) if len(drawn) else np.zeros((1, d + 1))

    def file_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.vstack(batch["x"].to_list())
                y = turned(x)
                own = _nearest(y, centres)[:, 0]
                yield pd.DataFrame({"list": own.astype(np.int32), "id": batch["id"], "raw": [r.tobytes() for r in x], "r": np.sqrt(((y - centres[own]) ** 2).sum(axis=1))})

    kinds = "list int, id long, raw binary"
    filed = scratch(good.select("id", "x").mapInPandas(file_, kinds + ", r double"), "lists")
    known = {r["list"]: (-(-r["n"] // BLOCK_ROWS), r["lo"], r["hi"]) for r in filed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}
    # an empty list is nearer than none
    least, most = (np.array([known.get(i, (0, np.inf, np.inf))[s] for i in range(len(centres))]) for s in (1, 2))
    filled = np.flatnonzero(np.isfinite(least))
    near = min(near, len(filled))

    def distances(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the centres of the lists that aren't empty, and which of these lists are nearest."""
        far = 1 + (centres[filled] ** 2).sum(axis=1)[None, :] - 2 * q @ centres[filled].T
        return far, np.argpartition(far, near - 1, axis=1)[:, :near]

    def asked(second: bool):
        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for s in range(0, len(batch), 256):
                    part = batch.iloc[s : s + 256]
                    x = np.vstack(part["x"].to_list())
                    far, first = distances(asking(x))
                    go = np.zeros(far.shape, bool)
                    np.put_along_axis(go, first, True, axis=1)
                    limit = np.full(len(x), np.inf)
                    if second:
                        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                            inner = part["least"].to_numpy(float) / norms(x) / longest
                        sure = (part["n"].to_numpy(float) >= k) & np.isfinite(inner)
                        limit[sure] = np.sqrt(np.maximum(2 - 2 * inner[sure], 0))
                        go = ~go & probes(far, limit, least[filled], most[filled], d + 1, reach_z)
                    q, at = np.nonzero(go)
                    raw = np.array([r.tobytes() for r in x], object)
                    yield pd.DataFrame({"list": filled[at].astype(np.int32), "id": part["id"].to_numpy()[q], "raw": raw[q], "qh": part["qh"].to_numpy()[q], "limit": limit[q]})

        return ask

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, block = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            keys, asks = batch["list"].to_numpy().astype(np.int64) << 32 | batch["block"].to_numpy(), batch["asks"].to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1
            for s, e in zip([0, *edges], [*edges, len(batch)], strict=True):
                part = batch.iloc[s:e]
                if keys[s] != key:
                    key, held, block = keys[s], [], None
                if not asks[s]:
                    held.append(part[["id", "raw"]])
                    continue
                if block is None:
                    if not held:
                        continue
                    own = pd.concat(held)
                    x = np.frombuffer(b"".join(own["raw"]), np.float64).reshape(-1, d)
                    block, held = (x, own["id"].to_numpy(), turned(x)), []
                x, ids, v = block
                for a in range(0, len(part), 256):
                    some = part.iloc[a : a + 256]
                    y, names, hashes = np.frombuffer(b"".join(some["raw"]), np.float64).reshape(-1, d), some["id"].to_numpy(), some["qh"].to_numpy()
                    q, found, score = best(y, names, scan(asking(y), some["limit"].to_numpy(float), v), x, ids, k)
                    yield pd.DataFrame({"query_id": names[q], "qh": hashes[q], "vec_id": found, "score": score})

    count = F.element_at(F.from_json(F.lit("{" + ",".join(f'"{x}":{b[0]}' for x, b in known.items()) + "}"), "map<string,int>"), F.col("list").cast("string"))
    stored = filed.select("list", "id", "raw").withColumns({"block": F.pmod(F.xxhash64("id", "raw"), count).cast("int"), "asks": F.lit(False), "qh": F.lit(None).cast("long"), "limit": F.lit(None).cast("double")})
    order = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")

    def found_in(queries: DataFrame, second: bool) -> DataFrame:
        sent = queries.mapInPandas(asked(second), kinds + ", qh long, limit double").withColumns({"block": F.explode(F.sequence(F.lit(0), count - 1)), "asks": F.lit(True)})
        dealt = stored.unionByName(sent).repartition("list", "block").sortWithinPartitions("list", "block", "asks")
        return dealt.mapInPandas(find, "query_id long, qh long, vec_id long, score double")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    queries = good.filter("asks").select("id", "x").distinct().withColumn("qh", F.xxhash64("x"))
    first = scratch(top(found_in(queries, False)).drop("rank"), "near-lists")
    limits = first.groupBy(F.col("query_id").alias("id"), "qh").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    others = found_in(queries.join(limits, ["id", "qh"], "left").na.fill({"n": 0}), True)
    return top(first.unionByName(others)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
