"""Sharding by a k-d tree over document metadata.

Dimensions are the logarithms of a document's bytes and characters, and its language and source, as places
that hashes of the whole names give, so that each name is a point of its own. Each dimension counts in units of its range over all rows. A node that must hold
k shards is cut along the dimension in which it is widest, at the distributed weighted quantile floor(k/2)/k of
its bytes, until every leaf holds one shard. A quantile is found by histograms: over the dimension, twice, the second
time within the bin that holds it, then, for ties, over text hashes, and at last over row hashes; so equal values
and equal texts part only where a cut falls among them, and a value
that a third of all rows share is cut as finely as any other. Each histogram is a partial
aggregate, and the driver sees at most `bins` rows a node; nothing else reaches it. Each level is a table of its own.

Defined results: a null text counts as empty (8 bytes); null names as empty strings; columns of names may lack; rows with equal id and text stay together; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, rank_within, small_frame

BINS, STEPS = 1024, 4


def _place(name: Column) -> Column:
    """A whole name's place among all that there could be: the upper 53 bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(name, F.lit(""))), 11).cast("double") / float(1 << 53)


def metadata(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, hashes and the dimensions: log bytes, log characters, places of the names."""
    whole = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(whole).cast("long") + 8
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.encode(whole, "utf-8")).alias("text_crc32"),
        F.xxhash64(whole).alias("text_hash"),
        F.xxhash64(F.col(doc_id), whole).alias("row_hash"),
        F.array(F.log2(size.cast("double")), F.log2(F.char_length(whole) + 1.0), *[_place(F.col(c)) for c in names if c in docs.columns]).alias("dims"),
    )


def _cut(sums: dict[int, float], target: float) -> tuple[int, float]:
    """The bin that holds the target, and what of the target lies within it."""
    before = 0.0
    for b in sorted(sums):
        if before + sums[b] > target or b == max(sums):
            return b, target - before
        before += sums[b]
    return 0, 0.0


def _ranges(rows: DataFrame, n_dims: int) -> list:
    """Bytes and range of each dimension of every node."""
    sides = [f(F.col("dims")[i]).alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("node").agg(F.sum("size").alias("total"), *sides).collect()


def kd_shards(docs: DataFrame, shards: int = 24, *, doc_id: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("lang", "source"), bins: int = BINS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; sizes of shards are near equal."""
    spark = docs.sparkSession
    tables = Tables(spark)
    rows = tables.store(metadata(docs, doc_id, text, names).withColumn("node", F.lit(1).cast("long")), "kd")
    n_dims = 2 + sum(c in docs.columns for c in names)
    open_nodes, leaves, unit = {1: (shards, 0)}, {}, None
    while open_nodes:
        leaves |= {n: first for n, (k, first) in open_nodes.items() if k == 1}
        open_nodes = {n: v for n, v in open_nodes.items() if v[0] > 1}
        stats = _ranges(rows.filter(F.col("node").isin(list(open_nodes))), n_dims) if open_nodes else []
        if not stats:  # all leaves, or no rows at all
            break
        unit = unit or [max(stats[0][f"hi{i}"] - stats[0][f"lo{i}"], 1e-12) for i in range(n_dims)]
        boxes = {}
        for s in stats:
            wide = max(range(n_dims), key=lambda i: (s[f"hi{i}"] - s[f"lo{i}"]) / unit[i])
            k = open_nodes[s["node"]][0]
            boxes[s["node"]] = [wide, s[f"lo{wide}"], max(s[f"hi{wide}"] - s[f"lo{wide}"], 1e-12), s["total"] * (k // 2) / k]
        box = small_frame(spark, [(n, b[0], b[1], b[2]) for n, b in boxes.items()], "node long, __dim int, __lo double, __width double")
        fine = F.least(F.floor((F.element_at("dims", F.col("__dim") + 1) - F.col("__lo")) / F.col("__width") * bins * bins), F.lit(bins * bins - 1)).cast("int")
        hashed = lambda c: F.shiftrightunsigned(c, 54).cast("int")
        placed = rows.join(F.broadcast(box), "node", "left").withColumn("b1", fine)
        placed = placed.withColumns({"b0": F.floor(F.col("b1") / bins).cast("int"), "b2": hashed("text_hash"), "b3": hashed("row_hash")}).drop("__dim", "__lo", "__width")
        found: dict[int, list[int]] = {n: [] for n in boxes}
        left = {n: b[3] for n, b in boxes.items()}
        for step in range(STEPS):
            inside = placed.filter(F.col("b0").isNotNull())
            if step:
                cuts = small_frame(spark, [(n, *c) for n, c in found.items()], "node long, " + ", ".join(f"__c{i} int" for i in range(step)))
                inside = placed.join(F.broadcast(cuts), "node")
                for i in range(step):
                    inside = inside.filter(F.col(f"b{i}") == F.col(f"__c{i}"))
            sums: dict[int, dict[int, float]] = {}
            for r in inside.groupBy("node", f"b{step}").agg(F.sum("size").alias("w")).collect():
                sums.setdefault(r["node"], {})[r[f"b{step}"]] = r["w"]
            for n in boxes:
                b, rest = _cut(sums[n], left[n])
                if step == STEPS - 1 and rest * 2 > sums[n][b]:  # the nearer edge of the last bin
                    b += 1
                found[n].append(b)
                left[n] = rest
        cuts = small_frame(spark, [(n, *c) for n, c in found.items()], "node long, " + ", ".join(f"__c{i} int" for i in range(STEPS)))
        below = F.struct(*[F.col(f"b{i}") for i in range(STEPS)]) < F.struct(*[F.col(f"__c{i}").alias(f"b{i}") for i in range(STEPS)])
        child = F.when(F.col("__c0").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(below, 0).otherwise(1))
        rows = tables.store(placed.join(F.broadcast(cuts), "node", "left").withColumn("node", child).select(*rows.columns), "kd")
        for n in boxes:
            k, first = open_nodes.pop(n)
            open_nodes |= {2 * n: (k // 2, first), 2 * n + 1: (k - k // 2, first + k // 2)}
        open_nodes = {n: v for n, v in open_nodes.items() if n // 2 in boxes}
    leaf = small_frame(spark, [(n, first) for n, first in leaves.items()] or [(0, 0)], "node long, shard int")
    sharded = tables.store(rows.join(F.broadcast(leaf), "node").select("doc_id", "size", "text_crc32", "row_hash", "shard"), "kd-shards", keep=True)
    tables.drop()
    counts = [(r["shard"], r["count"]) for r in sharded.groupBy("shard").count().collect()]
    ranked = rank_within(sharded, "shard", ["row_hash", "doc_id"], counts or [(0, 0)], rank="slot", key_type="int")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
