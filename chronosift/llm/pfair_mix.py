"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of block_bytes. In the fluid schedule all sources are served
at once in proportion to their weights; block i of a source is due between the fluid times at
which i and i + 1 blocks of it are served. Rounded outward these are its release time and
deadline, and earliest-deadline-first gives every block a slot between them; so after any slot a
source is less than one block away from its share. A source that runs out leaves its share to
the others, in proportion to their weights; no row is dropped or repeated.

Weights are whole numbers w with a sum of at most PARTS times the number of blocks, but from UNIT to UNIT_MOST (shares are kept exactly where
they have so small a common denominator, else rounded by less than one part). So rounding adds less than 1 / PARTS of a block up
to UNIT_MOST / PARTS blocks, and less than one block in UNIT_MOST beyond. After every unit, in which each source is served w blocks, the
fluid schedule stands at whole blocks for all sources; so a unit's schedule depends on nothing but the number of blocks
that each source has left for it, and there are at most two different units a source plus one. Each of these is scheduled
by a task; a block finds its slot from its unit's place and its slot within. The block size is fixed,
whatever the corpus, and the driver holds one row of totals a source and the places of the different units.

With v the service per unit of weight, the fluid time is T(v) = sum of min(w v, n) over sources
of weight w and n blocks, which gives release times and deadlines in integer arithmetic.
Sources are ranked by hash chunks, so a source with a third of all rows is no single task's work.

Defined results: a null source is a source of its own; a null text counts as empty; every row
weighs its UTF-8 bytes plus 1; a row belongs to the block in which it begins, so a block within a longer text has a slot
without rows; rows keep all their columns (but for former ones of the three names); an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_within, running, scratch, set_aside, small_frame

BLOCK_BYTES, UNIT, UNIT_MOST, PARTS = 1 << 16, 1 << 14, 1 << 20, 16
#: Rows of a plan, or blocks, that may be broadcast; more are joined by a shuffle.
PLAN_ROWS = 100_000
#: Slots that one task of the prefix sum over slots adds up.
SLOTS = 4096


def windows(blocks: list[int], weights: list[int]) -> list[list[tuple[int, int]]]:
    """Release time and deadline of each block of each source."""
    order = sorted(range(len(blocks)), key=lambda s: blocks[s] / weights[s])
    out: list[list[tuple[int, int]]] = [[] for _ in blocks]
    for s, n in enumerate(blocks):
        w, at, done, active = weights[s], 0, 0, sum(weights)
        edges = []
        for i in range(n + 1):
            # sources that are exhausted at v = i / w
            while at < len(order) and blocks[order[at]] * w <= i * weights[order[at]]:
                done, active, at = done + blocks[order[at]], active - weights[order[at]], at + 1
            edges.append((done + i * active // w, done - (-i * active // w)))
        out[s] = [(edges[i][0], edges[i + 1][1]) for i in range(n)]
    return out


def schedule(blocks: list[int], weights: list[int]) -> list[tuple[int, int, int]]:
    """(source, block, slot) by earliest deadline first, of released blocks; ties to the first source."""
    due = windows(blocks, weights)
    waiting = sorted((r, d, s, i) for s, x in enumerate(due) for i, (r, d) in enumerate(x))
    heap: list[tuple[int, int, int]] = []
    out, at = [], 0
    for slot in range(len(waiting)):
        while at < len(waiting) and waiting[at][0] <= slot:
            heapq.heappush(heap, waiting[at][1:])
            at += 1
        _, s, i = heapq.heappop(heap)
        out.append((s, i, slot))
    return out


def whole_weights(share: list[float], unit: int = UNIT) -> list[int]:
    """Whole numbers in proportion to the shares, with a sum of at most unit (or one a source, if those are more)."""
    exact = [Fraction(x).limit_denominator(unit) for x in share]
    scale = math.lcm(*[f.denominator for f in exact]) if exact else 1
    out = [int(f * scale) for f in exact]
    common = math.gcd(*out) if out else 1
    out = [x // max(common, 1) for x in out]
    if all(out) and sum(out) <= unit and all(math.isclose(float(f), x, rel_tol=1e-12) for f, x in zip(exact, share, strict=True)):
        return out
    total = sum(share)
    parts = [x / total * unit for x in share]
    out = [max(1, int(p)) for p in parts]
    for s in sorted(range(len(out)), key=lambda s: int(parts[s]) - parts[s])[: max(0, unit - sum(out))]:
        out[s] += 1
    return out


def units(blocks: list[int], weights: list[int]) -> list[tuple[int, int, list[int]]]:
    """(first unit, its first slot, blocks of each source in the unit) of every run of equal units."""
    ends = sorted({0} | {n // w for n, w in zip(blocks, weights, strict=True)} | {-(-n // w) for n, w in zip(blocks, weights, strict=True)})
    out, slot = [], 0
    for i, m in enumerate(ends):
        own = [min(max(n - m * w, 0), w) for n, w in zip(blocks, weights, strict=True)]
        if not sum(own):
            break
        out.append((m, slot, own))
        if i + 1 < len(ends):
            slot += sum(own) * (ends[i + 1] - m)
    return out


def slots(spark, runs: list[tuple[int, int, list[int]]], weights: list[int]) -> DataFrame:
    """(run, source, nth, slot): the schedule of one unit of each run, made by a task each."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch["run"].to_list():
                yield pd.DataFrame(schedule(runs[r][2], weights), columns=["source", "nth", "slot"]).assign(run=r)[["run", "source", "nth", "slot"]]

    numbers = spark.range(len(runs), numPartitions=max(1, min(len(runs), 64))).select(F.col("id").alias("run"))
    return numbers.mapInPandas(plan, "run long, source int, nth long, slot long")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, *, temperature: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None, block_bytes: int = BLOCK_BYTES, unit: int | None = None) -> DataFrame:
    """docs with mix_block, mix_slot and mix_position (gapless from 0).

    weights: by source; a source that it leaves out gets the least of them. By default a source
    weighs its bytes to the power 1 / temperature. size: a column with the bytes, else text's.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    order = docs.columns
    docs, aside = set_aside(docs, [doc_id, text, source, *([size] if size else [])])
    cols = docs.columns
    key = F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source)))
    bytes_ = F.col(size) if size else F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    tie = F.xxhash64(text) if text in cols else F.lit(0).cast("long")
    rows = docs.withColumns({"__source": key, "__bytes": bytes_, "__tie": tie})
    totals = sorted(tuple(r) for r in rows.groupBy("__source").agg(F.count(F.lit(1)), F.sum("__bytes")).collect())
    blocks = [-(-t[2] // block_bytes) for t in totals]
    if weights is None:
        share = [float(t[2]) ** (1 / temperature) for t in totals]
    else:
        given = {("-" if k is None else f"={k}"): float(v) for k, v in weights.items()}
        share = [given.get(t[0], min(given.values(), default=1.0)) for t in totals]
    whole = whole_weights(share, unit or max(UNIT, min(UNIT_MOST, PARTS * sum(blocks))))
    runs = units(blocks, whole)
    plan = scratch(slots(spark, runs, whole), "mix-plan")
    counts = [(t[0], t[1]) for t in totals] or [("", 0)]
    by = ["__key", "__tie"]
    keyed = rows.withColumn("__key", F.col(doc_id))
    light = rank_within(keyed.select("__source", "__bytes", *by), "__source", by, counts, weight="__bytes", rank="__rank", before="__before")
    # a row a block at most; its unit, the run of that, and its number within the unit
    block = F.floor(F.col("__before") / block_bytes).cast("long")
    starts = light.select("__source", block.alias("mix_block"), "__rank").groupBy("__source", "mix_block").agg(F.min("__rank").alias("__first"), F.count(F.lit(1)).alias("__n"))
    numbered = small_frame(spark, [(t[0], i, w) for i, (t, w) in enumerate(zip(totals, whole, strict=True))] or [("", 0, 1)], "__source string, source int, __weight long")
    from_unit = F.array(*[F.lit(r[0]).cast("long") for r in runs] or [F.lit(0).cast("long")])
    at = starts.join(F.broadcast(numbered), "__source").withColumn("__unit", F.floor(F.col("mix_block") / F.col("__weight")))
    at = at.withColumns({"run": (F.size(F.filter(from_unit, lambda m: m <= F.col("__unit"))) - 1).cast("long"), "nth": F.col("mix_block") - F.col("__unit") * F.col("__weight")})
    of_run = small_frame(spark, [(i, m, first, sum(own)) for i, (m, first, own) in enumerate(runs)] or [(0, 0, 0, 0)], "run long, __m long, __slot0 long, __length long")
    few = sum(sum(own) for _, _, own in runs) <= PLAN_ROWS
    in_unit = at.join(F.broadcast(plan) if few else plan, ["run", "source", "nth"]).join(F.broadcast(of_run), "run")
    slot = F.col("__slot0") + (F.col("__unit") - F.col("__m")) * F.col("__length") + F.col("slot")
    placed = scratch(in_unit.select("__source", "mix_block", slot.cast("long").alias("mix_slot"), "__first", "__n"), "mix-blocks")
    before = running(placed.select("mix_slot", "__n"), [], "mix_slot", {"__n": "__start"}, SLOTS)
    shifted = placed.join(before, "mix_slot").select("__source", "mix_block", "mix_slot", (F.col("__start") - F.col("__first")).alias("__shift"))
    ranked = rank_within(keyed, "__source", by, counts, weight="__bytes", rank="__rank", before="__before").withColumn("mix_block", block)
    out = ranked.join(F.broadcast(shifted) if sum(blocks) <= PLAN_ROWS else shifted, ["__source", "mix_block"])
    named = {aside.get(c, c): F.col(c) for c in cols}
    return out.select(*[named[c].alias(c) for c in order], "mix_block", "mix_slot", (F.col("__rank") + F.col("__shift")).alias("mix_position"))
