"""Document fingerprints by consistent weighted sampling.

A text's terms are its lower-cased words, weighted by how often they occur. For sample k every
term draws r and c from Gamma(2, 1) and b from U(0, 1), by hash, alike in every text. With
t = floor(ln(weight) / r + b) and y = exp(r (t - b)), the term with the least
ln a = ln c - ln y - r wins, and (term, t) is the sample. Two texts have equal samples with
probability equal to the generalised Jaccard similarity of their term weights (sum of least over
sum of greatest weights). The draws come from quantile tables of Gamma(2, 1): 4,096 quantiles, of which the first
and the last are replaced by 4,096 finer ones each, so that the tails reach to 2^-25 (in a text of hundreds of thousands
of words the rarest draws decide).

Only DataFrame functions are used. A text's hashed words are sorted in place; the ends of runs of
equal hashes give the weights without a shuffle, and the least ln a (as fixed-point number, with the
sample's hash in the low bits) of all samples is one aggregation within the task that read the text.

Defined results: a null text counts as empty; a text without words has the fingerprint '' (its
likeness to another such text is 1, to any other 0); documents are ordered by id, then text hash
(a null id first), so equal ids don't crash (a document's rows of one id and text are each other's next); a single document is its own next; repeated rows
are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES, TABLE_BITS, BLOCK = 64, 12, 16
#: Ranges of ids, and bytes of text a part of them.
RANGES, PART_BYTES = 4096, 4 << 20
_FRACTION = 1 << 22


def gamma_quantiles(n: int, low: float = 0.0, high: float = 1.0) -> list[float]:
    """The quantiles of Gamma(2, 1) at n midpoints from low to high, by Newton's method on log x.

    1 - (1 + x) exp(-x) is taken by its series where x is small, and the upper tail by its logarithm.
    """
    out, y = [], math.log(0.01)
    for i in range(n):
        p, q = low + (i + 0.5) / n * (high - low), (1 - high) + (n - i - 0.5) / n * (high - low)
        y = max(y, 0.5 * math.log(2 * p))
        for _ in range(100):
            x = math.exp(y)
            if p < 0.5:
                below = sum((-1) ** k * (k - 1) * x**k / math.factorial(k) for k in range(2, 14)) if x < 0.3 else 1 - (1 + x) * math.exp(-x)
                step = (math.log(below) - math.log(p)) * below / (x * x * math.exp(-x))
            else:
                step = (math.log(q) - math.log1p(x) + x) * (1 + x) / (x * x)
            y -= max(-1.0, min(1.0, step))
            if abs(step) < 1e-13:
                break
        out.append(math.exp(y))
    return out


def gamma_tables(n: int) -> list[float]:
    """n quantiles of Gamma(2, 1), n finer ones for the first of them, and n for the last."""
    return gamma_quantiles(n) + gamma_quantiles(n, 0.0, 1 / n) + gamma_quantiles(n, 1 - 1 / n, 1.0)


def _numbers(values: list[float], row: Column) -> Column:
    """A constant array that the plan holds once: for that it has to look as if it depended on the row."""
    return F.when(row >= -1, F.from_json(F.lit(json.dumps(values)), "array<double>"))


def fingerprint(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys and the array of sample hashes (null without words) of each text; keys must be unique.

    The result has no shuffle of its own if texts is partitioned by one of the keys.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = texts.select(*keys, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("__h"))
    n = F.size("__h")
    last = F.filter(F.sequence(F.lit(1), n), lambda i: (i == F.size("__h")) | (F.get("__h", i) != F.get("__h", i - 1)))
    quantiles = gamma_tables(1 << TABLE_BITS)
    tables = {"__r": _numbers(quantiles, n), "__c": _numbers([math.log(q) for q in quantiles], n)}
    runs = hashed.withColumn("__ends", F.when(n > 0, last)).withColumns(tables)
    each = runs.select(*keys, "__h", "__ends", *tables, F.posexplode_outer("__ends").alias("__i", "__end"))
    terms = each.select(
        *keys,
        *tables,
        F.get("__h", F.col("__end") - 1).alias("__term"),
        F.ln((F.col("__end") - F.when(F.col("__i") > 0, F.get("__ends", F.col("__i") - 1)).otherwise(0)).cast("double")).alias("__lw"),
    )
    # BLOCK samples at a time: the compiled code for one aggregation stays small
    blocks = -(-samples // BLOCK)
    terms = terms.select("*", F.explode(F.array(*[F.lit(i * BLOCK) for i in range(blocks)])).alias("__block"))
    mask, low = (1 << TABLE_BITS) - 1, 0xFFFFFFFF
    bits = lambda draw, k: F.shiftrightunsigned(draw, k * TABLE_BITS).bitwiseAND(F.lit(mask)).cast("int")

    def entry(draw: Column, k: int) -> Column:
        """The table entry by the draw's k-th bits, in the tails by its (k + 1)-th."""
        first = bits(draw, k)
        return F.when(first == 0, bits(draw, k + 1) + (mask + 1)).when(first == mask, bits(draw, k + 1) + 2 * (mask + 1)).otherwise(first)

    least = []
    for k in range(BLOCK):
        draw = F.xxhash64("__term", F.col("__block") + k)
        r, c = F.get("__r", entry(draw, 0)), F.get("__c", entry(draw, 2))
        b = F.shiftrightunsigned(draw, 4 * TABLE_BITS) * F.lit(1.0 / (1 << (64 - 4 * TABLE_BITS)))
        t = F.floor(F.col("__lw") / r + b)
        a = c - r * (t - b) - r
        # 2^30 steps from -128 to 128; below them 32 bits of the sample's hash
        ranked = F.shiftleft(((a + 128.0) * float(_FRACTION)).cast("long"), 32) + F.col("__term").bitwiseXOR(F.shiftleft(t, 12)).bitwiseAND(F.lit(low))
        least.append(F.min(ranked).alias(f"__m{k}"))
    found = terms.groupBy(*keys, "__block").agg(*least)
    one = F.when(F.col("__m0").isNotNull(), F.array(*[F.col(f"__m{k}").bitwiseAND(F.lit(low)) for k in range(BLOCK)]))
    rows = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__block", one.alias("s")))).alias("__all"))
    signature = F.slice(F.flatten(F.transform("__all", lambda x: x["s"])), 1, samples)
    return rows.select(*keys, F.when(signature.isNotNull(), signature).alias("signature"))


def encode(signature: Column) -> Column:
    """A signature as text: eight hexadecimal digits a sample."""
    return F.coalesce(F.array_join(F.transform(signature, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(float(samples)))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """part, at, doc_id, text, next_text, closing: every document and the one after it by id.

    Ids are cut into RANGES equal ranges, and each range into as many parts as its bytes need; so parts stay about
    equal, whatever the table's size, and the driver holds one number a range. Each part is ordered by a
    task of its own, and gets the first row of the next part as a closing row, which has no next.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ends = whole.agg(F.min("doc_id"), F.max("doc_id")).head()
    lowest, width = ends[0] or 0, max(((ends[1] or 0) - (ends[0] or 0) + 1) / RANGES, 1.0)
    # where a row stands among the ranges: by id, then by the hash of its text
    stands = (F.col("doc_id") - lowest + (F.col("tie") / float(1 << 63) + 1) / 2) / width
    in_range = F.least(F.coalesce(F.floor(stands), F.lit(0)), F.lit(RANGES - 1)).cast("int")
    sizes = {r["r"]: r["b"] for r in whole.groupBy(in_range.alias("r")).agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    cuts = [max(1, -(-sizes.get(r, 0) // part_bytes)) for r in range(RANGES)]
    # neighbouring ranges that are small share a part
    share, part, room = [], -1, None
    for r in range(RANGES):
        size = sizes.get(r, 0)
        if cuts[r] > 1:
            share.append(part + 1)
            part, room = part + cuts[r], None
        elif room is not None and room + size <= part_bytes:
            share.append(part)
            room += size
        else:
            part, room = part + 1, size
            share.append(part)
    table = lambda x: F.when(F.length("text") >= 0, F.from_json(F.lit(json.dumps(x)), "array<bigint>"))
    inner = F.least(F.floor((F.coalesce(stands, F.lit(0.0)) - F.col("__range")) * F.get("__cuts", F.col("__range"))), F.get("__cuts", F.col("__range")) - 1)
    dealt = whole.withColumns({"__range": in_range, "__cuts": table(cuts), "__share": table(share)})
    dealt = dealt.withColumn("part", F.get("__share", F.col("__range")) + F.greatest(inner, F.lit(0))).select("doc_id", "text", "tie", "part")
    # the first row of each part: least id, then least hash
    key = F.struct("doc_id", "tie")
    firsts = dealt.groupBy("part").agg(F.min_by("text", key).alias("text"), F.min(key).alias("k")).select("part", "text", "k.doc_id", "k.tie")
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    closing = firsts.select("doc_id", "text", before.alias("part"), "tie", F.lit(True).alias("closing"))
    rows = dealt.withColumn("closing", F.lit(False)).unionByName(closing)
    order = Window.partitionBy("part").orderBy("closing", "doc_id", "tie")
    return rows.select("part", F.row_number().over(order).alias("at"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "closing")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many of the next text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))
