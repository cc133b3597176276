"""Line deduplication by content-defined chunks of lines.

Every line has a hash; a rolling hash over the last WINDOW line hashes closes a chunk wherever it is
0 modulo DIVISOR, so boundaries follow the content and shift with it. Chunks of at least two lines (and
a letter or digit somewhere) that occur more than once anywhere are removed but for their first
occurrence (least document id, then first in the document). Equal hashes only nominate chunks; a chunk
goes only if its bytes equal those of the one that stays.

Only DataFrame functions are used. Chunks are grouped by hash and size first, which moves a few bytes
each; texts are moved for nominated chunks alone, and once more where a document loses some.

Defined results: a null text stays null; lines end at \\n, and a last empty line counts as a line;
rows of one id that hold equal text are one document and lose the same; a null id sorts first;
repeated chunks within one document go as well; other columns are kept as they are (but for former ones of the counts' names); an
empty table gives no rows.

remove_repeated() takes whole chunks alone, so what a chunk's ends cut off from a repeated passage stays.
remove_runs() rolls the hash over every two lines and puts a chunk's boundaries where the rolled hashes begin and cease to
have occurred before: boundaries that the content alone decides and that shift with it. A run of two or more lines occurred
before exactly if each of its pairs did, so whole runs go, whatever surrounds them.

A pair of lines that very many documents share is counted by partial aggregates; where its occurrences are joined,
Spark's adaptive execution splits the skewed partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import set_aside

WINDOW, DIVISOR, MIN_LINES = 2, 2, 2


def line_hash(line: Column) -> Column:
    """The first 28 bits of a line's MD5 (which SQL engines share)."""
    return F.conv(F.substring(F.md5(F.encode(line, "utf-8")), 1, 7), 16, 10).cast("long")


def chunks(docs: DataFrame, text: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """docs with __lines and __ends: the lines and the (1-based) last line of every chunk."""
    lines = F.split(F.col(text), "\n", -1)
    hashed = docs.withColumn("__lines", lines).withColumn("__hashes", F.transform("__lines", line_hash))
    closes = lambda i: (i == F.size("__hashes")) | ((F.get("__hashes", i - 1) + F.coalesce(F.get("__hashes", i - 2), F.lit(0)) * 31) % divisor == 0)
    return hashed.withColumn("__ends", F.filter(F.sequence(F.lit(1), F.size("__hashes")), closes)).drop("__hashes")


def remove_repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with text without repeated chunks, and n_lines, n_chunks, removed_chunks, removed_lines."""
    cols = [c for c in docs.columns if c not in ("n_lines", "n_chunks", "removed_chunks", "removed_lines")]
    docs = docs.select(*cols)
    keyed = docs.withColumns({"__id": F.col(doc_id), "__row": F.xxhash64(text)})
    cut = chunks(keyed.select("__id", "__row", F.col(text).alias("__text")), "__text", divisor)
    spans = F.transform(
        "__ends",
        lambda e, i: F.struct((i + 1).alias("chunk"), (F.when(i > 0, F.get("__ends", i - 1)).otherwise(0)).alias("start"), e.alias("stop")),
    )
    long_ = F.filter(spans, lambda s: s["stop"] - s["start"] >= min_lines)
    each = cut.select("__id", "__row", "__lines", F.explode(long_).alias("__s")).select(
        "__id", "__row", F.col("__s.chunk").alias("__chunk"), F.array_join(F.slice("__lines", F.col("__s.start") + 1, F.col("__s.stop") - F.col("__s.start")), "\n").alias("__said")
    )
    each = each.filter(F.col("__said").rlike(r"[\p{L}\p{N}]")).withColumns({"__h": F.xxhash64("__said"), "__size": F.octet_length("__said")})
    # nominated by hash and size
    often = each.groupBy("__h", "__size").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__h", "__size")
    nominated = each.join(often, ["__h", "__size"], "left_semi")
    # compared by bytes: the text itself is the key; the first occurrence stays
    place = F.struct("__id", "__row", "__chunk")
    same = nominated.groupBy("__h", "__said").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__h", F.col("__said").alias("__same"), "__first")
    gone = nominated.join(same, (nominated["__h"] == same["__h"]) & (F.col("__said") == F.col("__same")) & ~place.eqNullSafe(F.col("__first")))
    lost = gone.groupBy("__id", "__row").agg(F.collect_set("__chunk").alias("__gone"))
    joined = keyed.join(lost.withColumnsRenamed({"__id": "__lid", "__row": "__lrow"}), F.col("__id").eqNullSafe(F.col("__lid")) & (F.col("__row") == F.col("__lrow")), "left")
    cut_again = chunks(joined.withColumn("__whole", F.col(text)), "__whole", divisor)
    stays = F.filter(spans, lambda s: ~F.array_contains(F.coalesce(F.col("__gone"), F.array().cast("array<int>")), s["chunk"]))
    kept_lines = F.flatten(F.transform(stays, lambda s: F.slice("__lines", s["start"] + 1, s["stop"] - s["start"])))
    n_kept = F.aggregate(stays, F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    n_lines = F.coalesce(F.size("__lines"), F.lit(0))
    out = cut_again.withColumns({
        "n_lines": n_lines,
        "n_chunks": F.coalesce(F.size("__ends"), F.lit(0)),
        "removed_chunks": F.coalesce(F.size("__gone"), F.lit(0)),
        "removed_lines": F.when(F.col("__gone").isNull(), 0).otherwise(n_lines - n_kept),
        "__new": F.when(F.col("__gone").isNull(), F.col("__whole")).otherwise(F.array_join(kept_lines, "\n")),
    })
    return out.select(*[F.col("__new").alias(c) if c == text else F.col(c) for c in cols], "n_lines", "n_chunks", "removed_chunks", "removed_lines")


def remove_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text without repeated runs of lines, and n_lines, removed_runs, removed_lines.

    A line goes if it and a neighbour occurred next to each other before (in an earlier document, or further up
    without overlap) and a letter or digit is in the run of such lines. The first occurrence of every line stays.
    """
    docs = docs.drop("n_lines", "removed_runs", "removed_lines")
    order = docs.columns
    docs, aside = set_aside(docs, [doc_id, text])
    cols = docs.columns
    # both joins of the texts see the same columns, so that they can share one shuffle
    keyed = docs.select(*cols).withColumn("__row", F.xxhash64(text))
    lines = F.split(F.col(text), "\n", -1)
    hashes = F.transform(F.sequence(F.lit(1), F.size("__lines") - 1), lambda i: F.xxhash64(F.get("__lines", i - 1), F.get("__lines", i)))
    several = keyed.select(F.col(doc_id).alias("__id"), "__row", lines.alias("__lines")).filter(F.size("__lines") > 1)
    pairs = several.select("__id", "__row", F.posexplode(hashes).alias("__at", "__h"))
    # nominated by hash: a few bytes a line
    often = pairs.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__h")
    nominated = pairs.join(often, "__h", "left_semi").groupBy("__id", "__row").agg(F.sort_array(F.collect_set("__at")).alias("__pairs"))
    same_doc = lambda a: F.col(doc_id).eqNullSafe(F.col(f"{a}_id")) & (F.col("__row") == F.col(f"{a}_row"))
    at_docs = keyed.join(nominated.select(F.col("__id").alias("__n_id"), F.col("__row").alias("__n_row"), "__pairs"), same_doc("__n"))
    each = at_docs.select(F.col(doc_id).alias("__id"), "__row", lines.alias("__lines"), "__pairs").select("__id", "__row", "__lines", F.explode("__pairs").alias("__at"))
    each = each.select("__id", "__row", "__at", F.concat_ws("\n", F.get("__lines", F.col("__at")), F.get("__lines", F.col("__at") + 1)).alias("__said"))
    # compared by bytes: the text itself is the key; the first occurrence stays
    place = F.struct("__id", "__row", "__at")
    same = each.groupBy("__said").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col("__said").alias("__same"), "__first")
    apart = ~(F.col("__id").eqNullSafe(F.col("__first.__id")) & (F.col("__row") == F.col("__first.__row"))) | (F.col("__at") > F.col("__first.__at") + 1)
    again = each.join(same, F.col("__said") == F.col("__same")).filter(apart).groupBy("__id", "__row", "__at").agg(F.max(F.col("__said").rlike(r"[\p{L}\p{N}]")).alias("__says"))
    # pairs in a row are one run
    run = (F.col("__at") - F.row_number().over(Window.partitionBy("__id", "__row").orderBy("__at"))).alias("__run")
    runs = again.select("__id", "__row", "__at", "__says", run).groupBy("__id", "__row", "__run").agg(F.min("__at").alias("start"), (F.max("__at") + 2).alias("stop"), F.max("__says").alias("__says")).filter("__says")
    lost = runs.groupBy(F.col("__id").alias("__l_id"), F.col("__row").alias("__l_row")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__runs"))
    joined = keyed.join(lost, same_doc("__l"), "left").withColumn("__lines", lines)
    # what lies before each run, and behind the last
    before = F.transform("__runs", lambda r, i: F.struct(F.when(i > 0, F.get("__runs", i - 1)["stop"]).otherwise(0).alias("start"), r["start"].alias("stop")))
    stays = F.concat(before, F.array(F.struct(F.element_at("__runs", -1)["stop"].alias("start"), F.size("__lines").alias("stop"))))
    kept_lines = F.flatten(F.transform(stays, lambda s: F.slice("__lines", s["start"] + 1, s["stop"] - s["start"])))
    out = joined.withColumns({
        "n_lines": F.coalesce(F.size("__lines"), F.lit(0)),
        "removed_runs": F.coalesce(F.size("__runs"), F.lit(0)),
        "removed_lines": F.coalesce(F.aggregate("__runs", F.lit(0), lambda n, r: n + r["stop"] - r["start"]), F.lit(0)),
        "__new": F.when(F.col("__runs").isNull(), F.col(text)).otherwise(F.array_join(kept_lines, "\n")),
    })
    named = {aside.get(c, c): F.col("__new") if c == text else F.col(c) for c in cols}
    return out.select(*[named[c].alias(c) for c in order], "n_lines", "removed_runs", "removed_lines")
