import math

import numpy as np

from chronosift.llm.ann import search
from pyspark.sql import functions as F

from .data import documents, nothing

KIND = "vec_id long, embedding array<float>, label int"


def _exact(x, ids, q, k):
    s = x @ x[q]
    s[ids == ids[q]] = -np.inf
    order = np.lexsort((ids, -s))[:k]
    return [(int(ids[i]), float(s[i])) for i in order if s[i] > -np.inf]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((3000, 24)) * rng.uniform(0.2, 3, (3000, 1))).astype(np.float32)
    x[::3] = x[0]  # a third of all vectors are one
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5001, [0.0] * 24, 0), (5020, [math.nan] * 24, 0), (5040, [1.0, None] * 12, 0), (5060, [1.0] * 3, 0), (None, [1.0] * 24, 0)]
    got = search(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0).collect()
    ids, exact = np.arange(3000), x.astype(float)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 20))
    hit = 0
    for q, rows_ in found.items():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 21))
        assert [(-s, v) for _, v, s in rows_] == sorted((-s, v) for _, v, s in rows_)
        assert all(abs(s - exact[v] @ exact[q]) < 1e-9 and v != q for _, v, s in rows_)
        floor = _exact(exact, ids, q, 20)[-1][1]
        hit += sum(s >= floor - 1e-9 for _, _, s in rows_)
    assert hit / (20 * len(found)) >= 0.9


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (20, [0.5, 1.0], 0), (3, [1.0, 1.0], 0)], KIND)
    got = sorted(tuple(r) for r in search(few, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.5), (20, 1, 3, 1.5), (20, 2, 0, 0.5)]
    assert search(spark.createDataFrame([], KIND), F.col("vec_id") % 20 == 0).count() == 0


def test_awkward_vectors(spark):
    """Overflowing lengths, repeated query ids, equal query rows, clashing names, more queries than a batch."""
    big = [[1e200, 0.0], [0.0, -1e200], [3e-200, 1.0]]
    rows = [(i, big[i % 3] if i < 3 else [float(i % 7) + 1, float(i % 5)], 0, "x", "y") for i in range(1, 400)]
    rows += [(400, [1.0, 0.0], 0, "x", "y"), (400, [0.0, 1.0], 0, "x", "y"), (400, [0.0, 1.0], 0, "x", "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, list string, block string")
    got = search(df, F.col("vec_id") % 20 == 0, list_rows=30).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(20, 401, 20)) and all(len(v) == 20 for k, v in by.items() if k < 400) and len(by[400]) == 40
    for k in (20, 380):
        x = np.array([r[1] for r in rows])
        want = _exact(x, np.array([r[0] for r in rows]), k - 1, 20)
        assert [(r["vec_id"], r["score"]) for r in sorted(by[k], key=lambda r: r["rank"])] == want


def test_search_query(spark, tmp_path):
    from chronosift.llm.queries import op9_dimension_scan

    spark.createDataFrame([(i, [float(i % 3), 1.0], 0) for i in range(50)], KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op9_dimension_scan(spark, str(tmp_path)).count() == 60


def test_language_stage_decides(spark):
    """It drops what no language parses, fills null languages, and keeps clean documents."""
    import corpus_pipeline as C

    rows = [(i, f"The story number {i} is about a small fox and its friends in the woods.", "en", "a", 1, "k") for i in range(40)]
    rows += [(100, "The fox and the woods.", None, "a", 1, "k"), (101, "".join(chr(0x0E01 + i % 40) for i in range(300)), None, "a", 1, "k"), (102, None, "en", "a", 1, "k"), (103, "12 34", "en", "a", 1, "k"), (104, "A", None, None, 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __lang string")
    got = {r["doc_id"]: r for r in C.language_id(spark, docs, "").collect()}
    assert set(got) == {*range(40), 100, 104} and got[100]["lang"] == "en" and got[100]["__lang"] == "k"
    bare = C.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect()
    assert {r["doc_id"] for r in bare} == {*range(40), 100, 101, 104}  # nothing to learn from: only letterless texts go


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    documents(spark).drop("size", "rank", "part").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(C.STAGES):
        out = f"{tmp_path}/{k}"
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs.collect()
        assert docs.columns == before or name == "packing"
    ids = lambda name: [r["doc_id"] for r in seen[name]]
    assert set(ids("language_id")) == {r["doc_id"] for r in documents(spark).collect()} - {4, 5, 6, 7}
    assert {2, 3, 9} & set(ids("near_dedup")) == set()
    assert len(ids("near_dedup")) == len(set(ids("near_dedup")))
    assert sorted(map(str, ids("mixing"))) == sorted(map(str, ids("near_dedup"))) == sorted({str(i) for i in ids("packing")})
    nothing(spark).drop("size", "rank", "part").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0


def test_sequences_follow_the_mixture(spark, tmp_path, monkeypatch):
    import corpus_pipeline as C

    rows = [(i, f"{i} " + "some words here " * (20 + i // 2 * 7919 % 90), "en", "ab"[i % 2], 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tables = {}
    for k, weights in enumerate([{"a": 3, "b": 1}, {"a": 1, "b": 3}]):
        monkeypatch.setattr(C, "WEIGHTS", weights)
        C.mixing(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        mixed = spark.read.parquet(f"{tmp_path}/{k}")
        tables[k] = got = C.packing(spark, mixed, "").collect()
        sequences = sorted({r["sequence_id"] for r in got})
        assert sequences == list(range(len(sequences)))
        # the first 40 % of sequences: both sources are there, three to one
        early = [r for r in got if r["sequence_id"] < 0.4 * len(sequences)]
        share = sum(r["length"] for r in early if "ab"[r["doc_id"] % 2] == "a") / sum(r["length"] for r in early)
        assert abs(share - weights["a"] / 4) < 0.08
        spans = {}
        for r in got:
            spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert all(sum(n for _, n in s) <= 1024 and [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] for s in spans.values())
    assert {tuple(r) for r in tables[0]} != {tuple(r) for r in tables[1]}
    assert len(tables[0]) == len(tables[1]) and {r["sequence_id"] for r in tables[0]} == {r["sequence_id"] for r in tables[1]}


INTERNAL = ["n_lines", "removed_runs", "removed_lines", "__at", "__row", "__id", "__said", "__lines", "__runs", "__h", "__n", "__new", "__l_id", "__n_id", "__pairs", "__source", "__key", "__bytes", "__tie", "__rank", "__before", "__chunk", "__first", "__shift", "mix_block", "mix_slot", "mix_position", "run", "nth", "slot", "__file", "__index", "__begin", "__mixed", "aside 0", "kept", "component_id"]


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as cp

    docs = documents(spark).drop("size", "rank", "part").withColumns({c: F.concat(F.lit(c), F.lit("="), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in INTERNAL})
    docs = cp.scratch(docs)
    for name, stage in cp.STAGES[:-1]:
        out = cp.scratch(stage(spark, docs, None))
        assert out.columns == docs.columns, name
        for r in out.collect():
            said = "?" if r["doc_id"] is None else str(r["doc_id"])
            assert all(r[c] == f"{c}={said}" for c in INTERNAL), name
    assert cp.packing(spark, out, None).select("doc_id").distinct().count() == out.select("doc_id").distinct().count()


def test_every_part_of_the_entry_is_there():
    import __spark_entry__

    assert __spark_entry__.ABSENT == {} and "pipeline" in __spark_entry__.queries()


def test_wide_vectors_stay_within_memory():
    """A full block of wide vectors before any limit is known: what pairs gather is bounded, the scores are the same."""
    import tracemalloc

    from chronosift.llm import ann

    rng = np.random.default_rng(1)
    q, v, inf = rng.standard_normal((256, 384)), rng.standard_normal((1024, 384)), np.full(256, np.inf)
    tracemalloc.start()
    pairs = ann.scan(q, inf, v)
    got = ann.best(q, np.arange(256) - 1000, pairs, v, np.arange(1024), 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and len(pairs[0]) == 256 * 1024
    exact = q @ v.T
    for i in range(0, 256, 50):
        assert list(got[1][got[0] == i]) == list(np.argsort(-exact[i], kind="stable")[:20])


def _without_runs(rows):
    """Line dedup in plain Python: (id, text) in order of id."""
    first, out = {}, []
    for i, text in sorted(rows):
        lines = text.split("\n")
        again = []
        for at in range(len(lines) - 1):
            pair = (lines[at], lines[at + 1])
            seen = first.setdefault(pair, (i, at))
            again.append(seen[0] != i or at > seen[1] + 1)
        gone, at = set(), 0
        while at < len(again):
            end = at
            while end < len(again) and again[end]:
                end += 1
            if end > at and any(c.isalnum() for line in lines[at : end + 1] for c in line):
                gone |= set(range(at, end + 1))
            at = max(end, at + 1)
        kept = "\n".join(line for k, line in enumerate(lines) if k not in gone)
        if not gone or kept.strip(" "):
            out.append((i, kept))
    return out


def test_run_equals_plain_python(spark, tmp_path):
    """All five stages over a small table: which documents are left, with which text, and that their tokens are packed once."""
    import zlib

    import corpus_pipeline as C
    from tokenizers import Tokenizer

    from .test_texts import _components

    rows = [r for r in documents(spark).drop("size", "rank", "part").dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL").collect()]
    rows += [(900, "Это предложение написано буквами, которых нет ни в одном из изученных языков.", None, "d", 0), (901, "A shared line number 1 of the passage.\nA shared line number 2 of the passage.", "en", "d", 0)]
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in C.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r)

    spoken = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1]) and r[0] != 900]
    lean = _without_runs(spoken)
    kept = _components(lean, 5)
    left = [(i, t) for i, t in lean if kept[i] == i]
    assert 901 not in dict(lean) and 2 not in dict(left) and set(got) == {i for i, _ in left}
    coder = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    places = {}
    for i, text in left:
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 2], np.uint32)
        pieces = sorted(got[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == list(np.cumsum([0, *[n for _, n in held[:-1]]])) and sum(n for _, n in held) <= 1024
