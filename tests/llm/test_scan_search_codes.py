"""Lexical search, licence scan and vector codes against brute force; awkward tables."""

import hashlib
import math
import random
import re
import urllib.parse
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from chronosift.llm import lexical, licenses, queries, vector_codes
from chronosift.llm.common import Tables, cut_words
from pyspark.sql import functions as F

from .data import documents, nothing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_words_are_cut_as_the_pattern_says():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aZ9 \t\n.-_é😀İß\x00\x7f") for _ in range(rng.randrange(0, 40))) for _ in range(500)] + [None, ""]
    said, n = cut_words(pa.array(texts, pa.string()).slice(3))
    assert [len(_words(t)) for t in texts[3:]] == list(n)
    assert [w.decode() for w in said.to_pylist()] == [w for t in texts[3:] for w in _words(t)]


def _ranked(docs, items, k=10):
    held = [(i, Counter(_words(t))) for i, t in docs if _words(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in items:
        scored = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in Counter(_words(text)).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])}
    return out


def _found(spark, docs, items, **more):
    tables = Tables(spark)
    rows = lexical.search(lexical.build_index(docs, tables), items, tables, **more)
    got = {tuple(r) for r in rows.select("item_id", "rank", "doc_id", "score").collect()}
    tables.drop()
    return got


def test_search_equals_brute_force_with_ties_and_copies(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "x"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 30)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(100)] + [(2000, None), (2001, ""), (2002, " .,; "), (2003, "x " * 20_000), (None, docs[7][1])]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(20)] + [(20, None), (21, "unknown words"), (22, docs[7][1]), (22, docs[7][1])]
    monkeypatch.setattr(lexical, "SHARD_BYTES", 2000)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 2000)  # several blocks of items
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, ids int, rank int, score int").repartition(5)
    asked = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, query int")
    assert _found(spark, frame, asked) == _ranked(docs, list(dict.fromkeys(items)))
    assert _found(spark, frame, asked, k=1000) == _ranked(docs, list(dict.fromkeys(items)), 1000)


def test_index_is_read_a_few_shards_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BYTES", 2000)
    tables = Tables(spark)
    frame = spark.createDataFrame([(i, f"common w{i} " * 40) for i in range(200)], "doc_id long, text string").coalesce(1)
    index = lexical.build_index(frame, tables)
    held = [pq.ParquetFile(urllib.parse.unquote(urllib.parse.urlparse(f).path)).metadata for f in index.shards.inputFiles()]
    shards = index.shards.count()
    groups = [m.row_group(i).num_rows for m in held for i in range(m.num_row_groups)]
    tables.drop()
    assert sum(groups) == shards > 12 and max(groups) <= 4


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "quick fox")], "item_id long, text string")
    assert _found(spark, nothing(spark), some) == set() == _found(spark, documents(spark), none)
    assert _found(spark, documents(spark), some) == _ranked([(r["doc_id"], r["text"]) for r in documents(spark).collect()], [(1, "quick fox")])


def test_best_keeps_the_least_ids_of_a_tie():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores, ids = rng.integers(0, 4, 30), rng.permutation(30)
        want = sorted((int(-s), int(i)) for s, i in zip(scores, ids, strict=True) if s > 0)[:7]
        assert sorted((int(-scores[r]), int(ids[r])) for r in lexical.best(scores, ids, 7)) == want


def _license(text):
    """Every offset tried, word by word."""
    words = _words(text)
    weight = licenses.weights([x.split() for x in licenses.BASE.values()] + [x[0].split() for x in licenses.NOTICES.values()])
    places = [(i, label) for label, p in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, score = {x for _, x in places}, 1.0 if places else 0.0
    for label, (notice, keys) in licenses.NOTICES.items():
        said = notice.split()
        rare = [w for w in licenses.rare_tokens(said, weight) if w in words][: licenses.RARE]
        offsets = {i - j for i, w in enumerate(words) for j, v in enumerate(said) if w == v and w in rare}
        near = lambda at: range(max(0, at - licenses.SLACK), at + licenses.SLACK + 1)
        for at in offsets:
            share = sum(weight[w] for j, w in enumerate(said) if any(words[i : i + 1] == [w] for i in near(at + j))) / sum(weight[w] for w in said)
            sure = share >= licenses.SHARE
            for key in map(str.split, keys):
                start = next(j for j in range(len(said)) if said[j : j + len(key)] == key)
                sure = sure and any(words[i : i + len(key)] == key for i in near(at + start))
            score = max(score, share if sure else share / 2)
            labels |= {label} if sure else set()
    base = ",".join(sorted({x for _, x in places}))
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), base, ",".join(sorted(labels)), score


def test_licenses_equal_brute_force(spark):
    rng = random.Random(3)
    noise = ["the", "of", "mit", "license", "gnu", "public", "general", "cc", "by", "version", "2", "software", "permission", "with"]
    notices = [x[0] for x in licenses.NOTICES.values()] + list(licenses.BASE.values())

    def edited(text):
        words = text.split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(noise)
        if rng.random() < 0.5:
            words.insert(rng.randrange(len(words)), "extra")
        return " ".join(words).upper() if rng.random() < 0.3 else " ".join(words)

    texts = [" ".join(rng.choices(noise, k=rng.randrange(0, 25)) + [edited(rng.choice(notices))] + rng.choices(noise, k=rng.randrange(0, 25))) for _ in range(300)]
    texts += [None, "", "---", "MIT License", "x mit-license", "mit\nlicense mit license", "gnu general public", "word " * 30_000 + "GNU General Public License, version 3", *notices]
    frame = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, said string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in licenses.scan_licenses(frame).collect()}
    assert got == {i: _license(t) for i, t in enumerate(texts)}
    assert any("gpl-3.0" in r[5] for r in got.values()) and licenses.scan_licenses(nothing(spark)).count() == 0
    assert licenses.scan_licenses(documents(spark)).count() == documents(spark).count()


def _lloyd(rows, entries=16, rounds=6):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [int(math.floor(4096 * v)) for v in r[1]]))
    whole = [[math.floor(4096 * v) for v in r[1]] for r in rows]
    d = len(whole[0]) // 8
    cut = [[w[p * d : (p + 1) * d] for w in whole] for p in range(8)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e, strict=True)), i) for i, e in enumerate(b))
    for _ in range(rounds):
        for p in range(8):
            own = [near(x, books[p])[1] for x in cut[p]]
            for e in range(len(books[p])):
                mine = [x for x, o in zip(cut[p], own, strict=True) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, r in enumerate(rows):
        best = [near(cut[p][i], books[p]) for p in range(8)]
        out.append((r[0], r[2], [b[1] for b in best], sum(b[0] for b in best)))
    by = Counter()
    for r in out:
        by[r[1]] += r[3]
    return Counter((r[0], tuple(r[2]), r[3], by[r[1]]) for r in out), books


def _codes(spark, rows, kind="array<double>", heavy=1000):
    tables = Tables(spark)
    found, books = vector_codes.vector_codes(spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding {kind}, label int, row string, at int").repartition(3), tables)
    got = Counter((r["vec_id"], tuple(r["entries"]), r["error"], r["label_error"]) for r in found.collect())
    tables.drop()
    return got, books


@pytest.mark.parametrize("heavy", [2, 1000])
def test_codes_equal_plain_lloyd(spark, monkeypatch, heavy):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 16)).round(2)
    x[::3] = x[0]
    rows = [(i, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(x)] + [(7, x[8].tolist(), 1), (None, x[9].tolist(), 2)]
    dropped = [(500, None, 1), (501, [math.nan] * 16, 1), (502, [1.0] * 15 + [None], 1), (503, [math.inf] * 16, None)]
    join = vector_codes.join_weighted
    monkeypatch.setattr(vector_codes, "join_weighted", lambda a, b, k, n: join(a, b, k, n, heavy))
    got, books = _codes(spark, rows + dropped)
    want, plain = _lloyd(rows)
    assert got == want and [b.tolist() for b in books] == plain
    assert vector_codes.books_sha256(books) == hashlib.sha256(",".join(str(v) for b in plain for e in b for v in e).encode()).hexdigest()


def test_codes_of_few_large_and_no_vectors(spark):
    rows = [(i, [float(i)] * 8, i) for i in range(5)]
    got, books = _codes(spark, rows)
    assert got == _lloyd(rows)[0] and [b.tolist() for b in books] == [[[4096 * i] for i in range(5)]] * 8
    large = [(i, [(-1.0) ** i * 10.0 ** (i + 3)] * 8, 0) for i in range(9)] * 3
    assert _codes(spark, large)[0] == _lloyd(large)[0]
    assert sum(_codes(spark, [(1, [1e300, -1e300] * 4, 0), (2, [0.5] * 8, None), (3, [1.0] * 3, 0)])[0].values()) == 2
    got, books = _codes(spark, [(1, None, 1)])
    assert not got and books == []
    got, _ = _codes(spark, [(1, [0.5, 0.25, 1.0], 1), (2, [0.5, 0.25, 2.0], 1)])
    assert got == Counter({(1, (0,) * 8, 0, 0): 1, (2, (0, 0, 1) + (0,) * 5, 0, 0): 1})


def test_registered(spark):
    assert {"op11_impact_search", "op12_license_scan", "op13_vector_codes"} <= set(queries.queries()) & set(queries.oracle_sql())
    assert queries.op12_license_scan(spark, "/root/testdata/sf0.01").filter(F.col("labels").contains("gpl")).count() > 0
