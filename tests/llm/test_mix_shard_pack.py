import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chronosift.llm import packing
from chronosift.llm.kd_sharding import kd_shards
from chronosift.llm.pfair_mix import mix, schedule, units, whole_weights, windows

from .data import documents, nothing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 1000)), min_size=1, max_size=7))
def test_schedule_stays_within_a_block(sources):
    blocks, weights = [b for b, _ in sources], [w for _, w in sources]
    slots = schedule(blocks, weights)
    assert [s for *_, s in slots] == list(range(sum(blocks)))
    assert Counter(s for s, _, _ in slots) == Counter(dict(enumerate(blocks)))
    due = windows(blocks, weights)
    for s, i, slot in slots:
        assert due[s][i][0] <= slot < due[s][i][1]
    # the fluid schedule, by its definition
    fluid, done, left, t = [Fraction(0)] * len(blocks), [0] * len(blocks), set(range(len(blocks))), Fraction(0)
    order = iter(slots)
    end = 0
    while left:
        rate = {s: Fraction(weights[s], sum(weights[x] for x in left)) for s in left}
        step = min(min((blocks[s] - fluid[s]) / rate[s] for s in left), end + 1 - t)
        for s in left:
            fluid[s] += rate[s] * step
        t += step
        left = {s for s in left if fluid[s] < blocks[s]}
        if t == end + 1:
            done[next(order)[0]] += 1
            end += 1
            assert all(abs(f - d) < 1 for f, d in zip(fluid, done, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 7)), min_size=1, max_size=6))
def test_units_put_together_are_a_schedule(sources):
    """Every block of every unit has a slot of its own within its window, however many units there are."""
    blocks, weights = [b for b, _ in sources], [w for _, w in sources]
    runs, due, got = units(blocks, weights), windows(blocks, weights), []
    plans = [{(s, i): slot for s, i, slot in schedule(own, weights)} for _, _, own in runs]
    assert len(runs) <= 2 * len(sources) + 1
    for s, n in enumerate(blocks):
        for i in range(n):
            m = i // weights[s]
            r = max(k for k, run in enumerate(runs) if run[0] <= m)
            slot = runs[r][1] + (m - runs[r][0]) * sum(runs[r][2]) + plans[r][s, i - m * weights[s]]
            assert due[s][i][0] <= slot < due[s][i][1]
            got.append(slot)
    assert sorted(got) == list(range(sum(blocks)))


def test_whole_weights():
    assert whole_weights([0.75, 0.25]) == [3, 1] and whole_weights([0.7, 0.2, 0.1]) == [7, 2, 1]
    assert whole_weights([1e9, 1.0, 0.5]) == [16383, 1, 1] and whole_weights([]) == []
    rough = whole_weights([2**0.5, 3**0.5])
    assert sum(rough) <= 1 << 14 and abs(rough[0] / sum(rough) - 2**0.5 / (2**0.5 + 3**0.5)) < 1e-4


def test_mixed_rows_stay_within_a_block_of_their_shares(spark):
    """Rows of one byte a block, over many units: the rows themselves against the fluid schedule."""
    rows = [(i, "", "abc"[0 if i < 400 else 1 if i < 650 else 2]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(mix(docs, {"a": 0.5, "b": 0.3, "c": 0.2}, block_bytes=1, unit=16).collect(), key=lambda r: r["mix_position"])
    assert [r["mix_position"] for r in got] == list(range(900))
    left, fluid, done, w = {"a": 400, "b": 250, "c": 250}, dict.fromkeys("abc", Fraction(0)), Counter(), {"a": 5, "b": 3, "c": 2}
    for r in got:
        rest = Fraction(1)
        while rest and any(fluid[s] < left[s] for s in "abc"):
            open_ = [s for s in "abc" if fluid[s] < left[s]]
            step = min([rest, *[(left[s] - fluid[s]) * sum(w[x] for x in open_) / w[s] for s in open_]])
            for s in open_:
                fluid[s] += step * w[s] / sum(w[x] for x in open_)
            rest -= step
        done[r["source"]] += 1
        assert all(abs(fluid[s] - done[s]) < 1 for s in "abc")


def test_mix_query(spark, tmp_path):
    from chronosift.llm.queries import op1_pfair_mix

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_pfair_mix(spark, str(tmp_path)).collect()
    assert sorted(r["position"] for r in got) == list(range(documents(spark).count()))


def test_mix_keeps_every_row(spark):
    docs = documents(spark)
    got = mix(docs, block_bytes=500).collect()
    assert len(got) == docs.count()
    assert sorted(r["mix_position"] for r in got) == list(range(len(got)))
    by = sorted(got, key=lambda r: r["mix_position"])
    assert [r["mix_slot"] for r in by] == sorted(r["mix_slot"] for r in got)
    assert sorted(str(r[:8]) for r in got) == sorted(str(tuple(r)) for r in docs.collect()) or Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    assert mix(nothing(spark)).count() == 0
    weighed = mix(docs, {"a": 3.0, None: 1.0}, block_bytes=500).collect()
    assert len(weighed) == len(got)


def test_shards(spark):
    docs = documents(spark)
    got = kd_shards(docs, 5).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert kd_shards(nothing(spark), 5).count() == 0


def test_shards_are_the_leaves_of_a_kd_tree(spark):
    """Brute force: every node is cut along its widest dimension, at its weighted quantile."""
    rows = [(i, "x" * int(2 ** (1 + i * 7919 % 1000 / 100)) + ("é" * (i % 50)), "en de fr".split()[i % 3], f"one_long_host{i * 31 % 97}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shard = {r["doc_id"]: r["shard"] for r in kd_shards(docs, 6).collect()}
    place = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() >> 11) / 2**53
    points = {i: (math.log2(len(t.encode()) + 8), math.log2(len(t) + 1), place(la), place(so)) for i, t, la, so in rows}
    size = {i: len(t.encode()) + 8 for i, t, _, _ in rows}
    unit = [max(p[d] for p in points.values()) - min(p[d] for p in points.values()) for d in range(4)]

    def check(ids, first, k):
        if k == 1:
            assert {shard[i] for i in ids} == {first}
            return
        width = [(max(points[i][d] for i in ids) - min(points[i][d] for i in ids)) / unit[d] for d in range(4)]
        wide = width.index(max(width))
        left, right = ([i for i in ids if (shard[i] < first + k // 2) == side] for side in (True, False))
        assert max(points[i][wide] for i in left) <= min(points[i][wide] for i in right) + unit[wide] * 1e-6
        assert abs(sum(size[i] for i in left) - sum(size[i] for i in ids) * (k // 2) / k) <= max(size.values()) * 2
        check(left, first, k // 2)
        check(right, first + k // 2, k - k // 2)

    check(list(points), 0, 6)


def test_shards_are_even_with_a_hot_text(spark):
    rows = [(i, "the same text again and again" if i % 3 == 0 else f"text {i} " * (i % 17), "en") for i in range(3000)]
    got = kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 24).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.03 * sum(sizes) / 24 + 600


def test_pieces_and_ids(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    own = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    odd = [(500, "x <|endoftext|> y"), (501, "<|endoftext|>"), (502, "<|endoftext|><|endoftext|>a<|endoftext"), (503, "word <|endoftext|> " * 2000), (504, "no newline at the end \n\n")]
    docs = documents(spark).select("doc_id", "text", "size").unionByName(spark.createDataFrame([(*r, 1) for r in odd], "doc_id long, text string, size int"))
    assert packing.added_tokens() == {"<|endoftext|>": 50256}
    got = packing.pack_documents(docs, with_ids=True).collect()
    parts = defaultdict(list)
    for r in got:
        parts[r["doc_id"]].append(r)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    for key, said in texts.items():
        ids = own.encode(said[0], add_special_tokens=False).ids + [2]
        pieces = sorted({r["piece"]: r for r in parts[key]}.values(), key=lambda r: r["piece"])
        assert [i for p in pieces for i in p["ids"]] == ids
        assert [(p["start"], p["length"]) for p in pieces] == packing.cut(len(ids), 1024)
        assert len(parts[key]) == len(said) * len(pieces)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p["ids"]))
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(nothing(spark)).count() == 0
    plain = packing.pieces(docs.filter("doc_id = 500"), as_text=True).head()["ids"]
    own.encode_special_tokens = True
    assert plain == own.encode("x <|endoftext|> y", add_special_tokens=False).ids + [2]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), min_size=1, max_size=30))
def test_plan_uses_each_piece_once(histogram):
    plan, bound = packing.solve(histogram, 64, rounds=40)
    used = Counter()
    for key, times in plan:
        assert sum(key) <= 64 and times > 0
        for n in key:
            used[n] += times
    assert used == Counter(histogram)
    total, sequences = sum(n * k for n, k in histogram.items()), sum(t for _, t in plan)
    rooms: list[int] = []  # best fit decreasing, piece by piece
    for n in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
        room = min((r for r in rooms if r >= n), default=None)
        if room is None:
            rooms.append(64 - n)
        else:
            rooms[rooms.index(room)] = room - n
    assert -(-total // 64) <= bound <= sequences <= len(rooms)


def _fewest(items, capacity):
    """The fewest sequences, by trying everything."""
    best, rooms = len(items), []

    def put(i):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                rooms[k] -= items[i]
                put(i + 1)
                rooms[k] += items[i]
        rooms.append(capacity - items[i])
        put(i + 1)
        rooms.pop()

    put(0)
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_plan_against_everything_tried(items):
    plan, bound = packing.solve(Counter(items), 20, rounds=40)
    least = _fewest(sorted(items, reverse=True), 20)
    assert bound <= least <= sum(t for _, t in plan) <= least + 1


def test_program_beats_best_fit_where_three_pieces_barely_fit():
    sizes = {300 + i: 200 + (i * 37) % 41 for i in range(121)}
    plan, bound = packing.solve(sizes)
    alone: dict = {}
    packing._best_fit(dict(sizes), 1024, alone)
    assert bound <= sum(t for _, t in plan) <= 0.96 * sum(alone.values())


def test_rounded_weights_stay_near_the_given_ones():
    """Shares that no small denominator has: what rounding moves a source by within as many blocks as are planned for."""
    share = [math.sqrt(x) for x in (2, 3, 5, 7, 1000)]
    for blocks in (10, 1000, 60_000):
        whole = whole_weights(share, max(1 << 14, 16 * blocks))
        assert all(abs(w / sum(whole) - s / sum(share)) * blocks < 1 / 8 for w, s in zip(whole, share, strict=True))


def test_mixture_of_given_weights_row_by_row(spark):
    """Every prefix of the mixture against the given weights, until a source runs out."""
    rows = [(i, "x", "abc"[i % 3], 1) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    given = {"a": math.sqrt(2), "b": math.sqrt(3), "c": math.pi}
    got = [r["source"] for r in mix(docs, given, size="size", block_bytes=1).orderBy("mix_position").collect()]
    served = {k: 0 for k in given}
    for i, s in enumerate(got, 1):
        served[s] += 1
        if max(served.values()) == 300:
            break
        assert all(abs(served[k] - i * v / sum(given.values())) < 1 + 1 / 8 for k, v in given.items())
