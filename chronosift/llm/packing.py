"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents become pieces: only one longer than the capacity is cut, into full pieces after a first
piece that takes the remainder. The number of sequences then depends on the histogram of piece
lengths alone, which has at most `capacity` entries whatever the corpus. Over it the driver solves
the configuration linear program (fewest patterns of lengths that cover the histogram) by
multiplicative weights: each length has a dual weight, a knapsack dynamic program prices the pattern of
most weight, and the weights of what it covers fall. Every pricing also gives a lower bound of the
program (all pieces' weight over the best pattern's), so the plan comes with a figure that no packing can
go below. The solution is rounded down and what remains is packed by best fit: the longest piece left, filled up
as far as subset sums allow. Where the plan is more than GAP above it, further learning rates are tried, and best fit alone (with subset sums, and decreasing); the
plan with the fewest sequences counts. The plan says, for each length, which places its pieces take in turn; every
piece finds its own by its rank within its length.

With positions (say, of a mixture) ranks follow them, the plan is used in slices with a share of
each pattern, so that the pieces of a sequence come from nearby, and sequences are numbered by the
mean position of their tokens. The number of sequences stays the same.

Token ids come from a byte-level BPE rank file through tiktoken: the ids of the same vocabulary
in the `tokenizers` format, several times as fast. The added tokens of that format keep their own ids where
their strings stand in a text, as `tokenizers` has it by default; with as_text they are ordinary text.

Defined results: a null text counts as empty, and an empty document is its end token alone;
repeated rows are packed each for itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_within, scratch, small_batches

CAPACITY, END_ID, ROUNDS, STEP, BEND = 1024, 2, 300, 0.5, 1.1
#: Learning rates, the first of which is used alone if its plan is so near to the bound.
LEARNING, GAP = (0.2, 1.0, 4.0), 0.0005
#: Slices of a plan at most, and entries of the plan in slices.
MAX_SLICES, MAX_ENTRIES = 4096, 1 << 15


def _encoder(ranks_path: str, special: dict[str, int]):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The added tokens of a vocabulary in the `tokenizers` format."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ranks: str | None = None, added: dict[str, int] | None = None, as_text: bool = False, with_ids: bool = True, position: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves and the row's position.

    added: the strings with ids of their own, by default those of the public vocabulary; as_text: none.
    """
    path, special = ranks or default_ranks(), {} if as_text else added_tokens() if added is None else added

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = _encoder(path, special)
        for batch in small_batches(batches, "text"):
            rows, all_ids = [], []
            for i, said in enumerate(batch.column("text").to_pylist()):
                found = encoder.encode_to_numpy(said, allowed_special="all", disallowed_special=()) if said else np.empty(0, np.uint32)
                ids = np.append(found, end_id).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((i, k, start, length, zlib.crc32(own.tobytes())))
                    if with_ids:
                        all_ids.append(own.astype(np.int32))
            table = np.array(rows, np.int64).reshape(-1, 5)
            at = pa.array(table[:, 0])
            columns = [batch.column("doc_id").take(at), pa.array(table[:, 1].astype(np.int32)), *[pa.array(table[:, k]) for k in (2, 3, 4)]]
            columns += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids + ([batch.column("position").take(at)] if position else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["position"] * bool(position))

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", position long" * bool(position)
    cols = [F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    return docs.select(*cols, *([F.col(position).cast("long").alias("position")] if position else [])).mapInArrow(encode, kinds)


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[list[int], float]:
    """Indices into lengths of the most valuable pattern (an item may come several times), and its value."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            got = best[c - lengths[:k]] + values[:k]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], taken[c] = got[i], i
    out, c = [], capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            out.append(int(taken[c]))
            c -= int(lengths[taken[c]])
    return out, float(best[capacity])


def _fill(left: dict[int, int], room: int) -> list[int]:
    """The lengths that fill room best, each as often as left allows, long ones preferred."""
    out: list[int] = []
    while room > 0:
        fits = [n for n in left if n <= room and left[n] > out.count(n)]
        if not fits:
            break
        # sums that one, two or three further pieces reach, as bits
        sums = 0
        for n in fits:
            sums |= 1 << n
        pairs = 0
        for n in fits:
            pairs |= sums << n
        reach = sums | (pairs & ((1 << (room + 1)) - 1))
        top = reach.bit_length() - 1
        longest = max(fits)
        if top == longest or not pairs:
            out.append(longest)
            room -= longest
            continue
        take = next((n for n in sorted(fits, reverse=True) if n == top or (sums >> (top - n)) & 1), longest)
        out.append(take)
        room -= take
    return out


def _best_fit(left: dict[int, int], capacity: int, plan: dict[tuple[int, ...], int]) -> None:
    """Packs what is left into the plan."""
    left = {n: k for n, k in left.items() if k > 0}
    while left:
        first = max(left)
        left[first] -= 1
        key = (first, *sorted(_fill(left, capacity - first), reverse=True))
        left[first] += 1
        times = min(left[n] // key.count(n) for n in set(key))
        plan[key] = plan.get(key, 0) + times
        for n in key:
            left[n] -= times
        left = {n: k for n, k in left.items() if k > 0}


def _best_fit_decreasing(left: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Each piece, longest first, into the fullest sequence with room; equal sequences are counted together."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for n in sorted(left, reverse=True):
        k = left[n]
        while k > 0:
            room = min((r for r in rooms if r >= n), default=capacity)
            if room in rooms:
                key = next(iter(rooms[room]))
                times = min(k, rooms[room][key])
                rooms[room][key] -= times
                if not rooms[room][key]:
                    del rooms[room][key]
                if not rooms[room]:
                    del rooms[room]
            else:
                each = capacity // n
                key, times = (), max(1, k // each)
                if each > 1 and k >= each:  # equal pieces fill whole sequences one after the other
                    own = rooms.setdefault(capacity - each * n, {})
                    own[(n,) * each] = own.get((n,) * each, 0) + times
                    k -= each * times
                    continue
                times = 1
            own = rooms.setdefault(room - n, {})
            own[(*key, n)] = own.get((*key, n), 0) + times
            k -= times
    out: dict[tuple[int, ...], int] = {}
    for own in rooms.values():
        for key, times in own.items():
            out[key] = out.get(key, 0) + times
    return out


def _program(left: dict[int, int], capacity: int, rounds: int, step: float, learning: float, bend: float) -> tuple[dict[tuple[int, ...], int], float]:
    """One run of multiplicative weights over the lengths left: the rounded plan, and a lower bound."""
    lengths = np.array(sorted(left), dtype=np.int64)
    need = np.array([left[n] for n in lengths], float)
    plan: dict[tuple[int, ...], int] = {}
    covered, x, bound = np.zeros(len(lengths)), {}, float((need * lengths).sum()) / capacity
    for _ in range(rounds):
        open_ = need - covered
        if open_.max() < 1:
            break
        # the more of a length is covered, beyond the others, the less its pieces are worth
        share = covered / need
        values = np.where(open_ >= 1, (lengths / capacity) ** bend * np.exp(-learning * (share - share.min())), 0)
        pattern, worth = price(values, lengths, capacity)
        # weights over the best pattern's worth are a solution of the dual program
        bound = max(bound, float((need * values).sum()) / worth) if worth > 0 else bound
        chosen = np.bincount(pattern, minlength=len(lengths))
        used = np.flatnonzero(chosen * (open_ >= 1))
        if not len(used):
            break
        amount = max(step * (open_[used] / chosen[used]).min(), min(1.0, (open_[used] / chosen[used]).min()))
        chosen = np.where(open_ >= 1, chosen, 0)
        covered += amount * chosen
        key = tuple(int(lengths[i]) for i in used[::-1] for _ in range(chosen[i]))
        x[key] = x.get(key, 0.0) + amount
    rest = dict(left)
    for key, amount in sorted(x.items(), key=lambda p: (sum(p[0]), p[1], p[0]), reverse=True):
        times = int(min(amount + 1e-9, *(rest[n] // key.count(n) for n in set(key))))
        if times > 0:
            plan[key] = plan.get(key, 0) + times
            for n in key:
                rest[n] -= times
    _best_fit(rest, capacity, plan)
    return plan, bound


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = STEP, learning: tuple[float, ...] = LEARNING, bend: float = BEND) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Patterns (lengths, longest first) and how often each is used, and a lower bound of sequences.

    They use every piece once.
    """
    left = {n: k for n, k in histogram.items() if k > 0}
    full = left.pop(capacity, 0)
    best: dict[tuple[int, ...], int] = {}
    bound = 0.0
    if left:
        _best_fit(dict(left), capacity, best)
        plain = _best_fit_decreasing(left, capacity)
        best = plain if sum(plain.values()) < sum(best.values()) else best
        for rate in learning:
            plan, low = _program(left, capacity, rounds, step, rate, bend)
            bound = max(bound, low)
            if sum(plan.values()) <= sum(best.values()):
                best = plan
            if sum(best.values()) <= math.ceil(bound - 1e-6) * (1 + GAP):
                break
    if full:
        best[(capacity,)] = full
    return sorted(best.items()), full + math.ceil(bound - 1e-6)


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, in order of rank: from which rank which sequences, places and offsets hold."""
    rows, at, sequences = [], {}, 0
    for key, times in plan:
        offset = 0
        for n in sorted(set(key), reverse=True):
            k = key.count(n)
            rows.append((n, at.get(n, 0), sequences, k, offset))
            at[n] = at.get(n, 0) + k * times
            offset += n * k
        sequences += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "from": table[:, 1], "sequence": table[:, 2], "each": table[:, 3], "offset": table[:, 4], "sequences": np.array([sequences])}


def in_slices(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """The plan dealt over slices: each has its share of every pattern (to the next whole number)."""
    times, slices = np.array([n for _, n in plan], dtype=np.int64), MAX_SLICES
    while slices > 1 and np.minimum(times, slices).sum() > MAX_ENTRIES:
        slices //= 2
    phase = np.arange(len(plan)) * 0.6180339887 % 1
    upto = np.floor(times[:, None] * (np.arange(slices + 1) / slices) + phase[:, None]).astype(np.int64)
    own = np.diff(upto, axis=1)
    return [(plan[p][0], int(own[p, e])) for e, p in np.argwhere(own.T)]


_RANK_BITS = 48


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, positions: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces, which is read three times.

    positions: their number; pieces then have a position below it, which ranks and sequences follow.
    """
    sizes = {int(r["length"]): int(r["count"]) for r in cut_pieces.groupBy("length").count().collect()}
    plan, _ = solve(sizes, capacity)
    at = places(plan if positions is None else in_slices(plan))
    keys = (at["length"] << _RANK_BITS) | at["from"]
    cols = cut_pieces.columns
    by, range_ = ["doc_id", "piece", "ids_crc32"], {} if positions is None else {"along": "position", "upto": positions}
    ranked = rank_within(cut_pieces, "length", ["position", *by] if range_ else by, sorted(sizes.items()) or [(0, 0)], key_type="long", **range_)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            i = np.searchsorted(keys, (batch["length"].to_numpy(np.int64) << _RANK_BITS) | batch["rank"].to_numpy(np.int64), side="right") - 1
            nth = batch["rank"].to_numpy(np.int64) - at["from"][i]
            batch["sequence_id"] = at["sequence"][i] + nth // at["each"][i]
            batch["offset"] = at["offset"][i] + nth % at["each"][i] * at["length"][i]
            if "doc_id" in batch:
                batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch.drop(columns="rank")

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema.fields)
    packed = ranked.select(*cols, "rank").mapInPandas(put, f"{kinds}, sequence_id long, offset long")
    return packed if positions is None else _numbered(scratch(packed, "packed"), int(at["sequences"][0]), positions)


def _numbered(packed: DataFrame, sequences: int, positions: int) -> DataFrame:
    """packed with sequences numbered by the mean position of their tokens."""
    middle = F.floor(F.sum(F.col("position") * F.col("length")) / F.sum("length")).alias("__middle")
    middles = packed.groupBy("sequence_id").agg(middle).withColumn("__all", F.lit(0).cast("long"))
    numbers = rank_within(middles, "__all", ["__middle", "sequence_id"], [(0, sequences)], rank="__number", key_type="long", along="__middle", upto=positions)
    out = packed.join(numbers.select("sequence_id", "__number"), "sequence_id")
    return out.select(*[F.col("__number").alias(c) if c == "sequence_id" else F.col(c) for c in packed.columns])


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ranks: str | None = None, with_ids: bool = False, position: str | None = None, positions: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids, position,) sequence_id, offset for every piece.

    position: a column with the rows' places in an order that the sequences follow, from 0 to below positions.
    """
    cut_pieces = pieces(docs, doc_id=doc_id, text=text, capacity=capacity, end_id=end_id, ranks=ranks, with_ids=with_ids, position=position)
    return pack(scratch(cut_pieces, "pieces"), capacity, positions if position else None)
