"""Near-duplicate detection by a chosen-path set similarity join over minwise tokens.

A document's set are the hashes of its distinct word shingles; POSITIONS minwise hashes stand for it.
Equal word sequences form a class first, of which one representative goes on. In each of TREES
independent trees a node picks one or two token positions (1 / 0.8 on average) by hash, and a
document moves on to the child of each picked position and its token there; the first two levels are
taken at once. Nodes of at most LEAF documents are compared exhaustively (but for pairs that others connect). A larger node is compared with
ROUNDS pivots first, each a member that is linked to nothing yet: a node whose members are all connected
is finished; if few members are outside its largest component, those are compared with all; else the
node branches again. Nodes that are still large after MAX_LEVEL levels compare their other members with
all, so nothing is dropped or capped. Estimates from the tokens only nominate pairs (FLOOR is four
standard errors below the threshold); links are confirmed on the full sets.

A link is missed only if no tree keeps the pair together: at similarity 0.8 a tree does with a
probability of 0.73 after two levels, 0.64 after three, 0.58 after four, 0.52 after five and 0.48 after
six, the deepest, so ten trees miss 2e-6 to 2e-4, and 6e-4 to 1.5e-3 in nodes that stay large for so long.

Where a group's members are already connected, further pairs aren't compared: components are the
same, and groups of thousands of near copies cost as many comparisons as they have members, not
their square. Components come from alternating large-star and small-star steps, in tables.
Tables of tokens are cut down to the documents that a step needs before they are joined. Memberships are kept
as one row a representative with its nodes, so that labels and tokens are joined once a representative.

Defined results: a null or wordless text has no set, links with nothing and stays; rows of one id
are one document with the links of all its texts, a wordless one among them included; equal rows get equal
results; a row with a null id is kept, with a null component; other columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, small_batches

WIDTH, THRESHOLD = 5, 80
POSITIONS, TREES, LEAF, ROUNDS, REST, MAX_LEVEL, FLOOR = 128, 10, 4096, 3, 16, 5, 0.65
#: Rows of a few ids, rows of tokens, and bytes of sets that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_TOKENS, BROADCAST_SETS = 50_000, 2_000, 4 << 20
#: Links that one task may connect (8 MB); more take large-star and small-star steps.
LOCAL_LINKS = 500_000
_PIECE = 1 << 19
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CACHE: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= _PIECE + 1 and "up" in _CACHE:
        return _CACHE["up"][:n], _CACHE["down"][:n]
    size = max(n, _PIECE + 1)
    up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size == _PIECE + 1:  # those of longer texts don't stay in the worker
        _CACHE["up"], _CACHE["down"] = up, down
    return up[:n], down[:n]


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of every word of a lower-cased buffer."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])))
        return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)), start


def shingle_sets(texts: list[str | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes of its words, in order, and of its distinct shingles, sorted."""
    raws = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) < _PIECE):
            size += len(raws[end]) + 1
            end += 1
        words, starts = _word_hashes(b"\n".join(raws[at:end]))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws[at:end]]))
        with np.errstate(over="ignore"):
            n = max(len(words) - width + 1, 0)
            rolled = np.zeros(n, np.uint64)
            for j in range(width):
                rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
            rolled = mix(rolled)
            for i in range(end - at):
                own = words[bounds[i] : bounds[i + 1]]
                if len(own) >= width:
                    yield own, np.unique(rolled[bounds[i] : bounds[i + 1] - width + 1])
                elif len(own):
                    short = np.uint64(len(own))
                    for w in own:
                        short = short * np.uint64(0xD6E8FEB86659FD93) + w
                    yield own, mix(np.array([short], np.uint64))
                else:
                    yield own, own
        at = end


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1), mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64))


def minwise(shingles: np.ndarray, n: int = POSITIONS) -> np.ndarray:
    """n minwise tokens of 32 bits."""
    a, b = _seeds(n)
    least = np.full(n, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for s in range(0, len(shingles), 4096):
            least = np.minimum(least, ((shingles[None, s : s + 4096] ^ b[:, None]) * a[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, k1 and k2 (of the word sequence), n_shingles, tokens."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in small_batches(batches, "text"):
            keys, counts, tokens = [], [], []
            for words, own in shingle_sets(batch.column("text").to_pylist(), width):
                keys.append(np.frombuffer(hashlib.blake2b(words.tobytes(), digest_size=16).digest(), np.int64))
                counts.append(len(own))
                tokens.append(minwise(own).tobytes() if len(own) else None)
            k = np.array(keys, np.int64).reshape(-1, 2)
            columns = [batch.column("doc_id"), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(counts, pa.int64()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "n_shingles", "tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(sign, "doc_id long, k1 long, k2 long, n_shingles long, tokens binary")


def _matrix(tokens: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(tokens), np.uint32).reshape(len(tokens), POSITIONS)


def _branch(rows: DataFrame, levels: int = 1) -> DataFrame:
    """(rep, nodes): the descendants, so many levels below, of rows (rep, nodes, tokens)."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            tokens, at = _matrix(batch["tokens"]), np.repeat(np.arange(len(batch)), batch["nodes"].map(len))
            node = np.concatenate(batch["nodes"].to_list()).astype(np.int64).astype(np.uint64)
            with np.errstate(over="ignore"):
                for _ in range(levels):
                    pick = mix(node + np.uint64(0x632BE59BD9B4E019))
                    first = (pick % np.uint64(POSITIONS)).astype(np.int64)
                    second = (first + 1 + ((pick >> np.uint64(20)) % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS
                    twice = (pick >> np.uint64(40)) % np.uint64(4) == 0
                    place = np.concatenate([first, second[twice]])
                    node, at = np.concatenate([node, node[twice]]), np.concatenate([at, at[twice]])
                    node = mix(node * np.uint64(0xD6E8FEB86659FD93) + tokens[at, place].astype(np.uint64) * np.uint64(256) + place.astype(np.uint64))
            order = np.argsort(at, kind="stable")
            yield pd.DataFrame({"rep": batch["rep"].to_numpy(), "nodes": np.split(node[order].astype(np.int64), np.searchsorted(at[order], np.arange(1, len(batch))))})

    return rows.select("rep", "nodes", "tokens").mapInPandas(move, "rep long, nodes array<long>")


def _flat(rows: DataFrame) -> DataFrame:
    """(node, rep) of rows (rep, nodes)."""
    return rows.select(F.explode("nodes").alias("node"), "rep")


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by key; a group may span batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[key].to_numpy()
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for s, e in zip(edges, edges[1:], strict=False):
            part = batch.iloc[s:e]
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _find(parent: dict, x):
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _clusters(leaves: DataFrame) -> DataFrame:
    """(cluster, rep): members of leaves (leaf, rep, tokens), joined where tokens nominate a pair."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, "leaf"):
            tokens, reps = _matrix(group["tokens"]), group["rep"].to_list()
            own = np.arange(len(reps))
            for i in range(len(reps) - 1):
                # those that are connected already add nothing
                apart = i + 1 + np.flatnonzero(own[i + 1 :] != own[i])
                if not len(apart):
                    continue
                hit = apart[(tokens[apart] == tokens[i]).mean(axis=1) >= FLOOR]
                if len(hit):
                    own[np.isin(own, own[hit])] = own[i]
            members: dict[int, list] = {}
            for i, k in enumerate(own.tolist()):
                members.setdefault(k, []).append(reps[i])
            for m in members.values():
                if len(m) > 1:
                    name = np.frombuffer(hashlib.blake2b(np.sort(np.array(m, np.int64)).tobytes(), digest_size=8).digest(), np.int64)[0]
                    yield pd.DataFrame({"cluster": np.full(len(m), name), "rep": np.array(m, np.int64)})

    dealt = leaves.select("leaf", "rep", "tokens").repartition("leaf").sortWithinPartitions("leaf")
    return dealt.mapInPandas(join, "cluster long, rep long").distinct()


def _alike(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _forest(clusters: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) of full sets that connect clusters (cluster, rep, shingles)."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, "cluster"):
            reps = group["rep"].to_list()
            sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
            _, own = np.unique(reps, return_inverse=True)
            links = []
            for i in range(len(reps)):
                for j in (i + 1 + np.flatnonzero(own[i + 1 :] != own[i])).tolist():
                    if own[i] != own[j] and _alike(sets[i], sets[j], threshold):
                        own[own == own[j]] = own[i]
                        links.append((reps[i], reps[j]))
                if (own == own[0]).all():
                    break
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    dealt = clusters.select("cluster", "rep", "shingles").repartition("cluster").sortWithinPartitions("cluster")
    return dealt.mapInPandas(confirm, "a long, b long")


def _few(df: DataFrame) -> DataFrame:
    """df by no more than four tasks a core, for tables of counts, pairs and ids."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def _light(rows: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A stored table, broadcast if it has few enough rows."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def _connect(links: DataFrame) -> DataFrame:
    """(v, u): every vertex of a task's links (v, u) and the least vertex that it reaches there."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch["v"].to_list(), batch["u"].to_list(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                x, y = _find(parent, a), _find(parent, b)
                parent[max(x, y)] = min(x, y)
        v = np.fromiter(parent, np.int64, len(parent))
        yield pd.DataFrame({"v": v, "u": np.fromiter((_find(parent, x) for x in v.tolist()), np.int64, len(v))})

    return links.mapInPandas(join, "v long, u long")


def connected_components(links: DataFrame, store=None, local: int = LOCAL_LINKS) -> DataFrame:
    """(v, component) of every end of links (a, b); component is the least id that v reaches.

    Few links are connected by one task, whose work `local` bounds. Else large-star and small-star
    steps alternate until nothing changes; each is a partial aggregate and a join, and no list
    of neighbours is gathered.
    """
    store = store or Tables(links.sparkSession).store
    # big > small in all tables
    edges = store(links.filter("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    if edges.count() <= local:
        return _connect(edges.coalesce(1)).withColumnRenamed("u", "component")
    while True:
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # large star: what is above v is hung on v's least
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: what is below v, and v, is hung on the least below
        below = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(below, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").filter("v != u").distinct()
        new = store(small, "stars")
        # stars alone: no vertex has two edges upward, and no centre hangs on another
        loose = new.groupBy("v").count().filter("count > 1").select("v").union(new.select(F.col("u").alias("v")).join(new.select("v"), "v", "left_semi"))
        if loose.isEmpty():
            return new.select("v", F.col("u").alias("component")).union(new.select(F.col("u").alias("v"), F.col("u").alias("component")).distinct())
        edges = new


class _Join:
    """The state of one similarity join."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, width: int, threshold: int) -> None:
        self.docs = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
        self.width, self.threshold = width, threshold
        self.tables = Tables(docs.sparkSession)
        self.signed = self.tables.store(signatures(docs, doc_id, text, width), "signatures", keep=True)
        known = self.signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"))
        self.reps = self.tables.store(classes.select("k1", "k2", "rep", "tokens"), "representatives", keep=True)
        self.tokens = self.reps.select("rep", "tokens")
        self.several = self.store(known_twice(self.signed), "several", keep=True)
        self.links: list[DataFrame] = []
        if not self.several.isEmpty():
            rows = self.signed.select("doc_id", "k1", "k2").join(_light(self.several), "doc_id", "left_semi").distinct()
            self.links.append(self.store(rows.join(self.reps.select("k1", "k2", "rep"), ["k1", "k2"]).filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "id-links"))

    def store(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """A small stored table."""
        return self.tables.store(_few(df), name, keep=keep)

    def only(self, table: DataFrame, wanted: DataFrame) -> DataFrame:
        """The rows of a table by rep that are wanted; few enough ids are broadcast, more are shuffled."""
        return table.join(_light(self.store(wanted.select("rep").distinct(), "wanted")), "rep", "left_semi")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(rep, shingles) of the wanted documents, from their texts."""
        width = self.width

        def measure(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in small_batches(batches, "text"):
                sets = [own.tobytes() for _, own in shingle_sets(batch.column("text").to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "shingles"])

        return self.tables.store(self.only(self.docs, wanted).select("rep", "text").mapInArrow(measure, "rep long, shingles binary"), "sets")

    def confirm(self, maybe: DataFrame) -> None:
        """Keeps those of the nominated pairs (a, b) that link."""
        threshold = self.threshold

        def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(batch["sa"], batch["sb"], strict=True)]
                yield batch.loc[np.array(keep, bool), ["a", "b"]]

        maybe = self.store(maybe.distinct(), "pairs")
        sets = self.sets(maybe.select(F.col("a").alias("rep")).union(maybe.select("b")))
        # pivots are few and stand in very many pairs
        pivots = self.tables.store(sets.join(_light(self.store(maybe.select(F.col("b").alias("rep")).distinct(), "pivot-ids")), "rep", "left_semi").select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "pivot-sets")
        small = (pivots.agg(F.sum(F.length("sb"))).head()[0] or 0) <= BROADCAST_SETS
        both = maybe.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(F.broadcast(pivots) if small else pivots, "b")
        self.links.append(self.store(both.mapInPandas(exact, "a long, b long"), "links"))

    def all_links(self) -> DataFrame:
        out = self.links[0]
        for x in self.links[1:]:
            out = out.union(x)
        return out

    def labelled(self, rows: DataFrame) -> DataFrame:
        """(node, rep) of rows (rep, nodes) with label, the component so far, and whether rep is linked at all."""
        if not self.links:
            return _flat(rows).select("node", "rep", F.col("rep").alias("label"), F.lit(False).alias("linked"))
        labels = self.store(connected_components(self.all_links(), self.store), "labels").select(F.col("v").alias("rep"), "component")
        known = rows.join(_light(labels), "rep", "left")
        return known.select(F.explode("nodes").alias("node"), "rep", F.coalesce("component", "rep").alias("label"), F.col("component").isNotNull().alias("linked"))

    def within(self, rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """rows (rep, nodes) cut down to some nodes."""
        return self.tables.store(_flat(rows).join(_light(nodes), "node").groupBy("rep").agg(F.collect_list("node").alias("nodes")), "large-nodes")

    def run(self) -> DataFrame:
        start = self.tokens.withColumn("nodes", F.array(*[F.lit(i).cast("long") for i in range(TREES)]))
        rows = self.tables.store(_branch(start, 2), "nodes")
        leaves, tokens = [], self.tokens
        for level in range(1, MAX_LEVEL + 1):
            sized = self.store(self.labelled(rows).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("node", "n"), "sizes")
            small, large = sized.filter(F.col("n") <= LEAF).select("node"), sized.filter(F.col("n") > LEAF).select("node")
            # at most LEAF members each; the same members in several trees are one leaf
            leaves.append(self.tables.store(_flat(rows).join(_light(small), "node").groupBy("node").agg(F.sort_array(F.collect_set("rep")).alias("members")).filter(F.size("members") > 1).select("members").distinct(), "leaves"))
            if large.isEmpty():
                break
            rows = self.within(rows, large)
            tokens = self.tables.store(self.only(tokens, rows), "large-tokens")
            rows = self.thin(rows, tokens, last=level == MAX_LEVEL)
            if rows is None:
                break
            rows = self.tables.store(_branch(rows.join(_light(tokens, BROADCAST_TOKENS), "rep")), "nodes")
        sets = leaves[0]
        for x in leaves[1:]:
            sets = sets.union(x)
        members = self.tables.store(sets.distinct().select(F.xxhash64("members").alias("leaf"), F.explode("members").alias("rep")), "members")
        clusters = self.store(_clusters(members.join(self.only(self.tokens, members), "rep")), "clusters")
        full = self.sets(clusters)
        self.links.append(self.tables.store(_forest(clusters.join(full, "rep"), self.threshold), "links"))
        return self.all_links()

    def paired(self, pairs: DataFrame, tokens: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that the tokens nominate; the same pair in several nodes counts once."""

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.loc[(_matrix(batch["ta"]) == _matrix(batch["tb"])).mean(axis=1) >= FLOOR, ["a", "b"]]

        once = self.store(pairs.filter("a != b").distinct(), "pivot-pairs")
        pivots = self.store(tokens.select(F.col("rep").alias("b"), F.col("tokens").alias("tb")).join(_light(once.select("b").distinct()), "b", "left_semi"), "pivot-tokens")
        own = tokens.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
        return once.join(own, "a").join(_light(pivots, BROADCAST_TOKENS), "b").mapInPandas(near, "a long, b long")

    def against(self, rows: DataFrame, few: DataFrame, tokens: DataFrame) -> DataFrame:
        """Nominated pairs (a, b) of rows (node, rep) with the few (node, b) of each node."""
        tokens = _light(tokens, BROADCAST_TOKENS)
        picked = few.join(tokens.withColumnRenamed("rep", "b"), "b").groupBy("node").agg(F.collect_list("b").alias("bs"), F.collect_list("tokens").alias("ts"))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    own, out = _matrix(batch["tokens"]), []
                    for i, (rep, bs, ts) in enumerate(zip(batch["rep"], batch["bs"], batch["ts"], strict=True)):
                        hit = (_matrix(list(ts)) == own[i]).mean(axis=1) >= FLOOR
                        out += [(rep, b) for b in np.asarray(bs)[hit].tolist() if b != rep]
                    yield pd.DataFrame(out, columns=["a", "b"])

        return rows.join(picked, "node").join(tokens, "rep").select("rep", "tokens", "bs", "ts").mapInPandas(near, "a long, b long")

    def thin(self, rows: DataFrame, tokens: DataFrame, last: bool) -> DataFrame | None:
        """Compares large nodes with pivots; the rows (node, rep) of those that must branch on."""
        flat = _flat(rows)
        for k in range(ROUNDS):
            own = self.labelled(rows)
            free = F.when(~F.col("linked"), F.xxhash64("rep", F.lit(k)))
            open_ = own.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("rep", free).alias("b"), F.count(free).alias("n"))
            pivots = self.store(open_.filter("lo != hi AND n > 0").select("node", "b"), "pivots")
            if pivots.isEmpty():
                break
            self.confirm(self.paired(flat.join(_light(pivots), "node").select(F.col("rep").alias("a"), "b"), tokens))
        own = self.tables.store(self.labelled(rows), "labelled")
        main = own.groupBy("node", "label").count().groupBy("node").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        outside = own.join(main, "node").filter("label != main").select("node", F.col("rep").alias("b"))
        counts = self.store(outside.groupBy("node").count(), "counts")
        rest = self.store(outside.join(_light(counts.filter(F.col("count") <= REST).select("node")), "node"), "rest")
        if not rest.isEmpty():
            self.confirm(self.against(flat, rest, tokens))
        many = counts.filter(F.col("count") > REST)
        if many.isEmpty():
            return None
        if last:  # in portions of about REST, so that no row and no task grows beyond bounds
            part = F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / REST))
            portions = self.tables.store(outside.join(many, "node").select("node", "b", part.alias("part")), "portions")
            spread = flat.join(portions.select("node", "part").distinct(), "node").select(F.xxhash64("node", "part").alias("node"), "rep")
            self.confirm(self.against(spread, portions.select(F.xxhash64("node", "part").alias("node"), "b"), tokens))
            return None
        return self.within(rows, many.select("node"))


def known_twice(signed: DataFrame) -> DataFrame:
    """The ids (doc_id) of several different texts."""
    own = F.xxhash64("k1", "k2", "n_shingles")
    return signed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).filter("lo != hi").select("doc_id")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Documents link if 100 * shared shingles >= threshold * all shingles of both.
    """
    job = _Join(docs, doc_id, text, width, threshold)
    groups = job.tables.store(_few(connected_components(job.run(), job.store)), "components", keep=True)
    job.tables.drop()
    # classes of several documents, and their components
    of_class = job.reps.select("k1", "k2", "rep").join(groups.withColumnRenamed("v", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    with_set = F.col("n_shingles") > 0
    component = F.when(with_set, F.col("component"))
    out = job.signed.drop("tokens").join(of_class, ["k1", "k2"], "left")
    if not job.several.isEmpty():
        own = job.several.join(groups, F.col("doc_id") == F.col("v"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("own"))
        out, component = out.join(_light(own), "doc_id", "left"), F.coalesce("own", component)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
