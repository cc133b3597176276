import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronosift.llm import fingerprints, langid, line_dedup, near_dedup, quality
from chronosift.llm.common import scratch

from .data import documents, nothing


def _write(df, path, name="documents"):
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_gamma_quantiles():
    q = fingerprints.gamma_quantiles(1000)
    assert all(a < b for a, b in zip(q, q[1:], strict=False))
    assert abs(sum(q) / 1000 - 2) < 0.02
    assert all(abs(1 - (1 + x) * math.exp(-x) - (i + 0.5) / 1000) < 1e-9 for i, x in enumerate(q))


def test_tails_of_the_gamma_tables():
    t = fingerprints.gamma_tables(64)
    assert len(t) == 192 and t[63] < t[191] and t[64] < t[0] and sorted(t[64:128]) == t[64:128] and sorted(t[128:]) == t[128:]
    for i in (0, 31, 63):
        p = (i + 0.5) / 64**2
        x = t[64 + i]
        assert abs((1 - (1 + x) * math.exp(-x)) / p - 1) < 1e-6
        x = t[191 - i]
        assert abs((1 + x) * math.exp(-x) / p - 1) < 1e-9
    fine = fingerprints.gamma_quantiles(4096, 0.0, 1 / 4096)
    assert abs(fine[0] - (2 * 0.5 / 4096**2) ** 0.5) < 1e-6


def test_fingerprint_of_a_very_long_text(spark):
    """Half of the words are frequent and shared, half rare and replaced: the likeness is a third."""
    common = " ".join(f"common{i % 50}" for i in range(60_000))
    rows = [(k, common + " " + " ".join(f"rare{k}x{i}" for i in range(60_000))) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = fingerprints.fingerprint(docs, ["doc_id"], samples=256).collect()
    a, b = (r["signature"] for r in near)
    assert abs(sum(x == y for x, y in zip(a, b, strict=True)) / 256 - 1 / 3) < 0.1


@pytest.mark.parametrize("part_bytes", [40, 400, 1 << 22])
def test_next_document_over_many_parts(spark, part_bytes):
    rows = [(i * i % 1009 - 300, f"text {i} " * (1 + i % 9)) for i in range(200)] + [(None, "none"), (None, "other"), (5_000_000_000, "far"), (5_000_000_001, None)]
    rows = list({r[0]: r for r in rows}.values())
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), part_bytes=part_bytes).filter("NOT closing").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {a[0]: b[1] or "" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r["doc_id"]: r["next_text"] for r in got} == want and len(got) == len(rows)


def test_fingerprint_query(spark, tmp_path):
    from chronosift.llm.queries import op2_weighted_sampling

    docs = documents(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in op2_weighted_sampling(spark, _write(docs, tmp_path)).collect()}
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert len(got) == len(rows)
    prints = defaultdict(set)
    errors = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[key]["n_chars"] == len(text)
        prints[text].add(got[key]["fingerprint"])
        for other, near in ((edited, "near_edited"), (after, "near_next")):
            a, b = Counter(text.lower().split()), Counter(other.lower().split())
            exact = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
            errors.append(got[key][near] - exact)
    assert all(len(p) == 1 for p in prints.values())
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.3


def test_fingerprint_corner_cases(spark, tmp_path):
    from chronosift.llm.queries import op2_weighted_sampling

    assert op2_weighted_sampling(spark, _write(nothing(spark), tmp_path / "none")).count() == 0
    assert op2_weighted_sampling(spark, _write(documents(spark), tmp_path / "all")).count() == documents(spark).count()
    one = documents(spark).filter("doc_id = 13")
    r = op2_weighted_sampling(spark, _write(one, tmp_path / "one")).head()
    assert r["near_next"] == 1.0 and r["n_chars"] == 20


def _chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    ends = [i + 1 for i in range(len(lines)) if i == len(lines) - 1 or (h[i] + (h[i - 1] * 31 if i else 0)) % 2 == 0]
    return [lines[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def test_line_dedup(spark):
    docs = documents(spark)
    got = line_dedup.remove_repeated(docs).collect()
    assert len(got) == docs.count()
    # brute force; rows of one id and text are one document
    distinct = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in docs.collect() if r["text"] is not None})
    first = {}
    for has, key, text in distinct:
        for i, c in enumerate(_chunks(text)):
            said = "\n".join(c)
            if len(c) >= 2 and any(x.isalnum() for x in said):
                first.setdefault(said, (has, key, text, i))
    want = {}
    for has, key, text in distinct:
        kept = [x for i, c in enumerate(_chunks(text)) for x in c if first.get("\n".join(c), (has, key, text, i)) == (has, key, text, i)]
        want[(key if has else None, text)] = "\n".join(kept)
    originals = defaultdict(list)
    for r in docs.collect():
        originals[r["doc_id"]].append(r["text"])
    removed = 0
    for r in got:
        options = [t if t is None else want[(r["doc_id"], t)] for t in originals[r["doc_id"]]]
        assert r["text"] in options
        removed += r["removed_chunks"]
    assert removed >= 1
    assert line_dedup.remove_repeated(nothing(spark)).count() == 0


def _without_runs(docs):
    """Brute force over (doc_id, text) in order; also how many lines went."""
    first, out = {}, {}
    for key, text in docs:
        lines = text.split("\n")
        again = set()
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            before = first.setdefault(pair, (key, text, i))
            if before[:2] != (key, text) or i > before[2] + 1:
                again.add(i)
        gone = set()
        while again:
            i = j = min(again)
            while j in again:
                again.discard(j)
                j += 1
            if any(c.isalnum() for x in lines[i : j + 1] for c in x):
                gone |= set(range(i, j + 1))
        out[key, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_whole_runs_go(spark):
    rows, words = [], [f"w{i}" for i in range(50)]
    for n in range(2, 9):
        passage = "\n".join(f"Shared line {i} of the passage of {n}." if i != 3 else "" for i in range(n))
        for k in range(6):
            before, behind = (" ".join(words[(n * 7 + k * 5 + j) % 50] for j in range(4)) + f" {n} {k} {side}" for side in ("a", "b"))
            rows.append((100 * n + k, f"{before}\n{passage}\n{behind}"))
    rows += [(2000, "x\n\n\n\ny"), (2001, "x\n\n\n\ny\nz"), (2002, "a\na\na"), (2003, "p\np\np\np"), (2004, "r\ns\nr\ns\nr"), (2005, "\n\n\n"), (2006, "one"), (2007, "--\n--\nown"), (2008, "else\n--\n--")]
    got = {r["doc_id"]: r for r in line_dedup.remove_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _without_runs(rows)
    assert {k: r["text"] for k, r in got.items()} == {k: t for (k, _), t in want.items()}
    for n in range(2, 9):
        for k in range(1, 6):
            assert (got[100 * n + k]["removed_runs"], got[100 * n + k]["removed_lines"], got[100 * n + k]["n_lines"]) == (1, n, n + 2)
    assert [got[k]["text"] for k in (2001, 2002, 2003, 2004, 2005, 2008)] == ["z", "a\na\na", "p\np", "r\ns", "\n\n\n", "else\n--\n--"]


def test_whole_runs_of_awkward_rows(spark):
    docs = documents(spark)
    got = line_dedup.remove_runs(docs).collect()
    distinct = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in docs.collect() if r["text"] is not None})
    want = _without_runs([((has, key), text) for has, key, text in distinct])
    assert len(got) == docs.count()
    for r in got:
        assert r["text"] in [t if t is None else want[(r["doc_id"] is not None, r["doc_id"] or 0), t] for t in (x["text"] for x in docs.collect() if x["doc_id"] == r["doc_id"])]
    assert sum(r["removed_lines"] for r in got) == 6
    assert line_dedup.remove_runs(nothing(spark)).count() == 0


def _components(rows, width):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, parent = {}, {}
    for key, text in rows:
        w = [x for x in (text or "").translate(low).replace("\t", " ").replace("\n", " ").split(" ") if x]
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.setdefault(key, []).append(s)
        parent[key] = key

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                r, s = sorted((find(a), find(b)))
                parent[s] = r
    return {k: find(k) for k in keys}


def _near_docs(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect() if r["doc_id"] is not None]
    base = [f"w{(i * 37) % 503}" for i in range(300)]
    for k in range(260):  # more near copies than a leaf holds, each with a few words changed
        words = list(base)
        for j in range(4):
            words[(k * 29 + j * 71) % 300] = f"x{k}_{j}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000 + k, " ".join(base)) for k in range(30)]
    rows += [(3000 + k, " ".join(f"u{k}_{i}" if i % 3 else base[i] for i in range(60))) for k in range(40)]
    return rows


def test_near_duplicates(spark):
    rows = _near_docs(spark)
    docs = spark.createDataFrame(rows + [(None, "no id")], "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, width=4).collect()
    want = _components(rows, 4)
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_duplicates(nothing(spark)).count() == 0


def test_ids_with_several_texts(spark):
    """Rows of one id are one document: it links what its texts link."""
    say = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, say("a")), (5, say("a")), (5, say("b")), (9, say("b")), (9, None), (9, say("c")), (12, say("c") + " more"), (20, ""), (20, say("d")), (19, say("d")), (30, None), (30, say("e"))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, own int")
    got = near_dedup.near_duplicates(docs, width=4).collect()
    assert len(got) == len(rows)
    want = _components(rows, 4)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 5: 1, 9: 1, 12: 1, 19: 19, 20: 19, 30: 30}


def test_large_nodes_branch_on(spark, monkeypatch):
    """With tiny leaves everything goes through pivots, rests and deeper levels."""
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    monkeypatch.setattr(near_dedup, "REST", 2)
    monkeypatch.setattr(near_dedup, "MAX_LEVEL", 3)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    rows = _near_docs(spark)[-150:]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _components(rows, 4)
    got = near_dedup.near_duplicates(docs, width=4).collect()
    assert all(r["component_id"] == want[r["doc_id"]] for r in got)


def test_near_copies_of_very_long_texts(spark):
    base = [f"w{i * 7919 % 1_000_003}" for i in range(120_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-5000])), (3, " ".join(base[60_000:])), (4, " ".join(reversed(base)))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("local", [0, 500_000])
def test_components_of_a_long_path(spark, local):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (500, 502), (7, 7)], "a long, b long")
    got = {r["v"]: r["component"] for r in near_dedup.connected_components(links, local=local).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500, 502: 500}


def _phrases(said, own):
    """Greedy longest matches, by searching."""
    at = count = 0
    while at < len(said):
        n = 0
        while at + n < len(said) and said[at : at + n + 1] in own:
            n += 1
        at += max(n, 1)
        count += 1
    return count


def test_suffix_automaton_phrases():
    han = ["".join(chr(0x4E00 + 2 * ((i * i + 7 * i) % 1000) + k) for i in range(3000)) for k in (0, 1)]
    texts = {"a": "abracadabra abracad", "b": "banana bandana cabana", "x": han[0], "y": han[1]}
    model, letters = langid.train(texts), langid._letters()
    read = lambda t: "".join(chr(int(c)) if c else " " for c in langid.normalise(t, letters))
    said = ["abra", "banana", "zzz", "cadabra banana", "abracadabrabanana" * 6000, han[0][500:900], han[1][7:40] + han[0][:3], "", "ß", "b" * 100_000]
    for batch in (said, said * 3, said[4:5]):  # few and many at a time, texts of 100,000 characters whole
        got = langid.phrases(model, [langid.normalise(t, letters) for t in batch])
        for t, row in zip(batch, got, strict=True):
            assert row.tolist() == [_phrases(read(t), read(texts[k])) for k in model["langs"]]
    two = langid.phrases(model, [langid.normalise(han[1][100:400], letters)])[0]
    assert two[3] < 10 and two[2] == 300  # scripts with thousands of letters stay apart


def test_language_samples(spark):
    rows = [(i, f"word{i} " * (5000 if i == 3 else 20), "en") for i in range(400)] + [(500, "kurz", "de")] + [(7, "dupl", "fr")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(docs, "text", "lang", F.lit(True), 2000, "doc_id")
    assert len(got["en"]) == 2000 and len(set(got["en"].split())) > 10 and got["de"] == "kurz" and got["fr"] == "dupl"
    assert got == langid.sample(docs.repartition(7), "text", "lang", F.lit(True), 2000, "doc_id")


def test_language_id(spark, tmp_path):
    from chronosift.llm.queries import op6_cross_parsing

    got = op6_cross_parsing(spark, _write(documents(spark), tmp_path)).collect()
    assert len(got) == documents(spark).count()
    by = {r["doc_id"]: r for r in got}
    assert {k for k, r in by.items() if r["lang_pred"] == "und"} == {4, 5, 6, 7}
    assert by[8]["lang_pred"] == "de" and by[1]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert op6_cross_parsing(spark, _write(nothing(spark), tmp_path / "none")).count() == 0
    bare = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in op6_cross_parsing(spark, _write(bare, tmp_path / "bare")).collect()} == {"und"}


def test_quality_against_the_definition(spark):
    """Scores by plain covariances, inverses and determinants."""
    import numpy as np

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + ["Big", "x1", "!!", "a,b.", "\n"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(3, 60), p=None)) + ("!!! $$" * int(rng.integers(0, 4)) if i % 2 else ".")) for i in range(160)]
    docs = spark.createDataFrame([(*r, "own", 1, 2.0) for r in rows], "doc_id long, text string, x string, y int, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, labels, learn=F.lit(True), scratch=scratch).collect()}
    x = np.array([quality.statistics(t) for _, t in rows])
    y = np.array([i % 2 for i in range(120)])
    cov = {k: np.cov(x[:120][y == k].T, ddof=0) for k in (0, 1)}
    pooled = sum((y == k).mean() * cov[k] for k in (0, 1))
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    log = []
    for k in (0, 1):
        s = (0.9 * cov[k] + 0.1 * pooled) / np.outer(scale, scale)
        s = 0.98 * s + 0.02 * np.trace(s) / len(s) * np.eye(len(s)) + 1e-9 * np.eye(len(s))
        z = (x - x[:120][y == k].mean(axis=0)) / scale
        log.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    odds = log[1] - log[0]
    grid = np.geomspace(1, 64, 25)
    losses = [np.logaddexp(0, odds[:120] * np.where(y == 1, -1, 1) / t).sum() for t in grid]
    want = 1 / (1 + np.exp(-odds / grid[int(np.argmin(losses))]))
    assert len(got) == 160 and max(abs(got[i] - want[i]) for i in range(160)) < 1e-6


def test_quality(spark, tmp_path):
    from chronosift.llm.queries import op4_quality_qda

    good = [(i, f"This is sentence number {i}. It tells a short story of {i % 7} foxes and their den.\n" * (1 + i % 5), 1) for i in range(200)]
    bad = [(200 + i, f"BUY NOW {i}!!! $$$ ### BUY BUY BUY $$$ " * (1 + i % 6), 0) for i in range(200)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in good + bad] + [(900, None), (901, ""), (902, "x" * 200_000), (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in good + bad] + [(901, None), (None, 1)], "doc_id long, quality int")
    path = _write(docs, tmp_path)
    _write(labels, tmp_path, "labels")
    got = op4_quality_qda(spark, path).collect()
    assert len(got) == docs.count()
    truth = {k: y for k, _, y in good + bad}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    one_class = quality.score(docs, labels.filter("quality = 1"), learn=F.lit(True), scratch=scratch).collect()
    assert {r["score"] for r in one_class} == {0.5}
    none = nothing(spark)
    assert quality.score(none, labels, learn=F.lit(True), scratch=scratch).count() == 0
