"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A text is
cross-parsed whole against each: from its start, the longest match with any substring of the sample
is one phrase, and parsing goes on behind it. The language that needs the fewest phrases (normalised
by the text's length) wins. Texts are lower-cased; every run of characters other than letters becomes one
blank. Every letter of a sample is a symbol of its own, whatever the script; a letter that no sample
holds is a phrase of its own in every language.

Sample bound: of each language sample_chars characters, in excerpts of at most 1 / EXCERPTS of that,
which start at a hashed place of documents in the order of a hash; the draw is repeated with a larger
share while a language lacks characters and has rows left. Predictions cover all texts whole.

The automata of all languages share one table, in which each state's steps lie at its random place plus
the letter's number, so its size follows the samples' length and not the size of the alphabets.
A batch's texts run through the automata in lockstep; the last few long ones go on letter by letter.

Defined results: a text that is null or without letters has language `und` and score 0; ties go to
the language that sorts first; languages come from non-null labels only; without any labelled text
all is `und`; repeated rows are predicted each, and equal rows (of id and text) learned from once;
other columns are ignored, those of the found names replaced; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SAMPLE_CHARS, EXCERPTS = 24_000, 16
#: Texts that run in lockstep at least.
TOGETHER = 8
UNKNOWN = "und"
#: How fast a language's share in the score falls with its surplus of phrases.
SHARPNESS = 40.0


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def sample(docs: DataFrame, text: str, lang: str, learn: Column, sample_chars: int, doc_id: str) -> dict[str, str]:
    """A bounded sample of labelled text for each language."""
    piece = max(64, sample_chars // EXCERPTS)
    order = F.xxhash64(F.col(doc_id), F.col(text), F.lit("language sample"))
    start = F.pmod(F.xxhash64(order), F.greatest(F.char_length(text) - piece, F.lit(0)) + 1) + 1
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), order.alias("o"), F.substring(F.col(text), start.cast("int"), F.lit(piece)).alias("t"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.char_length("t")).alias("n")).collect()}
    share = {k: min(1.0, 4 * sample_chars / max(n, 1)) for k, n in sizes.items()}
    out: dict[str, str] = {}
    while share:
        upto = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(np.ceil(s * (1 << 20))))) for k, s in sorted(share.items())])
        got = rows.filter(F.pmod("o", F.lit(1 << 20)) < upto).groupBy("lang", "o").agg(F.min("t").alias("t")).collect()
        for k in share:
            said, size = [], 0
            for r in sorted((r for r in got if r["lang"] == k), key=lambda r: r["o"]):
                if size >= sample_chars:
                    break
                said.append(r["t"])
                size += len(r["t"]) + 1
            out[k] = "\n".join(said)[:sample_chars]
        share = {k: min(1.0, 8 * s) for k, s in share.items() if s < 1 and len(out[k]) < sample_chars}
    return out


def normalise(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text; each run of other characters is one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters[points], points, 0)
    return points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))] if len(points) else points


def automaton(text: list[int]) -> list[dict[int, int]]:
    """The steps (letter to state) of each state of the suffix automaton; state 0 is its start."""
    goes: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text:
        new = len(goes)
        goes.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = new
            p = link[p]
        if p >= 0:
            q = goes[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(goes)
                goes.append(dict(goes[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and goes[p].get(c) == q:
                    goes[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return goes


def _placed(steps: list[np.ndarray], alphabet: int) -> tuple[np.ndarray, int]:
    """A place for each state, all different, so that place + letter of all steps are different, and their bound.

    Those with most steps come first, while the table is empty; a clash draws again.
    """
    rng = np.random.default_rng(5)
    sizes = np.array([len(s) for s in steps], np.int64)
    place, room = np.zeros(len(steps), np.int64), 3 * max(int(sizes.sum()), len(steps)) + 16
    taken, named = np.zeros(room + alphabet, bool), np.zeros(room, bool)
    for k in np.unique(sizes)[::-1]:
        open_ = np.flatnonzero(sizes == k)
        letters = np.vstack([steps[i] for i in open_]).reshape(len(open_), k)
        while len(open_):
            at = rng.integers(0, room, len(open_))
            slots = at[:, None] + letters
            first, once = np.zeros(slots.size, bool), np.zeros(len(at), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            once[np.unique(at, return_index=True)[1]] = True
            good = first.reshape(slots.shape).all(axis=1) & ~taken[slots].any(axis=1) & once & ~named[at]
            place[open_[good]] = at[good]
            taken[slots[good]] = True
            named[at[good]] = True
            open_, letters = open_[~good], letters[~good]
    return place, room + alphabet


def train(texts: dict[str, str]) -> dict:
    """languages, the number of each code point, and one table of steps for all languages.

    A state is its place. Its step by letter c is at place + c, if the upper half there names the state,
    and then the lower half is the next state; else a phrase ends and the next begins with root[language, c].
    """
    langs, letters = sorted(texts), _letters()
    normal = {k: normalise(texts[k], letters) for k in langs}
    alphabet = np.unique(np.concatenate([np.empty(0, np.uint32), *normal.values()]))
    alphabet = alphabet[alphabet != 0].astype(np.int64)
    # 0 is the blank, 1 any letter that no sample holds
    kinds = np.ones(0x110000, np.int32)
    kinds[0] = 0
    kinds[alphabet] = np.arange(2, 2 + len(alphabet))
    goes: list[dict[int, int]] = []
    starts, roots = [], np.zeros((len(langs), 2 + len(alphabet)), np.int64)
    for i, k in enumerate(langs):
        own, at = automaton(kinds[normal[k]].tolist()), len(goes)
        # before any phrase: a state without steps, so that every letter begins one
        fresh = at + len(own)
        roots[i] = fresh
        for c, to in own[0].items():
            roots[i, c] = at + to
        goes += [{c: at + to for c, to in s.items()} for s in own] + [{}]
        starts.append(fresh)
    place, size = _placed([np.fromiter(s, np.int64, len(s)) for s in goes], 2 + len(alphabet))
    owner = np.repeat(place, [len(s) for s in goes])
    table = np.full(size, -1, np.int64)
    table[owner + np.fromiter((c for s in goes for c in s), np.int64, len(owner))] = owner << 32 | place[np.fromiter((t for s in goes for t in s.values()), np.int64, len(owner))]
    return {"langs": langs, "kinds": kinds, "table": table, "root": place[roots], "starts": place[np.array(starts, np.int64)]}


def phrases(model: dict, texts: list[np.ndarray]) -> np.ndarray:
    """The number of phrases [text, language] of whole normalised texts."""
    table, root, low = model["table"], model["root"], (1 << 32) - 1
    n_langs = len(model["starts"])
    out = np.zeros((len(texts), n_langs), np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not n_langs or not len(order):
        return out
    codes = model["kinds"][np.concatenate([texts[i] for i in order])]
    ends = np.cumsum(lengths[order])
    begin = ends - lengths[order]
    together = lengths[order[TOGETHER - 1]] if len(order) >= TOGETHER else 0
    active = np.searchsorted(-lengths[order], -np.arange(1, together + 1), side="right")
    state = np.repeat(model["starts"][:, None], len(order), axis=1)
    count = np.zeros((n_langs, len(order)), np.int64)
    for j, n in enumerate(active.tolist()):
        c = codes[begin[:n] + j]
        step = table[state[:, :n] + c]
        ends_here = step >> 32 != state[:, :n]
        count[:, :n] += ends_here
        state[:, :n] = np.where(ends_here, root[:, c], step & low)
    steps = memoryview(table)
    for i in np.flatnonzero(lengths[order] > together).tolist():
        rest = codes[begin[i] + together : ends[i]].tolist()
        for k in range(n_langs):
            own, s, n = root[k].tolist(), int(state[k, i]), 0
            for c in rest:
                step = steps[s + c]
                if step >> 32 == s:
                    s = step & low
                else:
                    s, n = own[c], n + 1
            count[k, i] += n
    out[order] = count.T
    return out


def identify(docs: DataFrame, *, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None, found: str = "lang_pred", sure: str = "score", rate: str | None = None, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """The columns `keep` of docs (all by default), and the language and score as `found` and `sure`.

    learn: which rows may be learned from. score: the winner's share of exp(-SHARPNESS * phrases
    a character) over all languages. rate: a column for the winner's phrases behind the first, a
    character (null where und).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(sample(docs, text, lang, learn, sample_chars, doc_id)))
    added = [found, sure, *([rate] if rate else [])]
    keep = [c for c in keep or docs.columns if c not in added]
    said = text if text in keep else "__said"
    source = docs.select(*keep, *([F.col(text).alias(said)] if said != text else []))

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, letters = shared.value, _letters()
        for batch in small_batches(batches, said):
            texts = [normalise(x, letters) if x else np.empty(0, np.uint32) for x in batch.column(said).to_pylist()]
            n = np.array([len(x) for x in texts])
            known = np.array([bool((x != 0).any()) for x in texts], bool) & bool(own["langs"])
            names, score, least = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if known.any():
                rates = phrases(own, [x if k else x[:0] for x, k in zip(texts, known, strict=True)]) / np.maximum(n, 1)[:, None]
                least = rates.min(axis=1)
                share = np.exp(-SHARPNESS * (rates - least[:, None]))
                score = np.where(known, 1 / share.sum(axis=1), 0.0)
                names = [own["langs"][b] if k else UNKNOWN for b, k in zip(rates.argmin(axis=1), known, strict=True)]
            extra = [pa.array(names, pa.string()), pa.array(score, pa.float64()), *([pa.array(least - 1 / np.maximum(n, 1), pa.float64(), mask=~known)] if rate else [])]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *extra], names=[*keep, *added])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    return source.mapInArrow(predict, ", ".join([*kinds, f"`{found}` string", f"`{sure}` double", *([f"`{rate}` double"] if rate else [])]))
