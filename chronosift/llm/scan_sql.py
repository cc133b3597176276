"""DuckDB SQL of the lexical search, the licence scan and the vector codes."""

from __future__ import annotations

from .licenses import BASE, LOOKUP, NOTICES, RARE, SHARE, SLACK, rare_tokens, weights
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
n AS (
  SELECT r, doc_id, len(ws) AS n, ws FROM d WHERE len(ws) > 0),
g AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM n) GROUP BY ALL),
q AS (
  SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (r), g GROUP BY ALL),
t AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM t WHERE rank <= 10
"""


def _op12_sql() -> str:
    templates = [(label, 1, x.split(), [x.split()]) for label, x in BASE.items()] + [(label, 0, x.split(), [k.split() for k in keys]) for label, (x, keys) in NOTICES.items()]
    weight = weights([t[2] for t in templates])
    said = lambda rows: ", ".join("(" + ", ".join(str(v) if isinstance(v, int | list) else f"'{v}'" for v in r) + ")" for r in rows)
    notices = [t for t in templates if not t[1]]
    words = said((label, j, w, weight[w], sum(weight[x] for x in ws)) for label, _, ws, _ in notices for j, w in enumerate(ws))
    rare = said((label, o, w) for label, _, ws, _ in notices for o, w in enumerate(rare_tokens(ws, weight, LOOKUP)))
    keys = said((label, i, next(j for j in range(len(ws)) if ws[j : j + len(k)] == k), k[0], k, len(ks)) for label, _, ws, ks in notices for i, k in enumerate(ks))
    phrases = said((label, ws[0], ws) for label, b, ws, _ in templates if b)
    known = ", ".join(f"'{w}'" for w in sorted(weight))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
v AS MATERIALIZED (
  SELECT * FROM (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d) WHERE word IN ({known})),
phrase(label, head, said) AS (VALUES {phrases}),
tok(label, j, word, weight, total) AS (VALUES {words}),
rare(label, ord, word) AS (VALUES {rare}),
keys(label, k, j, head, said, n_keys) AS (VALUES {keys}),
b AS (
  SELECT v.r, label, pos FROM v JOIN phrase ON word = head JOIN d ON d.r = v.r AND ws[pos + 1 : pos + len(said)] = said),
h AS (
  SELECT r, label, word, row_number() OVER (PARTITION BY r, label ORDER BY ord) AS best FROM (SELECT DISTINCT r, label, ord, word FROM v JOIN rare USING (word))),
c AS MATERIALIZED (
  SELECT DISTINCT v.r, h.label, v.pos - j AS spot FROM h JOIN v USING (r, word) JOIN tok ON tok.label = h.label AND tok.word = h.word WHERE best <= {RARE}),
m AS (
  SELECT DISTINCT c.r, c.label, spot, j, weight, total FROM c JOIN tok USING (label) JOIN v ON v.r = c.r AND v.word = tok.word AND abs(v.pos - spot - j) <= {SLACK}),
s AS (
  SELECT r, label, spot, sum(weight)::DOUBLE / total AS share FROM m GROUP BY r, label, spot, total),
y AS (
  SELECT c.r, c.label, spot FROM c JOIN keys USING (label) JOIN v ON v.r = c.r AND v.word = keys.head AND abs(v.pos - spot - j) <= {SLACK}
  JOIN d ON d.r = v.r AND ws[v.pos + 1 : v.pos + len(keys.said)] = keys.said GROUP BY c.r, c.label, spot, n_keys HAVING count(DISTINCT k) = n_keys),
f AS (
  SELECT s.r, s.label, share, y.r IS NOT NULL AND share >= {SHARE} AS sure FROM s LEFT JOIN y USING (r, label, spot)),
bb AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
ff AS (
  SELECT r, max(CASE WHEN sure THEN share ELSE share / 2 END) AS score FROM f GROUP BY r),
ll AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM f WHERE sure) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN bb USING (r) LEFT JOIN ff USING (r) LEFT JOIN ll USING (r)
"""


def _op13_sql() -> str:
    """Rounds written out one after the other, for parts of eight components."""
    far = " + ".join(f"(d.part[{j}] - b.part[{j}]) * (d.part[{j}] - b.part[{j}])" for j in range(1, 9))
    floors = ", ".join(f"(s{j} - ((s{j} % n + n) % n)) // n" for j in range(1, 9))
    sums = ", ".join(f"sum(weight * part[{j}])::BIGINT AS s{j}" for j in range(1, 9))
    assigned = lambda k: f"a{k} AS MATERIALIZED (SELECT d.spot, d.part, weight, min(({far})::HUGEINT * {ENTRIES} + entry) AS best FROM d JOIN b{k} b USING (spot) GROUP BY ALL)"
    steps = "".join(
        f"{assigned(k)},\nm{k} AS (SELECT spot, (best % {ENTRIES})::BIGINT AS entry, sum(weight)::BIGINT AS n, {sums} FROM a{k} GROUP BY ALL),\n"
        f"b{k + 1} AS MATERIALIZED (SELECT b.spot, b.entry, CASE WHEN n IS NULL THEN b.part ELSE [{floors}] END AS part FROM b{k} b LEFT JOIN m{k} USING (spot, entry)),\n"
        for k in range(ROUNDS)
    )
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS rn, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT rn, a AS spot, w[a * 8 + 1 : a * 8 + 8] AS part FROM v, range({PARTS}) r(a)),
b0 AS (
  SELECT spot, rn - 1 AS entry, part FROM p WHERE rn <= {ENTRIES}),
d AS MATERIALIZED (
  SELECT spot, part, count(*) AS weight FROM p GROUP BY ALL),
{steps}{assigned(ROUNDS)},
e AS (
  SELECT rn, string_agg(printf('%02x', (best % {ENTRIES})::INTEGER), '' ORDER BY spot) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM p JOIN a{ROUNDS} USING (spot, part) GROUP BY rn),
h AS (
  SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY spot, entry, j)) AS codebooks_sha256 FROM (SELECT spot, entry, unnest(part) AS c, unnest(range(len(part))) AS j FROM b{ROUNDS}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN e USING (rn), h
"""


OP12_SQL = _op12_sql()
OP13_SQL = _op13_sql()
