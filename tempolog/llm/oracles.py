"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from tempolog.llm.license_scan import CONTAINMENT, PHRASES, TEMPLATES, words_of
from tempolog.llm.merkle import FANOUT, TAMPERED

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


def _license_scan() -> str:
    phrases = ", ".join(f"({[w.decode() for w in words_of(p.encode())]}, '{x}')" for p, x in PHRASES.items())
    templates = ", ".join(f"({sorted({w.decode() for w in words_of(t.encode())})}, '{x}')" for t, x in TEMPLATES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, {_WORDS.format('text')} AS words FROM d),
phrase(p, label) AS (VALUES {phrases}),
template(t, label) AS (VALUES {templates}),
hits AS (
  SELECT r, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1:i + len(p)] = p)) AS place FROM w, phrase),
base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY r),
lines AS (
  SELECT r, list_distinct({_WORDS.format('line')}) AS block FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
held AS (
  SELECT r, label, len(list_intersect(t, block)) / len(t) AS share FROM lines, template
  WHERE len(list_intersect(t, block)) >= ceil({CONTAINMENT} * len(t) - 1e-9)),
labelled AS (SELECT DISTINCT r, label FROM hits UNION SELECT DISTINCT r, label FROM held),
named AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM labelled GROUP BY r),
best AS (SELECT r, max(share) AS share FROM held GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS DOUBLE) AS first_word, CAST(last_word AS DOUBLE) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)
"""


# CRC-32 of a text as an unsigned number: its table by eight shifts of each byte, then one step per byte.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen({0})), "
        "lambda i: CAST('0x' || substr(hex({0}), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])))")


def _merkle(levels: int = 8) -> str:
    """Trees of at most ``FANOUT ** levels`` rows a source, and as many sources."""
    field = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    ahead = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    steps = []
    for tree in ("s", "t"):
        for k in range(levels):
            steps.append(f"""{tree}{k + 1} AS (
  SELECT tree, idx // {FANOUT} AS idx, CAST(ceil(any_value(n) / {FANOUT}) AS BIGINT) AS n,
         CASE WHEN any_value(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {tree}{k} GROUP BY tree, idx // {FANOUT}),
{tree}p{k} AS (
  SELECT a.tree, a.idx, any_value(a.n) > 1 AS real, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {tree}{k} a JOIN {tree}{k} b ON a.tree = b.tree AND a.idx // {FANOUT} = b.idx // {FANOUT} GROUP BY a.tree, a.idx)""")
        if tree == "s":
            steps.append(f"""t0 AS (
  SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, h, tree AS source FROM s{levels})""")
    joins, proof = [], []
    for tree, place in (("s", "p.idx"), ("t", "t0.idx")):
        key = "p.tree" if tree == "s" else "0"
        for k in range(levels):
            x = f"{tree}x{k}"
            joins.append(f"JOIN {tree}p{k} {x} ON {x}.tree = {key} AND {x}.idx = {place} // {FANOUT ** k}")
            proof.append(f"CASE WHEN {x}.real THEN {x}.l || {x}.r ELSE '' END")
    hashes, before = [], "f"
    for i, (tree, k) in enumerate((t, k) for t in "st" for k in range(levels)):
        x = f"{tree}x{k}"
        hashes.append(f"CASE WHEN {x}_real THEN sha256({x}_l || {before} || {x}_r) ELSE {before} END AS f{i}")
        before = f"f{i}"
    fields = ", ".join(f"{t}x{k}.real AS {t}x{k}_real, {t}x{k}.l AS {t}x{k}_l, {t}x{k}.r AS {t}x{k}_r" for t in "st" for k in range(levels))
    chain = ",\n".join(f"c{i + 1} AS (SELECT *, {h} FROM c{i})" for i, h in enumerate(hashes))
    return f"""
WITH {_CRC_TABLE},
d AS (
  SELECT coalesce('+' || source, '') AS tree, doc_id, sha256({ahead} || {field.format('text')}) AS leaf,
         CASE WHEN {_CRC.format('CAST(doc_id AS VARCHAR)')} % {TAMPERED} = 0
              THEN sha256({ahead} || {field.format(_LOWER.format('text'))}) END AS changed FROM documents, crc_table),
p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
s0 AS (SELECT tree, idx, n, leaf AS h FROM p),
{",\n".join(steps)},
c0 AS (
  SELECT p.doc_id, p.leaf, t0.h AS subroot, t{levels}.h AS root, sha256({" || ".join(proof)}) AS proof_sha256, coalesce(p.changed, p.leaf) AS f, {fields}
  FROM p JOIN t0 ON t0.source = p.tree CROSS JOIN t{levels} {" ".join(joins)}),
{chain}
SELECT doc_id, leaf, subroot, root, proof_sha256, {before} AS folded_root, {before} = root AS verified FROM c{len(hashes)}
"""


_SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
marked AS (
  SELECT run, n, {_CRC.format("concat(doc_id, ':', run)")} AS h FROM runs, crc_table),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM marked)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (
  SELECT word, n, i, left(word, i) AS ahead, substr(word, i + 2) AS behind FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.i = b.i AND a.ahead = b.ahead AND a.behind = b.behind AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.ahead || h.behind
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.ahead || h.behind),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
named AS (
  SELECT word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
led(word, root, step) AS (
  SELECT word, word, 0 FROM named
  UNION ALL SELECT led.word, named.form, step + 1 FROM led JOIN named ON led.root = named.word WHERE named.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM led GROUP BY word)
SELECT word, form, root, n, n_near, CAST(form_n AS DOUBLE) AS form_n FROM named JOIN ends USING (word)
"""


ORACLES = {
    "op12_spelling_variants": _SPELLING,
    "op11_merkle_manifest": _merkle(),
    "op1_license_scan": _license_scan(),
    "op5_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT r, doc_id, place, md5(array_to_string(words[place + 1:place + 50], ' ')) AS h
  FROM (SELECT r, doc_id, words, unnest(range(len(words) - 49)) AS place FROM d WHERE len(words) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
cut AS (
  SELECT r, list(place) AS places FROM windows JOIN firsts USING (h) WHERE first < doc_id GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(place, place + 50)) AS i FROM (SELECT r, unnest(places) AS place FROM cut)),
cuts AS (SELECT r, list(i) AS gone FROM gone GROUP BY r),
kept AS (
  SELECT d.r, array_to_string(list_transform(list_filter(range(len(words)), lambda i: NOT list_contains(gone, i)), lambda i: words[i + 1]), ' ') AS text
  FROM d JOIN cuts USING (r))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, array_to_string(words, ' '))) AS kept_sha256
FROM d LEFT JOIN cuts USING (r) LEFT JOIN kept USING (r)
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
owners AS (SELECT payload_digest, min(page_id) AS owner FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > owner THEN 'revisit' ELSE 'response' END AS record_type,
       CAST(CASE WHEN page_id > owner THEN owner END AS DOUBLE) AS refers_to
FROM p LEFT JOIN owners USING (payload_digest)
""",
    "op4_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
