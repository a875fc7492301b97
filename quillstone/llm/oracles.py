"""DuckDB SQL of the queries that SQL can express: plain statements of the same results, without the operators' methods.

The others go through tokenisation, fitted models or hashes that SQL has no words for; their tests hold them against
brute force over whole tables.
"""

from __future__ import annotations

from math import ceil

from quillstone.llm import licenses, merkle, mixing, phrases, repeats

#: Documents whose windows of words start anywhere but at their first place in the corpus lose the words of those windows.
REPEATS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT doc_id, start, array_to_string(words[start + 1 : start + {repeats.WINDOW}], ' ') AS said
  FROM d, unnest(range(len(words) - {repeats.WINDOW - 1})) AS r(start)
),
ranked AS (SELECT doc_id, start, row_number() OVER (PARTITION BY said ORDER BY doc_id, start) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, start + i AS place FROM ranked, unnest(range({repeats.WINDOW})) AS r(i) WHERE nth > 1),
each AS (SELECT doc_id, words[place + 1] AS word, place FROM d, unnest(range(len(words))) AS r(place)),
left_over AS (
  SELECT each.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY each.place) AS kept
  FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.place = gone.place GROUP BY each.doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""


def _licenses() -> str:
    named = [(k, label, sorted(set(licenses.tokens(text))), licenses.block_of(text) // 2) for k, (label, text) in enumerate(licenses.TEMPLATES)]
    wanted = ", ".join(f"({k}, '{label}', '{w}', {half}, {len(ws)}, {ceil(licenses.CONTAINED * len(ws) - 1e-9)})" for k, label, ws, half in named for w in ws)
    phrases = ", ".join(f"('{label}', {p.split()!r})" for p, label in licenses.PHRASES.items())
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
phrases(label, said) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, label, place FROM d, unnest(range(len(words))) AS r(place), phrases
  WHERE words[place + 1] = said[1] AND words[place + 1 : place + len(said)] = said
),
base AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
wanted(template, label, word, half, size, need) AS (VALUES {wanted}),
held AS (
  SELECT DISTINCT doc_id, half, place // half - back AS block, words[place + 1] AS word
  FROM d, unnest(range(len(words))) AS r(place), (SELECT DISTINCT half, word FROM wanted) h, unnest([0, 1]) AS b(back)
  WHERE place // half >= back AND words[place + 1] = h.word
),
met AS (SELECT doc_id, label, count(*) / any_value(size) AS containment FROM held JOIN wanted USING (half, word) GROUP BY doc_id, half, block, template, label HAVING count(*) >= any_value(need)),
best AS (SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS containment FROM met GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
"""


#: Copies by the inverted distribution function at a uniform number of the document, summed over the parts of large means.
MIXING = f"""
WITH RECURSIVE mass AS (SELECT source, sum(length(coalesce(text, ''))) AS mass FROM documents GROUP BY source),
rates AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*) FILTER (mass > 0) FROM mass)::DOUBLE * (SELECT sum(mass) FROM mass)::DOUBLE / mass::DOUBLE AS rate
  FROM mass WHERE mass > 0
),
rated AS (SELECT d.*, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS own, rate, ceil(rate / {mixing.PART})::INT AS parts FROM documents d JOIN rates ON d.source IS NOT DISTINCT FROM rates.source),
drawn AS (
  SELECT own, source, j, rate / parts AS mean,
    ('0x' || md5('{mixing.SEED}:' || own || CASE WHEN rate > {mixing.PART} THEN ':' || j ELSE '' END)[1:13])::BIGINT::DOUBLE / {2**52}.0::DOUBLE AS u
  FROM (SELECT DISTINCT own, source, rate, parts FROM rated), unnest(range(1, parts + 1)) AS r(j)
),
steps AS (
  SELECT own, source, j, mean, u, exp(-mean) AS p, exp(-mean) AS below, 0 AS k FROM drawn
  UNION ALL
  SELECT own, source, j, mean, u, p * mean / (k + 1), below + p * mean / (k + 1), k + 1 FROM steps WHERE u >= below AND k < ceil(mean + 12 * sqrt(mean) + 24)
),
copies AS (SELECT own, source, sum(k) AS n FROM (SELECT own, source, j, max(k) AS k FROM steps GROUP BY own, source, j) GROUP BY own, source)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, copy::INT AS copy, md5('order{mixing.SEED}:' || d.own || ':' || copy) AS mix_key
FROM rated d JOIN copies c ON d.own = c.own AND d.source IS NOT DISTINCT FROM c.source, unnest(range(1, n::BIGINT + 1)) AS r(copy)
"""


#: All runs of one to four words of the pieces are counted as they are, and the sub-phrases of a phrase are looked up.
PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{phrases.NO_LANGUAGE}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, w[place : place + size - 1] AS p FROM words, unnest(range(1, len(w) + 1)) AS a(place), unnest(range(1, {phrases.LONGEST + 1})) AS s(size) WHERE place + size - 1 <= len(w)),
counted AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM runs GROUP BY lang, p),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE len(p) = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT lang, p, f AS a FROM counted WHERE len(p) > 1 AND f >= {phrases.LEAST}),
absorbed AS (
  SELECT DISTINCT c.lang, c.p FROM (SELECT lang, a, unnest(range(1, len(p) - size + 2)) AS place, size, p FROM frequent, unnest(range(2, {phrases.LONGEST})) AS s(size) WHERE size < len(p)) x
  JOIN frequent c ON c.lang = x.lang AND c.p = x.p[x.place : x.place + x.size - 1] WHERE 100::HUGEINT * x.a >= {phrases.ABSORBED}::HUGEINT * c.a
),
cuts AS (
  SELECT q.lang, q.p, q.a, k, l.f AS l, r.f AS r, ({phrases.SCALE}::HUGEINT * q.a) // (l.f + r.f) AS score
  FROM (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM frequent f ANTI JOIN absorbed USING (lang, p)) q
  JOIN counted l ON l.lang = q.lang AND l.p = q.p[1 : k] JOIN counted r ON r.lang = q.lang AND r.p = q.p[k + 1 :]
),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= {phrases.TOP}
"""


def _crc_table() -> list[int]:
    """The remainders of all bytes by the reversed polynomial of CRC-32."""
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


def _merkle(levels: int) -> str:
    """Both trees level by level, and every leaf's siblings and fold along its way up; enough levels for any table here."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda a, b: xor(a >> 8, {_crc_table()}[(xor(a, b) & 255) + 1]::BIGINT))"
    parts = [
        rf"""WITH rows AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS forged FROM documents),
placed AS MATERIALIZED (
  SELECT doc_id, leaf, coalesce(forged, leaf) AS value, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM rows
),
s0 AS MATERIALIZED (SELECT g, pos, n, leaf AS node FROM placed),
f0 AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, leaf, g, pos, value, '' AS path FROM placed)"""
    ]

    def climb(tree: str, asking: str, k: int) -> str:
        return f""",
{tree}{k} AS MATERIALIZED (
  SELECT g, pos // {merkle.FAN} AS pos, CASE WHEN any_value(n) = 1 THEN 1 ELSE (any_value(n) + {merkle.FAN - 1}) // {merkle.FAN} END AS n,
    CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node FROM {tree}{k - 1} GROUP BY g, pos // {merkle.FAN}
),
{asking}{k} AS MATERIALIZED (
  SELECT a.id, a.doc_id, a.leaf, a.g, a.pos // {merkle.FAN} AS pos, CASE WHEN any_value(t.n) = 1 THEN any_value(a.value) ELSE sha256(string_agg(CASE WHEN t.pos = a.pos THEN a.value ELSE t.node END, '' ORDER BY t.pos)) END AS value,
    any_value(a.path) || coalesce(string_agg(CASE WHEN t.pos <> a.pos THEN t.node END, '' ORDER BY t.pos), '') AS path
  FROM {asking}{k - 1} a JOIN {tree}{k - 1} t ON t.g = {"a.g" if tree == "s" else "0"} AND t.pos // {merkle.FAN} = a.pos // {merkle.FAN} GROUP BY a.id, a.doc_id, a.leaf, a.g, a.pos // {merkle.FAN}, a.pos
)"""

    parts += [climb("s", "f", k) for k in range(1, levels + 1)]
    parts.append(f""",
t0 AS MATERIALIZED (SELECT 0 AS g, g AS pos, (SELECT count(*) FROM s{levels}) AS n, node FROM s{levels}),
u0 AS MATERIALIZED (SELECT id, doc_id, leaf, g, g AS pos, value, path FROM f{levels})""")
    parts += [climb("t", "u", k) for k in range(1, levels + 1)]
    parts.append(f"""
SELECT doc_id, leaf, s{levels}.node AS subroot, t{levels}.node AS root, sha256(path) AS proof_sha256, value AS folded_root, value = t{levels}.node AS verified
FROM u{levels} u JOIN s{levels} ON s{levels}.g = u.g, t{levels}
""")
    return "".join(parts)


ORACLES: dict[str, str] = {"op1_repeats": REPEATS, "op5_licenses": _licenses(), "op10_mixing": MIXING, "op11_phrases": PHRASES, "op13_manifest": _merkle(12)}
