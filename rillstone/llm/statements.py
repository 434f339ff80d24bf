"""DuckDB SQL of the queries that SQL can express, by plain definitions: every window, every pair, every count."""

from __future__ import annotations

from rillstone.llm import licenses, mixing

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = f"translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}')"


def _lists(text: str) -> str:
    return f"l AS MATERIALIZED (SELECT doc_id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)"


NGRAM_JACCARD = f"""WITH RECURSIVE {_lists(LOWERED)}, s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM l)
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (SELECT doc_id AS d, doc_id AS r FROM l UNION SELECT d, b FROM reach JOIN links ON a = r)
SELECT l.doc_id, coalesce(n, 0) AS n_shingles, m.component_id
FROM l LEFT JOIN sizes USING (doc_id) JOIN (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY 1) m USING (doc_id)"""

SUBSTRING_DEDUP = f"""WITH {_lists("coalesce(text, '')")}, w AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM l)
), firsts AS (SELECT h, min(doc_id) AS a FROM w GROUP BY h
), gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM w JOIN firsts USING (h) WHERE a < doc_id
), places AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM l
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT l.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM l LEFT JOIN kept USING (doc_id)"""

BACKOFF_SCORES = f"""WITH {_lists(LOWERED)}, places AS MATERIALIZED (
  SELECT doc_id, unnest(ws) AS v, unnest(generate_series(1, len(ws))) AS p FROM l
), pairs AS MATERIALIZED (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY p) AS u FROM places
), c1 AS (SELECT v, count(*) AS n FROM places GROUP BY v), o1 AS (SELECT doc_id, v, count(*) AS n FROM places GROUP BY 1, 2
), c2 AS (SELECT u, v, count(*) AS n FROM pairs GROUP BY 1, 2), o2 AS (SELECT doc_id, u, v, count(*) AS n FROM pairs GROUP BY 1, 2, 3
), rests AS (SELECT doc_id, greatest((SELECT count(*) FROM places) - len(ws), 1) AS rest FROM l
), known AS (
  SELECT x.doc_id, x.u, rest, c1.n - o1.n AS one, c2.n - o2.n AS two, coalesce(d1.n - e1.n, 0) AS before
  FROM pairs x JOIN rests USING (doc_id) JOIN c1 ON c1.v = x.v JOIN o1 ON o1.doc_id = x.doc_id AND o1.v = x.v
  LEFT JOIN c2 ON c2.u = x.u AND c2.v = x.v LEFT JOIN o2 ON o2.doc_id = x.doc_id AND o2.u = x.u AND o2.v = x.v
  LEFT JOIN c1 d1 ON d1.v = x.u LEFT JOIN o1 e1 ON e1.doc_id = x.doc_id AND e1.v = x.u
), scores AS (
  SELECT doc_id, sum(CASE WHEN u IS NULL THEN log10(greatest(one, 0.5::DOUBLE) / rest)
    WHEN two > 0 THEN log10(two / greatest(before, 1)) ELSE log10(greatest(one, 0.5::DOUBLE) / rest) + log10(0.4::DOUBLE) END) AS score
  FROM known GROUP BY doc_id)
SELECT l.doc_id, len(ws) AS n_words, floor(coalesce(score, 0) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS score,
  floor(coalesce(score / len(ws), 0) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS mean_score
FROM l LEFT JOIN scores USING (doc_id)"""



def _checksums(table: str, out: str) -> str:
    """``out(s, h)``: the CRC-32 of each string ``s`` of ``table``. It is linear, so each byte adds what it gives at its place."""
    return f"""crc_step(b, c) AS MATERIALIZED (
  WITH RECURSIVE s(b, c, k) AS (SELECT b, b, 0 FROM range(256) t(b)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM s WHERE k < 8)
  SELECT b, c FROM s WHERE k = 8
), crc_size AS MATERIALIZED (SELECT max(octet_length(encode(s))) AS n FROM {table}
), crc_at(d, b, c) AS MATERIALIZED (
  WITH RECURSIVE s(d, b, c) AS (SELECT 0, b, c FROM crc_step
    UNION ALL SELECT d + 1, s.b, xor(s.c >> 8, t.c) FROM s JOIN crc_step t ON t.b = s.c & 255 WHERE d < (SELECT n FROM crc_size))
  SELECT * FROM s
), crc_none(n, c) AS MATERIALIZED (
  WITH RECURSIVE s(n, c) AS (SELECT 0, 4294967295
    UNION ALL SELECT s.n + 1, xor(s.c >> 8, t.c) FROM s JOIN crc_step t ON t.b = s.c & 255 WHERE s.n < (SELECT n FROM crc_size))
  SELECT n, xor(c, 4294967295) FROM s
), {out} AS MATERIALIZED (
  SELECT s, xor(any_value(z.c), bit_xor(a.c)) AS h
  FROM (SELECT s, n, n - i AS d, ('0x' || substr(x, 2 * i - 1, 2))::BIGINT AS b
    FROM (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n, unnest(generate_series(1, octet_length(encode(s)))) AS i FROM {table}))
  JOIN crc_at a USING (d, b) JOIN crc_none z USING (n) GROUP BY s)"""


SPELLING_VARIANTS = f"""WITH RECURSIVE r AS MATERIALIZED (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL
), {_checksums("r", "hashed")}, v AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
    FROM r JOIN hashed USING (s)) GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2
), cut AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM v)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT cut.word, rest FROM cut JOIN v ON v.word = rest UNION SELECT rest, cut.word FROM cut JOIN v ON v.word = rest
), best AS MATERIALIZED (
  SELECT near.word, count(*) AS n_near, any_value(v.n) AS n, min((-o.n, other)) AS best
  FROM near JOIN v USING (word) JOIN v o ON o.word = other GROUP BY near.word
), forms AS MATERIALIZED (SELECT word, best[2] AS form, -best[1] AS form_n FROM best WHERE -best[1] >= 10 * n
), path AS (SELECT word, form AS root FROM forms UNION ALL SELECT path.word, form FROM path JOIN forms ON forms.word = root
), ends AS (SELECT path.word, root FROM path LEFT JOIN forms ON forms.word = root WHERE form IS NULL)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM v LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)"""


def _scan() -> str:
    """Places of the templates' runs, merged by diagonal, as plain joins on the words themselves."""
    templates = [*licenses.PHRASES, *licenses.NOTICES]
    rows = ", ".join(f"({n}, {n < len(licenses.PHRASES)}, '{t.label}', string_split('{t.words}', ' '), {t.k}, {t.shift}, {t.least}::DOUBLE)" for n, t in enumerate(templates))
    return f"""WITH t(template, base, label, ws, k, shift, least) AS MATERIALIZED (VALUES {rows}
), g AS MATERIALIZED (SELECT *, array_to_string(ws[j + 1 : j + k], ' ') AS gram FROM (SELECT *, unnest(generate_series(0, len(ws) - k)) AS j FROM t)
), l AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), places AS MATERIALIZED (SELECT doc_id, ws, unnest(generate_series(0, len(ws) - 1)) AS i FROM l
), votes AS MATERIALIZED (
  SELECT DISTINCT doc_id, template, base, label, len(g.ws) AS size, g.k, shift, least, i, j, i - j AS diagonal
  FROM (SELECT doc_id, i, k, array_to_string(ws[i + 1 : i + k], ' ') AS gram FROM places, (SELECT DISTINCT k FROM t)) JOIN g USING (gram, k)
), parted AS (
  SELECT *, sum(CASE WHEN diagonal - before <= shift THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal, i) AS span
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, i) AS before FROM votes)
), sizes AS (
  SELECT doc_id, template, span, count(DISTINCT w) AS covered
  FROM (SELECT doc_id, template, span, unnest(generate_series(j, j + k - 1)) AS w FROM parted) GROUP BY ALL
), spans AS (
  SELECT doc_id, template, span, any_value(base) AS base, any_value(label) AS label, min(i) AS f, max(i + k) AS e, any_value(size) AS size,
    any_value(least) AS least FROM parted GROUP BY doc_id, template, span
), judged AS (
  SELECT *, covered / size AS score, covered / size >= least AND e - f <= {licenses.STRETCH} * size AS good FROM spans JOIN sizes USING (doc_id, template, span)
), found AS (
  SELECT doc_id, count(*) FILTER (base AND good) AS n_base, min(f) FILTER (base AND good) AS first_word, max(f) FILTER (base AND good) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base AND good)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label) FILTER (good)), ',') AS labels, max(score) AS score
  FROM judged GROUP BY doc_id)
SELECT l.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM l LEFT JOIN found USING (doc_id)"""


def statements() -> dict[str, str]:
    return {
        "op6_ngram_jaccard": NGRAM_JACCARD,
        "op8_substring_dedup": SUBSTRING_DEDUP,
        "op9_backoff_scores": BACKOFF_SCORES,
        "op10_raked_mixing": mixing.statement(),
        "op11_spelling_variants": SPELLING_VARIANTS,
        "op12_license_diagonals": _scan(),
    }
