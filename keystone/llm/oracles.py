"""DuckDB formulations of the operators that SQL can express, from their definitions (all pairs, all windows)."""

from __future__ import annotations

import string

WORDS = r"'[^\x20\x09-\x0D]+'"
#: Components: all rows that links reach from each row.
REACH = """reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
{REACH},
found AS (SELECT a, MIN(vec_id) AS least FROM reach JOIN v ON v.r = reach.b GROUP BY a),
degree AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT vec_id, COALESCE(n, 0) AS n_links, LEAST(vec_id, COALESCE(least, vec_id)) AS component_id, vec_id = component_id AS kept
FROM v LEFT JOIN found ON found.a = v.r LEFT JOIN degree ON degree.a = v.r"""


def join_sql(words: int, percent: int) -> str:
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(COALESCE(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), {WORDS}) AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END) AS g FROM d),
u AS (SELECT r, unnest(g) AS g FROM s),
common AS (SELECT x.r AS a, y.r AS b, COUNT(*) AS c FROM u x JOIN u y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN s sa ON sa.r = a JOIN s sb ON sb.r = b WHERE 100 * c >= {percent} * (len(sa.g) + len(sb.g) - c)),
{REACH},
found AS (SELECT a, MIN(doc_id) AS least FROM reach JOIN s ON s.r = reach.b GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, LEAST(doc_id, COALESCE(least, doc_id)) AS component_id
FROM s LEFT JOIN found ON found.a = s.r"""


def windows_sql(window: int) -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(COALESCE(text, ''), {WORDS}) AS w FROM documents),
starts AS (SELECT r, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS h FROM d, unnest(range(1, len(w) - {window} + 2)) t(i)),
hit AS (SELECT r, i FROM starts QUALIFY COUNT(*) OVER (PARTITION BY h) > 1),
words AS (SELECT r, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) t(i)),
marked AS (SELECT r, i, word, MAX(CAST(hit.i IS NOT NULL AS INT)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN hit USING (r, i)),
kept AS (SELECT r, SUM(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


def _matches(kind: int, pattern: str, keep: str) -> str:
    """(r, doc_id, owner, kind, begins, value, ends) of the matches: text between matches and matches alternate."""
    return f"""SELECT r, doc_id, owner, {kind} AS kind, begins, m AS value, begins + length(m) AS ends FROM (
  SELECT r, doc_id, owner, unnest(list_transform(range(1, len(ms) + 1), lambda i: struct_pack(m := ms[i],
    begins := CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT))),
    recursive := true)
  FROM (SELECT r, doc_id, owner, regexp_extract_all(t, $${pattern}$$) AS ms, string_split_regex(t, $${pattern}$$) AS gaps FROM d)) WHERE {keep}"""


def secrets_sql() -> str:
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    assign = rf"""(?:{names})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
    value = rf"""^(?:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    generic = "^[A-Za-z0-9+/_-]{20,}={0,2}"
    listed = "string_agg(concat(['assign', 'access', 'hex', 'live'][kind + 1], ':', begins, ':', ends), ',' ORDER BY begins, kind)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(source, '') AS owner, COALESCE(text, '') AS t FROM documents),
base AS ({_matches(0, assign, f"length(regexp_extract(m, $${value}$$, 1)) >= 6")}
 UNION ALL {_matches(1, "AKIA[A-Z0-9]+", "length(m) >= 20")}
 UNION ALL {_matches(2, "[0-9a-f]{24,}", "true")}),
runs AS ({_matches(3, "[A-Za-z0-9+/_=-]+", f"regexp_matches(m, $${generic}$$) AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')")}),
generic AS (SELECT r, doc_id, owner, kind, begins, regexp_extract(value, $${generic}$$) AS value, begins + length(regexp_extract(value, $${generic}$$)) AS ends FROM runs),
apart AS (SELECT * FROM generic g WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = g.r AND b.begins < g.ends AND g.begins < b.ends)),
owners AS (SELECT value, COUNT(DISTINCT owner) AS n, COUNT(DISTINCT (owner, doc_id)) AS documents FROM apart GROUP BY value),
judged AS (SELECT apart.*, NOT (n > 1 AND documents >= 3 OR documents > 1000) AS live FROM apart JOIN owners USING (value)),
every AS (SELECT r, kind, begins, ends FROM base UNION ALL SELECT r, kind, begins, ends FROM judged WHERE live),
sums AS (SELECT r, COUNT(*) FILTER (kind = 0) AS n_assign, COUNT(*) FILTER (kind = 1) AS n_access, COUNT(*) FILTER (kind = 2) AS n_hex,
  COUNT(*) FILTER (kind = 3) AS n_live, {listed.replace("ORDER BY begins, kind)", "ORDER BY begins, kind) FILTER (kind < 3)")} AS b, {listed} AS spans FROM every GROUP BY r),
left_out AS (SELECT r, COUNT(*) AS n FROM judged WHERE NOT live GROUP BY r)
SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex,
 sha256(COALESCE(b, '')) AS base_sha256, COALESCE(spans, '') AS spans, COALESCE(n_live, 0) AS n_live, COALESCE(left_out.n, 0) AS n_example
FROM d LEFT JOIN sums USING (r) LEFT JOIN left_out USING (r)"""


NEGATIVES = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS alike, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
p AS (SELECT ar, anchor_id, br AS pr, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id NULLS LAST, br) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.id NULLS LAST, s.br) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

COPIES = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(COALESCE(text, '')) AS chars,
  regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, COUNT(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w = 1 AS kept,
  sha256(bare) AS text_sha256 FROM d WINDOW w AS (PARTITION BY bare ORDER BY chars DESC, doc_id NULLS LAST, r)"""


def spelling_sql(divisor: int) -> str:
    """The checksum by its definition, a letter's UTF-8 bytes at a time; near words share a word with one letter masked or left out."""
    shifts = "list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, o: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return rf"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: {shifts}) AS crc),
runs AS (SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT id, run, COUNT(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), 128 + (unicode(c) & 63)] END))),
  lambda c, b: xor(c >> 8, t.crc[xor(c & 255, b) + 1])), 4294967295) AS h FROM counted, t),
words AS (SELECT CASE WHEN h % {divisor} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(SUM(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND SUM(n) >= 3),
masked AS (SELECT word, n, word[:i - 1] || '*' || word[i + 1:] AS shape, word[:i - 1] || word[i + 1:] AS less FROM words, unnest(range(1, length(word) + 1)) u(i)),
near AS (SELECT a.word, b.word AS other FROM masked a JOIN masked b ON a.shape = b.shape AND a.word <> b.word
 UNION SELECT m.word, w.word FROM masked m JOIN words w ON w.word = m.less UNION SELECT w.word, m.word FROM masked m JOIN words w ON w.word = m.less),
best AS (SELECT near.word, other, w.n AS other_n, COUNT(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN words w ON w.word = other
  QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) = 1),
formed AS (SELECT words.word, words.n, COALESCE(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * words.n THEN other END AS form,
  CASE WHEN other_n >= 2 * words.n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
path AS (SELECT word, word AS at FROM formed UNION ALL SELECT path.word, f.form FROM path JOIN formed f ON f.word = path.at WHERE f.form IS NOT NULL),
roots AS (SELECT path.word, path.at AS root FROM path JOIN formed f ON f.word = path.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": VECTORS,
        "op3_secret_scan": secrets_sql(),
        "op5_ngram_jaccard_join": join_sql(3, 90),
        "op7_substring_dedup": windows_sql(35),
        "op11_hard_negatives": NEGATIVES,
        "op12_exact_dedup": COPIES,
        "op13_spelling_variants": spelling_sql(97),
    }
