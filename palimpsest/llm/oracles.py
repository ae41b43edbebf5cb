"""SQL that must give the same rows as the queries, where SQL can express them."""

from palimpsest.llm import decontaminate, orchard, secretscan

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""

LINES = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""

RUNS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM w WHERE len(words) >= 20),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(words[pos:pos + 19], ' ') ORDER BY doc_id, pos) AS n FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r WHERE n > 1),
a AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
k AS (SELECT a.doc_id, count(*) AS n_words, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY a.pos) FILTER (WHERE g.pos IS NULL) AS kept
      FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

QUOTES = r"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER () AS rid FROM conversations),
m AS (SELECT DISTINCT conv_id, turn, coalesce(text, '') AS text FROM conversations),
ml AS (SELECT *, hash(text) AS h, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM m),
mk AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]*)+)', 1), '[^>]', '', 'g')) AS level,
  regexp_replace(line, '^[ \t]*((?:>[ \t]*)+)', '') AS body FROM ml),
k AS (SELECT *, nullif(trim(regexp_replace(lower(body), '\s+', ' ', 'g')), '') AS key, lag(level) OVER (PARTITION BY conv_id, turn, h ORDER BY pos) AS prev FROM mk),
s AS (SELECT conv_id, key, min(turn) AS source FROM k WHERE level = 0 AND key IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
p AS (SELECT *, sum(CASE WHEN prev IS NULL OR level <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, h ORDER BY pos) AS passage FROM k WHERE turn IS NOT NULL),
n AS (SELECT conv_id, turn, count(*) AS n_quotes FROM (SELECT DISTINCT conv_id, turn, h, passage FROM p WHERE level > 0) GROUP BY ALL),
v AS (SELECT p.conv_id, p.turn, h, passage, level, source, count(*) AS n FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.key = s.key AND s.source < p.turn
  WHERE level > 0 GROUP BY ALL),
l AS (SELECT conv_id, turn, h, passage, level, arg_max(source, (n, source)) AS source FROM v GROUP BY ALL),
a AS (SELECT conv_id, turn, count(*) AS n_linked, arg_min(source, (level, -source)) AS reply_to FROM l GROUP BY ALL),
w AS (SELECT conv_id, turn, reply_to AS up, CAST(turn AS VARCHAR) AS path FROM a
  UNION ALL SELECT w.conv_id, w.turn, a.reply_to, w.up || '/' || w.path FROM w LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.turn = w.up WHERE w.up IS NOT NULL),
x AS (SELECT conv_id, turn, text, max(level) AS quote_level,
  regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE level = 0), ''), '^(?:[ \t]*\n)+|(?:\n[ \t]*)+\z', '', 'g') AS body FROM mk GROUP BY ALL)
SELECT c.conv_id, c.turn, c.role, x.body AS text, x.quote_level, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, a.reply_to,
  coalesce(w.path, CAST(c.turn AS VARCHAR), '') AS reply_path
FROM c JOIN x ON c.conv_id IS NOT DISTINCT FROM x.conv_id AND c.turn IS NOT DISTINCT FROM x.turn AND coalesce(c.text, '') = x.text
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id AND n.turn = c.turn
LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id AND a.turn = c.turn
LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.turn = c.turn AND w.up IS NULL
"""


def _template(text: str) -> str:
    units = "|".join(decontaminate.UNIT_WORDS)
    t = rf"regexp_replace({text}, '\p{{Lu}}\p{{L}}*', 'P', 'g')"
    t = rf"regexp_replace({t}, '\p{{Nd}}[\p{{Nd}}.,]*', ' N ', 'g')"
    t = rf"regexp_replace({t}, '[{decontaminate.UNIT_SIGNS}]', ' U ', 'g')"
    t = rf"regexp_replace({t}, 'N +(?:{units})([^\p{{L}}]|$)', 'N U\1', 'g')"
    return rf"list_filter(string_split_regex({t}, '[^\p{{L}}]+'), lambda x: x <> '')"


def contaminated() -> str:
    n, short = decontaminate.LENGTH, decontaminate.SHORTEST
    words = f"regexp_extract_all(text, '{decontaminate.WORD}')"
    return f"""
WITH i AS (
  SELECT item_id, {_template("text")} AS t, {words} AS o FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
il AS (SELECT *, least(len(t), {n}) AS n FROM i WHERE len(t) >= {short}),
iw AS (SELECT item_id, t, o, n, unnest(range(0, len(t) - n + 1)) AS j, len(t) - n + 1 AS n_windows FROM il),
ik AS (SELECT *, array_to_string(t[j + 1:j + n], ' ') AS k FROM iw),
d AS (SELECT doc_id, hash(text) AS h, {_template("text")} AS t, {words} AS o FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, h, t, o, n, unnest(range(0, len(t) - n + 1)) AS pos FROM d, (SELECT DISTINCT n FROM il) WHERE len(t) >= n),
m AS (SELECT doc_id, h, item_id, n_windows, j, pos - j AS off, ik.n, ik.t AS t, ik.o AS io, dw.o AS d_o
      FROM dw JOIN ik ON ik.n = dw.n AND ik.k = array_to_string(dw.t[pos + 1:pos + dw.n], ' ')),
g AS (SELECT doc_id, h, item_id, count(DISTINCT j) AS n_matched, max(n_windows) AS n_windows FROM m GROUP BY ALL
      HAVING count(DISTINCT j) >= {decontaminate.SHARE} * max(n_windows)),
po AS (SELECT doc_id, h, item_id, off, count(DISTINCT j) AS c FROM m GROUP BY ALL),
p AS (SELECT doc_id, h, item_id, arg_min(off, (-c, off)) AS off FROM po GROUP BY ALL),
s0 AS (SELECT DISTINCT doc_id, h, item_id, off, p, t[p + 1] AS kind, io[p + 1] AS iv, d_o[off + p + 1] AS dv
       FROM (SELECT *, unnest(range(j, j + n)) AS p FROM m)),
s AS (SELECT doc_id, h, item_id, off, kind, iv, dv, count(*) AS c FROM s0 WHERE kind IN ('P', 'N', 'U') GROUP BY ALL),
f1 AS (SELECT doc_id, h, item_id, off, kind, iv, max(c) AS k, sum(c) AS a FROM s GROUP BY ALL),
b1 AS (SELECT doc_id, h, item_id, off, kind, dv, max(c) AS k, sum(c) AS a FROM s GROUP BY ALL),
f AS (SELECT doc_id, h, item_id, off, sum(k) / sum(a) AS r FROM f1 GROUP BY ALL),
b AS (SELECT doc_id, h, item_id, off, sum(k) / sum(a) AS r FROM b1 GROUP BY ALL),
v AS (SELECT doc_id, h, item_id, off, bool_and(iv = dv) AS same FROM s GROUP BY ALL)
SELECT g.doc_id, g.item_id, g.n_matched, CAST(g.n_windows AS BIGINT) AS n_windows, g.n_matched / g.n_windows AS share,
       least(coalesce(f.r, 1.0), coalesce(b.r, 1.0)) AS agreement, coalesce(v.same, true) AS verbatim
FROM g JOIN p ON g.doc_id = p.doc_id AND g.h = p.h AND g.item_id = p.item_id
LEFT JOIN f ON g.doc_id = f.doc_id AND g.h = f.h AND g.item_id = f.item_id AND p.off = f.off
LEFT JOIN b ON g.doc_id = b.doc_id AND g.h = b.h AND g.item_id = b.item_id AND p.off = b.off
LEFT JOIN v ON g.doc_id = v.doc_id AND g.h = v.h AND g.item_id = v.item_id AND p.off = v.off
WHERE least(coalesce(f.r, 1.0), coalesce(b.r, 1.0)) > {decontaminate.AGREEMENT}
"""


def _matched(name: str, pattern: str) -> str:
    """A query of (rid, s, e, found): the matches of a pattern in t(rid, text)."""
    pattern = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT rid, found[i] AS found, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(found[1:i], lambda x: length(x))) AS BIGINT) AS e
  FROM (SELECT rid, found, gaps, unnest(range(1, len(found) + 1)) AS i
        FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps FROM t)))"""


def secrets() -> str:
    q = secretscan
    value = f"{q.HEAD}({q.VALUE}+)".replace("'", "''")
    base = f"{q.ASSIGN}|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}".replace("'", "''")
    few = f"len(list_distinct(string_split(value, ''))) < {q.DIFFERENT}"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
{_matched("m0", q.ASSIGN)},
{_matched("m1", "AKIA[A-Z0-9]+")},
{_matched("m2", "[0-9a-f]+")},
{_matched("m3", q.APART)},
b AS (SELECT rid, s, 0 AS kind, e, regexp_extract(found, '{value}', 1) AS value FROM m0 WHERE length(regexp_extract(found, '{value}', 1)) >= {q.ASSIGNED}
  UNION ALL SELECT rid, s, 1, e, found FROM m1 WHERE length(found) >= 20
  UNION ALL SELECT rid, s, 2, e, found FROM m2 WHERE length(found) >= 24),
o AS (SELECT rid, s, CASE WHEN regexp_matches(found, '[A-Z]') AND regexp_matches(found, '[a-z]') AND length(found) >= 20 THEN 4 ELSE 3 END AS kind, e, found AS value
  FROM m3 WHERE NOT regexp_matches(found, '{base}') AND regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Za-z]')
  AND len(list_distinct(string_split(found, ''))) >= {q.DIFFERENT}),
a AS (SELECT * FROM b UNION ALL SELECT * FROM o),
c AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (coalesce(source, chr(0)), coalesce(doc_id, -1))) AS repos, bool_or(kind = 0) AS named
  FROM a JOIN t USING (rid) GROUP BY value),
j AS (SELECT a.*, named, NOT (owners > {q.OWNERS} OR (owners > 1 AND repos > {q.REPOSITORIES})) AND NOT {few} AS live FROM a JOIN c USING (value)),
k AS (SELECT *, kind < 3 OR (live AND (kind = 4 OR named)) AS span, ['assign', 'access', 'hex', 'copy', 'opaque'][kind + 1] || ':' || s || ':' || e AS name FROM j),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(name, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(name, ',' ORDER BY s, kind) FILTER (WHERE span) AS spans,
  count(*) FILTER (WHERE span AND live) AS n_live, count(*) FILTER (WHERE kind < 3 AND NOT live) AS n_example FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN g USING (rid)
"""


def codes() -> str:
    q = orchard
    distance = "list_sum(list_transform(list_zip(x.piece, b.piece), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({q.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, p, e[p * len(e) // {q.PARTS} + 1:(p + 1) * len(e) // {q.PARTS}] AS piece FROM v, range({q.PARTS}) t(p)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS FIRST, e) - 1 AS i FROM v QUALIFY i < {q.ENTRIES}),
b0 AS (SELECT p, i, piece FROM f JOIN x USING (r))"""]
    for n in range(q.ROUNDS + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, x.p, min({{'d': {distance}, 'i': i}}) AS best FROM x JOIN b{n} b ON x.p = b.p GROUP BY ALL)""")
        if n < q.ROUNDS:
            parts.append(f"""s{n} AS (SELECT p, best.i AS i, pos, CAST(floor(sum(piece[pos]) / count(*)) AS BIGINT) AS c
  FROM (SELECT *, unnest(range(1, len(piece) + 1)) AS pos FROM a{n} JOIN x USING (r, p)) GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(m.piece, b.piece) AS piece FROM b{n} b LEFT JOIN (SELECT p, i, list(c ORDER BY pos) AS piece FROM s{n} GROUP BY ALL) m ON m.p = b.p AND m.i = b.i)""")
    return ",\n".join(parts) + f""",
c AS (SELECT r, string_agg(printf('%02x', best.i), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{q.ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(piece, ','), ',' ORDER BY p, i)) FROM b{q.ROUNDS}) AS codebooks_sha256
FROM c JOIN v USING (r)
"""


ORACLES: dict[str, str] = {
    "op4_decontaminate": contaminated(),
    "op5_topk": TOP_K,
    "op7_lines": LINES,
    "op8_quotes": QUOTES,
    "op9_substrings": RUNS,
    "op11_secrets": secrets(),
    "op13_orchard": codes(),
}
