"""SQL of the corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

from . import decontam
from .common import LOWER, UPPER

_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{_SPACE}'), lambda x: x <> '')"


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

COMPONENTS = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("text")} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM w
),
n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id, MIN(c) AS c FROM r GROUP BY 1) m ON m.id = w.doc_id
"""

LINES = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT doc_id, unnest(range(len(ls))) AS line, ls FROM d WHERE text IS NOT NULL),
t AS (SELECT doc_id, line, list_sort(list_distinct({_words("ls[line + 1]")})) AS s FROM u),
lines AS (SELECT * FROM t WHERE len(s) > 0),
items AS (SELECT s, len(s) AS n, MIN({{'d': doc_id, 'l': line}}) AS born FROM lines GROUP BY s),
tok AS (SELECT s, n, born, unnest(s) AS w FROM items),
df AS (SELECT w, COUNT(*) AS f FROM tok GROUP BY 1),
ranked AS (SELECT tok.*, row_number() OVER (PARTITION BY born ORDER BY f, w) AS pos FROM tok JOIN df USING (w)),
prefix AS (SELECT * FROM ranked WHERE pos <= n - (80 * n + 99) // 100 + 1),
cand AS (
  SELECT DISTINCT x.born AS born, x.s AS s, x.n AS n, y.s AS t, y.n AS m FROM prefix x JOIN prefix y ON x.w = y.w
  WHERE y.born < x.born AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
),
resembling AS (SELECT DISTINCT born FROM cand WHERE 100 * len(list_intersect(s, t)) >= 80 * (n + m - len(list_intersect(s, t)))),
gone AS (
  SELECT doc_id, line FROM lines JOIN items USING (s) WHERE {{'d': doc_id, 'l': line}} <> born
  UNION SELECT born.d, born.l FROM resembling
),
removed AS (SELECT doc_id, list_sort(list(line)) AS r FROM gone GROUP BY 1)
SELECT doc_id,
       CASE WHEN r IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(r, i)), lambda i: ls[i + 1]), chr(10)) END AS text,
       coalesce(array_to_string(r, ','), '') AS removed_lines, CAST(coalesce(len(r), 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN removed USING (doc_id)
"""


def _seeds(table: str, key: str, all_lengths: bool) -> str:
    """Seeds of all masks, and of whole short items: at all their lengths, or at the row's own."""
    least = min(map(len, decontam.MASKS))
    lengths = f"(SELECT DISTINCT len(t) AS n FROM b WHERE len(t) > 0 AND len(t) < {least}) JOIN {table} ON len(t) {'>=' if all_lengths else '='} n"
    parts = [f"SELECT {key}, p AS pos, 'whole ' || array_to_string(t[p + 1:p + n], ' ') AS seed FROM (SELECT {key}, t, n, unnest(range(len(t) - n + 1)) AS p FROM {lengths})"]
    for number, mask in enumerate(decontam.MASKS):
        marks = ", ".join(f"t[p + {i + 1}]" for i, c in enumerate(mask) if c == "1")
        parts.append(
            f"SELECT {key}, p AS pos, '{number} ' || concat_ws(' ', {marks}) AS seed FROM "
            f"(SELECT {key}, t, unnest(range(len(t) - {len(mask) - 1})) AS p FROM {table} WHERE len(t) >= {len(mask)})"
        )
    return " UNION ALL ".join(parts)


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


OVERLAPS = f"""
WITH d AS (SELECT doc_id, {_tokens("text")} AS t FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT MIN(item_id) AS item_id, t FROM (SELECT item_id, {_tokens("text")} AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY t),
ds AS ({_seeds("d", "doc_id", True)}),
bs AS ({_seeds("b", "item_id", False)}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.pos - bs.pos AS diagonal FROM ds JOIN bs USING (seed)),
cells AS (
  SELECT doc_id, item_id, diagonal, i, b_len,
         CASE WHEN i + diagonal >= 0 AND i + diagonal < len(dt) AND dt[i + diagonal + 1] = bt[i + 1] THEN 1 ELSE 0 END AS same
  FROM (SELECT doc_id, item_id, diagonal, d.t AS dt, b.t AS bt, len(b.t) AS b_len, unnest(range(len(b.t))) AS i
        FROM hits JOIN d USING (doc_id) JOIN b USING (item_id))
),
sums AS (
  SELECT *, SUM(CASE WHEN same = 1 THEN {decontam.MATCH} ELSE {decontam.MISMATCH} END) OVER w AS p, SUM(same) OVER w AS k,
         SUM(same) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i ROWS BETWEEN {decontam.STRETCH - 1} PRECEDING AND CURRENT ROW) AS near
  FROM cells WINDOW w AS (PARTITION BY doc_id, item_id, diagonal ORDER BY i)
),
lows AS (
  SELECT *, least(0, coalesce(MIN(p) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low
  FROM sums
),
runs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p - low DESC, i) AS place FROM lows),
best AS (SELECT doc_id, item_id, diagonal, i, b_len, p - low AS score, low, k FROM runs WHERE place = 1),
dense AS (SELECT doc_id, item_id, diagonal, MAX(near) AS most FROM sums GROUP BY ALL),
begun AS (
  SELECT best.doc_id, best.item_id, best.diagonal, best.b_len, best.score, best.k, coalesce(MAX(s.i) + 1, 0) AS start, best.k - coalesce(max_by(s.k, s.i), 0) AS matches
  FROM best LEFT JOIN sums s ON s.doc_id = best.doc_id AND s.item_id = best.item_id AND s.diagonal = best.diagonal AND s.i < best.i AND s.p = best.low
  GROUP BY best.doc_id, best.item_id, best.diagonal, best.b_len, best.score, best.k
),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, matches DESC, start, diagonal DESC) AS place
  FROM (SELECT begun.* EXCLUDE (matches, k), CAST(matches AS BIGINT) AS matches, most FROM begun JOIN dense USING (doc_id, item_id, diagonal))
  WHERE score >= least({decontam.LEAST_MATCHES}, b_len) * {decontam.MATCH} OR most >= least({decontam.LEAST_MATCHES}, ceil(b_len * {decontam.SHARE}))
)
SELECT doc_id, item_id, matches, CAST(score AS BIGINT) AS score, CAST(start + diagonal AS BIGINT) AS doc_start, CAST(start AS BIGINT) AS item_start
FROM kept WHERE place = 1
"""


#: crc32 of a number's decimal text, bit by bit: each character is mixed in, then shifted out in eight steps.
_CRC = (
    "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
    "lambda ch: list_concat([CAST(ascii(ch) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))), "
    "lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)) END), CAST(4294967295 AS BIGINT))"
)

SNAPSHOTS = f"""
WITH earlier AS (SELECT CAST(doc_id AS BIGINT) AS k, text, lang, source, {_CRC} % 16 AS r FROM documents),
later AS (
  SELECT CASE WHEN r IN (3, 4) OR again THEN -1 - k ELSE k END AS k, CASE WHEN r = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
         CASE WHEN r = 2 THEN source ELSE lang END AS lang, CASE WHEN r = 2 THEN lang WHEN r <> 4 THEN source END AS source
  FROM (SELECT *, false AS again FROM earlier WHERE r <> 0 UNION ALL SELECT *, true FROM earlier WHERE r = 5)
),
hashed AS (
  SELECT *, sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) AS sha FROM later
),
joined AS (
  SELECT a.k AS ak, b.k AS bk, a.text AS a_text, b.text AS b_text, a.lang AS a_lang, b.lang AS b_lang, a.source AS a_source, b.source AS b_source, b.sha
  FROM earlier a FULL OUTER JOIN hashed b ON a.k = b.k
),
gone AS (SELECT ak, a_text, a_lang, a_source, row_number() OVER (PARTITION BY a_text ORDER BY ak) AS place FROM joined WHERE bk IS NULL),
come AS (SELECT bk, b_text, b_lang, b_source, sha, row_number() OVER (PARTITION BY b_text ORDER BY bk) AS place FROM joined WHERE ak IS NULL),
pairs AS (
  SELECT *, 'key' AS met FROM joined WHERE ak IS NOT NULL AND bk IS NOT NULL
  UNION ALL
  SELECT ak, bk, a_text, b_text, a_lang, b_lang, a_source, b_source, sha, 'content'
  FROM gone FULL OUTER JOIN come ON a_text IS NOT DISTINCT FROM b_text AND gone.place = come.place
),
told AS (
  SELECT *, CASE WHEN ak IS NULL OR bk IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a_text IS DISTINCT FROM b_text THEN 'text' END,
         CASE WHEN a_lang IS DISTINCT FROM b_lang THEN 'lang' END, CASE WHEN a_source IS DISTINCT FROM b_source THEN 'source' END) END AS changed
  FROM pairs
)
SELECT coalesce(bk, ak) AS key, ak AS old_key,
       CASE WHEN ak IS NULL THEN 'insert' WHEN bk IS NULL THEN 'delete' WHEN met = 'content' THEN 'rekey' WHEN changed = '' THEN 'same' ELSE 'update' END AS op,
       changed, sha AS row_sha256
FROM told
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OVERLAPS, "op3_exact_top_k": TOP_K, "op4_line_dedup": LINES, "op9_ngram_join": COMPONENTS, "op12_snapshot_diff": SNAPSHOTS}
