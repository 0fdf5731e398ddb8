"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import LOWER, UPPER
from spanloom.llm.decontaminate import op2_leaks
from spanloom.llm.fingerprints import op13_fingerprints
from spanloom.llm.jaccard import op1_jaccard
from spanloom.llm.lines import op8_line_copies
from spanloom.llm.pages import op7_main_text
from spanloom.llm.pieces import op10_pieces
from spanloom.llm.ppm import op4_ppm
from spanloom.llm.quality import op3_repetition
from spanloom.llm.repeats import op9_repeats
from spanloom.llm.runs import op12_runs
from spanloom.llm.secrets import op6_linked_secrets
from spanloom.llm.shards import op5_training_order
from spanloom.llm.turns import op11_repair
from spanloom.session import ship_package

_BY_NAME = {
    "op1_jaccard": op1_jaccard,
    "op2_leaks": op2_leaks,
    "op3_repetition": op3_repetition,
    "op4_ppm": op4_ppm,
    "op5_training_order": op5_training_order,
    "op6_linked_secrets": op6_linked_secrets,
    "op7_main_text": op7_main_text,
    "op8_line_copies": op8_line_copies,
    "op9_repeats": op9_repeats,
    "op10_pieces": op10_pieces,
    "op11_repair": op11_repair,
    "op12_runs": op12_runs,
    "op13_fingerprints": op13_fingerprints,
}



def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(query) for name, query in _BY_NAME.items()}

#: CRC-32 in DuckDB SQL: a common table of 256 remainders, and the unsigned sum of an ASCII text over it.
_CRC_TABLE = """crc_table AS (SELECT list(r ORDER BY x) AS t FROM (SELECT x, list_reduce([x::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
 lambda v, o: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END) AS r FROM range(256) b(x)))"""


def _crc(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1),
 lambda i: ascii(substr({text}, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"""


#: DuckDB SQL where it can say the result on whole tables: suffix arrays, models, alignments, page trees,
#: permutations and paths it can't, and edit distances of all lines take it too long. Tests hold those
#: queries against brute force.
SQL: dict[str, str] = {
    "op1_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM w),
 n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, unnest(sh) AS g FROM s),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
 t(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT t.id, e.y FROM t JOIN e ON e.x = t.c)
SELECT t.id AS doc_id, n.n AS n_shingles, min(t.c) AS component_id FROM t JOIN n ON n.doc_id = t.id GROUP BY 1, 2""",
    "op9_repeats": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
 w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d)),
 g AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
 i AS (SELECT *, sum(CASE WHEN p > q + 100 OR q IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM g)),
 r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, run),
 e AS (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, n, n FROM d),
 k AS (SELECT e.doc_id, e.a, substr(h, 2 * lo + 1, 2 * (e.a - lo)) AS part FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS lo FROM e) e JOIN d USING (doc_id)),
 t AS (SELECT doc_id, sha256(unhex(string_agg(part, '' ORDER BY a))) AS kept_sha256 FROM k GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(x.gone, 0) AS BIGINT) AS n_removed, coalesce(x.spans, 0) AS n_spans, t.kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM r GROUP BY 1) x USING (doc_id)""",
    "op11_repair": rf"""
WITH RECURSIVE {_CRC_TABLE},
 b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
 h AS (SELECT *, {_crc("name")} % 20 AS kind FROM b, crc_table),
 x AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
 r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS real FROM x),
 f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS initial_before,
  CASE WHEN real = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(real, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r),
 ins(s, t, c, l, o) AS (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']),
  (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
 dp(conv_id, i, s, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'kept': []::VARCHAR[]}} FROM conversations
  UNION ALL
  SELECT conv_id, i, s, min(best) FROM (
   SELECT f.conv_id, f.i, e.s, {{'cost': dp.best.cost + ins.c + e.c, 'audit': dp.best.audit || ins.l || e.l, 'kept': list_concat(list_concat(dp.best.kept, ins.o), e.o)}} AS best
   FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins ON ins.s = dp.s,
    LATERAL (SELECT ins.t AS s, 2 AS c, 'D' AS l, []::VARCHAR[] AS o
     UNION ALL SELECT CASE ins.t WHEN 2 THEN 3 ELSE 2 END, 1 + CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'R', [CASE ins.t WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text]
      WHERE f.fault NOT IN ('blank', 'duplicate')
     UNION ALL SELECT CASE f.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text]
      WHERE f.fault NOT IN ('blank', 'duplicate') AND ((f.initial = 's' AND ins.t = 0) OR (f.initial = 'u' AND ins.t <> 2) OR (f.initial = 'a' AND ins.t = 2))) e) GROUP BY ALL),
 n AS (SELECT conv_id, max(i) AS n FROM dp GROUP BY 1),
 z AS (SELECT dp.conv_id, min({{'cost': best.cost + ins.c, 'audit': best.audit || ins.l, 'kept': list_concat(best.kept, ins.o)}}) AS best
  FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i JOIN ins ON ins.s = dp.s WHERE ins.t IN (0, 3) GROUP BY 1),
 t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.kept, chr(10))) AS repaired_sha256 FROM z LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM z.conv_id""",
    "op12_runs": rf"""
WITH {_CRC_TABLE},
 d AS (SELECT row_number() OVER () AS rid, doc_id, {_crc("doc_id::VARCHAR")} AS h,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents, crc_table),
 e AS (SELECT *, len(w) AS n, coalesce(h % 10 = 0 AND len(w) > 0, false) AS hit, (h // 10) % len(w) AS a, 3 + (h // 10) % 8 AS parts FROM d),
 x AS (SELECT rid, i, CASE WHEN hit AND i >= a THEN w[1 + a + (i - a) % (1 + (n - a) // parts)] ELSE w[1 + i] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM e)),
 g AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS s
  FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
 p AS (SELECT u.rid, v.i - u.i AS q, u.i FROM g u JOIN g v ON u.rid = v.rid AND u.s = v.s AND u.i < v.i),
 c AS (SELECT rid, q, min(i) AS s, count(*) + 4 + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM p)
  GROUP BY rid, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
 r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.rid = c.rid AND b.q < c.q AND b.s <= c.s AND b.s + b.len >= c.s + c.len)),
 k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = x.rid AND x.i >= r.s + r.q AND x.i < r.s + r.len) GROUP BY rid),
 b AS (SELECT rid, count(*) AS n_runs, first(s ORDER BY len / q DESC, s, q) AS start, first(len ORDER BY len / q DESC, s, q) AS length, first(q ORDER BY len / q DESC, s, q) AS period,
  string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
 sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM e LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)""",
}
