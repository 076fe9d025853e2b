"""Queries of the document model as Spark SQL with a DuckDB twin each, for what plain SQL says best.

Spatial joins carry the document (and line) as equi-keys, so that they plan as hash joins with a residual range filter.
"""

from __future__ import annotations

from functools import partial

from .base import BLOCKS_DUCK, BLOCKS_SPARK, CELLS_DUCK, CELLS_SPARK, WORDS_DUCK, WORDS_SPARK, run

PAIRS: dict[str, tuple[str, str]] = {}


def both(name: str, spark: str, duck: str | None = None) -> None:
    PAIRS[name] = (spark, duck or spark)


# layout: types, views, order, quality
# words: clusters, groups, n-grams, boxes
ROWS = """SELECT doc, cluster, count(*) AS n_words, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(jump) OVER (PARTITION BY doc ORDER BY y0, line, word_no ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc ORDER BY y0, line, word_no) > 3 THEN 1 ELSE 0 END AS jump FROM words) a) b GROUP BY doc, cluster"""
both("q_line_clusters", f"WITH {WORDS_SPARK} SELECT doc, CAST(cluster AS BIGINT) AS cluster, n_words, x0, x1 FROM ({ROWS})", f"WITH {WORDS_DUCK} SELECT doc, CAST(cluster AS BIGINT) AS cluster, n_words, x0, x1 FROM ({ROWS})")
GROUPS = """SELECT doc, line, max(g) + 1 AS n_groups FROM (SELECT doc, line, sum(jump) OVER (PARTITION BY doc, line ORDER BY word_no ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY doc, line ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 12 THEN 1 ELSE 0 END AS jump FROM words) a) b GROUP BY doc, line"""
both("q_col_groups", f"WITH {WORDS_SPARK} SELECT doc, line, CAST(n_groups AS BIGINT) AS n_groups FROM ({GROUPS})", f"WITH {WORDS_DUCK} SELECT doc, line, CAST(n_groups AS BIGINT) AS n_groups FROM ({GROUPS})")
NGRAM = "SELECT gram, count(*) AS n FROM (SELECT concat(text, ' ', lead(text) OVER (PARTITION BY doc, line ORDER BY word_no)) AS gram, lead(text) OVER (PARTITION BY doc, line ORDER BY word_no) AS nxt FROM words) a WHERE nxt IS NOT NULL GROUP BY gram HAVING count(*) >= 3"
both("q_word_ngrams", f"WITH {WORDS_SPARK} {NGRAM}", f"WITH {WORDS_DUCK} {NGRAM}")
#: Boxes come once for each line they reach, so that the line is an equi-key of the spatial join.
BOXES = "boxes AS (SELECT doc, idx, y0 - 1 AS by0, y0 + 30 AS by1, 30.0 AS bx0, 200.0 AS bx1, idx + k AS bline FROM blocks, (SELECT 0 AS k UNION ALL SELECT 1) e WHERE type = 'table')"
INBOX = "SELECT w.doc, b.idx, count(*) AS n FROM words w JOIN boxes b ON w.doc = b.doc AND w.line = b.bline AND (w.x0 + w.x1) / 2 BETWEEN b.bx0 AND b.bx1 AND (w.y0 + w.y1) / 2 BETWEEN b.by0 AND b.by1 GROUP BY w.doc, b.idx"
#: The constant side exploded out of an array: no nested-loop join.
BOXES_SPARK = BOXES.replace("FROM blocks, (SELECT 0 AS k UNION ALL SELECT 1) e", "FROM blocks LATERAL VIEW explode(array(0, 1)) e AS k")
both("q_words_in_boxes", f"WITH {WORDS_SPARK}, {BOXES_SPARK} {INBOX}", f"WITH {WORDS_DUCK}, {BOXES} {INBOX}")
OUTBOX = "SELECT doc, count(*) AS n FROM words w WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE w.doc = b.doc AND w.line = b.bline AND (w.x0 + w.x1) / 2 BETWEEN b.bx0 AND b.bx1 AND (w.y0 + w.y1) / 2 BETWEEN b.by0 AND b.by1) GROUP BY doc"
# written as an anti join: decorrelating NOT EXISTS would turn the range into a nested-loop join
ANTI = OUTBOX.replace("WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE ", "LEFT ANTI JOIN boxes b ON ").replace(") GROUP BY doc", " GROUP BY doc")
both("q_words_outside_siblings", f"WITH {WORDS_SPARK}, {BOXES_SPARK} {ANTI}", f"WITH {WORDS_DUCK}, {BOXES} {OUTBOX}")
NEAR = "SELECT doc, line, word_no, {f}(col, dist) AS col FROM (SELECT w.doc, w.line, w.word_no, c.col, abs((w.x0 + w.x1) / 2 - c.cx) + c.col / 1000000.0 AS dist FROM words w JOIN (SELECT 0 AS col, 60.0 AS cx UNION ALL SELECT 1, 180.0 UNION ALL SELECT 2, 330.0) c ON abs((w.x0 + w.x1) / 2 - c.cx) <= 80) t GROUP BY doc, line, word_no"
NEAR_SPARK = """SELECT doc, line, word_no, min_by(col, dist) AS col FROM (SELECT doc, line, word_no, c.col, abs((x0 + x1) / 2 - c.cx) + c.col / 1000000.0 AS dist FROM words
  LATERAL VIEW inline(array(named_struct('col', 0, 'cx', 60.0D), named_struct('col', 1, 'cx', 180.0D), named_struct('col', 2, 'cx', 330.0D))) c AS col, cx WHERE abs((x0 + x1) / 2 - cx) <= 80) t GROUP BY doc, line, word_no"""
both("q_nearest_column", f"WITH {WORDS_SPARK} " + NEAR_SPARK.replace("c.", ""), f"WITH {WORDS_DUCK} " + NEAR.format(f="arg_min"))
# tables: candidates, confusion gate, funnel, confidence, mapping
# batches and tasks
both(
    "q_summary_unpivot",
    "SELECT metric, value FROM (SELECT count(*) AS total, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed FROM batch_tasks) UNPIVOT (value FOR metric IN (total, completed, failed))",
    "SELECT metric, value FROM (UNPIVOT (SELECT count(*) AS total, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed FROM batch_tasks) ON total, completed, failed INTO NAME metric VALUE value)",
)
both(
    "q_kie_csv",
    "SELECT DISTINCT task_id, get_json_object(result, '$.kie_fields.invoice_number') AS invoice_number, get_json_object(result, '$.kie_fields.total') AS total, get_json_object(result, '$.document_type') AS document_type FROM batch_tasks WHERE status = 'completed' AND result IS NOT NULL",
    "SELECT DISTINCT task_id, json_extract_string(result, '$.kie_fields.invoice_number') AS invoice_number, json_extract_string(result, '$.kie_fields.total') AS total, json_extract_string(result, '$.document_type') AS document_type FROM batch_tasks WHERE status = 'completed' AND result IS NOT NULL",
)
NUMS = "SELECT DISTINCT task_id, {n} AS total FROM (SELECT task_id, {g}(result, '$.kie_fields.total') AS t FROM batch_tasks WHERE result IS NOT NULL) x WHERE t IS NOT NULL"
both("q_typed_numbers", NUMS.format(g="get_json_object", n="try_cast(replace(regexp_extract(t, '[0-9][0-9,]*([.][0-9]+)?', 0), ',', '') AS DOUBLE)"), NUMS.format(g="json_extract_string", n="try_cast(replace(regexp_extract(t, '[0-9][0-9,]*([.][0-9]+)?', 0), ',', '') AS DOUBLE)"))
NAMES_ = "SELECT task_id, CASE WHEN n = 1 THEN concat(stem, '.csv') ELSE concat(stem, '_', CAST(k AS {S}), '.csv') END AS file FROM (SELECT task_id, stem, count(*) OVER (PARTITION BY stem) AS n, row_number() OVER (PARTITION BY stem ORDER BY task_id) AS k FROM (SELECT DISTINCT task_id, {r} AS stem FROM batch_tasks WHERE status = 'completed') a) b"
both("q_order_filenames", NAMES_.format(S="STRING", r="regexp_replace(file_name, '[.][a-z]+$', '')"), NAMES_.format(S="VARCHAR", r="regexp_replace(file_name, '[.][a-z]+$', '')"))
HITL = "SELECT status, reason, count(*) AS n, count(DISTINCT task_id) AS tasks FROM (SELECT DISTINCT review_id, task_id, status, reason FROM hitl_reviews) t GROUP BY status, reason"
both("q_hitl_queue", HITL)
# events
TAIL = "SELECT task_id, id, type FROM (SELECT task_id, id, type, row_number() OVER (PARTITION BY task_id ORDER BY id DESC) AS rn FROM (SELECT DISTINCT task_id, id, type FROM task_events) d) t WHERE rn <= 100"
both("q_event_log_tail", TAIL)
both("q_event_replay", "SELECT DISTINCT task_id, id, type FROM task_events WHERE id > 5")
both("q_task_state", "SELECT task_id, max_by(type, id) AS last_type, max(progress) AS progress, count(DISTINCT id) AS n_events FROM task_events GROUP BY task_id", "SELECT task_id, arg_max(type, id) AS last_type, max(progress) AS progress, count(DISTINCT id) AS n_events FROM task_events GROUP BY task_id")
SESS = "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(j) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts > prev + {d} THEN 1 ELSE 0 END AS j FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) p) a) b GROUP BY user_id, s) c GROUP BY user_id"
both("q_sessions", SESS.format(d="INTERVAL 30 MINUTES"), SESS.format(d="INTERVAL 30 MINUTE"))
both("q_tumbling", "SELECT date_format(date_trunc('HOUR', ts), 'yyyy-MM-dd HH') AS h, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS h, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
# text, rules, measures
both(
    "q_pii_counts",
    r"SELECT doc_id, regexp_count(text, '\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b') AS n_ssn, regexp_count(text, '\\b[0-9]{2}-[0-9]{7}\\b') AS n_ein, regexp_count(text, '\\b[0-9]{9}\\b') AS n_nine FROM documents",
    r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) AS INTEGER) AS n_ssn, CAST(len(regexp_extract_all(text, '\b[0-9]{2}-[0-9]{7}\b')) AS INTEGER) AS n_ein, CAST(len(regexp_extract_all(text, '\b[0-9]{9}\b')) AS INTEGER) AS n_nine FROM documents",
)
both(
    "q_stratified_alloc",
    "SELECT source, n, CAST(base + CASE WHEN rk <= left_over THEN 1 ELSE 0 END AS BIGINT) AS take FROM (SELECT *, row_number() OVER (ORDER BY rem DESC, source) AS rk, 100 - sum(base) OVER () AS left_over FROM (SELECT source, n, (100 * n) DIV total AS base, (100 * n) % total AS rem FROM (SELECT coalesce(source, '?') AS source, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY 1)))",
    "SELECT source, n, CAST(base + CASE WHEN rk <= left_over THEN 1 ELSE 0 END AS BIGINT) AS take FROM (SELECT *, row_number() OVER (ORDER BY rem DESC, source) AS rk, 100 - sum(base) OVER () AS left_over FROM (SELECT source, n, (100 * n) // total AS base, (100 * n) % total AS rem FROM (SELECT coalesce(source, '?') AS source, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY 1)))",
)
both("q_quote_hash", "SELECT item_id, left(sha2(lower(text), 256), 12) AS quote_hash, length(text) AS n FROM eval_items", "SELECT item_id, left(sha256(lower(text)), 12) AS quote_hash, length(text) AS n FROM eval_items")
both("q_hedge_counts", "SELECT item_id, regexp_count(lower(text), '\\\\b(may|might|could|suggests?|appears?|likely|possibly)\\\\b') AS n_hedges FROM eval_items", "SELECT item_id, CAST(len(regexp_extract_all(lower(text), '\\b(may|might|could|suggests?|appears?|likely|possibly)\\b')) AS INTEGER) AS n_hedges FROM eval_items")
both("q_mapped_rows_upsert", "SELECT o_orderkey AS task_id, 'new' AS version, o_totalprice AS total FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o.o_orderkey, 'old', o.o_totalprice FROM orders o LEFT ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) n ON o.o_orderkey = n.o_orderkey", "SELECT o_orderkey AS task_id, 'new' AS version, o_totalprice AS total FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o.o_orderkey, 'old', o.o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_orderkey % 3 = 0 AND n.o_orderkey = o.o_orderkey)")
both("q_validation_by_rule", "SELECT d.doc_type, count(*) AS n, count_if(r.least IS NULL OR d.n_chars >= r.least) AS passed FROM documents d LEFT JOIN (SELECT * FROM VALUES ('invoice', 300), ('letter', 600) AS v(kind, least)) r ON d.doc_type = r.kind GROUP BY d.doc_type", "SELECT d.doc_type, count(*) AS n, count_if(r.least IS NULL OR d.n_chars >= r.least) AS passed FROM documents d LEFT JOIN (VALUES ('invoice', 300), ('letter', 600)) AS r(kind, least) ON d.doc_type = r.kind GROUP BY d.doc_type")

QUERIES = {name: partial(lambda spark, d, sql: run(spark, d, sql), sql=pair[0]) for name, pair in PAIRS.items()}
SQL = {name: pair[1] for name, pair in PAIRS.items()}
