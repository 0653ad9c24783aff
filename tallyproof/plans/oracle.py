"""DuckDB SQL for the registered queries: written from the numbers, never through the parsers."""

from __future__ import annotations

from . import views as V

_E, _L, _W = (f"({V.in_duckdb(x)})" for x in (V.EVENT_LEDGER, V.LINE_LEDGER, V.MADE_WORDS))
_FLOW = f"({V.in_duckdb(V.FLOW_LEDGER)})"
_LINES = f"({V.in_duckdb(V.EVENT_LINES)})"
_HOT = f"({V.in_duckdb(V.HOT_LEDGER)})"
_BUNDLE = f"({V.in_duckdb(V.BUNDLE_LEDGER)})"
_JOBS, _CODES = (f"({V.in_duckdb(x)})" for x in (V.JOB_ROWS, V.CODE_ROWS))
_PRICE = "cast(l_extendedprice AS decimal(18,2))"
_FIGURE = r"[0-9]{1,3}(,[0-9]{3})*[.][0-9][0-9]"  # digits in running text, as FIXTURES.md has them
_FIGURES = f"[cast(regexp_replace(x, '[^0-9.]', '', 'g') AS decimal(18,2)) FOR x IN regexp_extract_all(text, '{_FIGURE}')]"


def _chain(rows: str, key: str) -> str:
    """Segments of a ledger, as common table expressions s, g, o and c."""
    return f"""
s AS (SELECT *, coalesce(sum(CASE WHEN balance IS NOT NULL OR amount IS NULL THEN 1 ELSE 0 END)
        OVER (PARTITION BY {key} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM {rows}),
g AS (SELECT {key}, seg, max(beginning) AS beginning, cast(sum(amount) AS decimal(18,2)) AS move, count(amount) AS n, max(balance) AS closing,
        max(CASE WHEN amount IS NULL THEN 1 ELSE 0 END) AS broken, count(*) - count(amount) AS unread FROM s GROUP BY {key}, seg),
o AS (SELECT *, CASE WHEN seg = 0 THEN beginning ELSE lag(closing) OVER (PARTITION BY {key} ORDER BY seg) END AS opening FROM g),
c AS (SELECT {key}, cast(seg AS bigint) AS seg, opening, closing, move, n,
        CASE WHEN broken = 1 OR closing IS NULL OR opening IS NULL THEN 'UNCHECKED'
             WHEN abs(move - (closing - opening)) > 0.01 THEN 'NEEDS_REVIEW' ELSE 'OK' END AS state, unread FROM o)"""


def _money(x: str) -> str:
    """1,234.50 or a question mark."""
    return f"coalesce(format('{{:,.2f}}', cast({x} AS double)), '?')"


#: The rows of settlements of three kinds, as r (doc_id, section, type, status, n, total, customers).
_ROUTED = f"""
i AS (SELECT o_custkey AS doc, o_orderkey AS job, cast(o_totalprice AS decimal(18,2)) AS net, {_PRICE} AS p, l_returnflag = 'R' AS back FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT doc, job, max(net) AS net, sum(p) AS s, coalesce(sum(CASE WHEN back THEN p END), 0) AS given, CASE WHEN job % 10 = 0 THEN 1 ELSE 0 END AS bad, CASE WHEN job % 13 = 0 THEN 1 ELSE 0 END AS off FROM i GROUP BY doc, job),
c AS (SELECT l_suppkey AS doc, l_returnflag AS code, CASE WHEN l_returnflag = 'R' THEN -{_PRICE} ELSE {_PRICE} END AS p, CASE WHEN l_suppkey % 3 = 0 OR l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS bad FROM lineitem),
u AS (
  SELECT doc * 10 + 1 AS doc_id, 'Job' AS section, 'COD' AS type, 0 AS bad, 3 AS amount, 1 AS customer FROM j
  UNION ALL SELECT doc * 10 + 1, 'Job', 'Total Cost', bad, s + 1000, 1 FROM j
  UNION ALL SELECT doc * 10 + 1, 'Job', 'Subtotal', bad, 2 * given + 1000 + bad, 1 FROM j
  UNION ALL SELECT doc * 10 + 1, 'Job', CASE WHEN back THEN 'Add-back' ELSE 'Deduction' END, (job % 10 = 0)::int, CASE WHEN back THEN p ELSE -p END, 1 FROM i
  UNION ALL SELECT doc * 10 + 1, 'Summary', 'Subtotal', 0, sum(2 * given + 1000 + bad), 0 FROM j GROUP BY doc
  UNION ALL SELECT DISTINCT doc * 10 + 1, 'Summary', 'Adjustment', 0, -5, 0 FROM j
  UNION ALL SELECT doc * 10 + 1, 'Summary', 'Total', 0, sum(2 * given + 1000 + bad) - 5 + (doc % 9 = 0)::int, 0 FROM j GROUP BY doc
  UNION ALL SELECT DISTINCT doc * 10 + 1, 'Side column', 'Entry', 0, 2, 0 FROM j UNION ALL SELECT DISTINCT doc * 10 + 1, 'Notes', 'Balance', 0, 4, 0 FROM j
  UNION ALL SELECT doc * 10 + 2, 'X' || code || ' Parts Sent', CASE WHEN p < 0 THEN 'Deduction' ELSE 'Earning' END, bad, p, 0 FROM c
  UNION ALL SELECT DISTINCT doc * 10 + 2, 'X' || code || ' Parts Sent', 'Total', bad, NULL::decimal(18,2), 0 FROM c
  UNION ALL SELECT doc * 10 + 2, 'X' || max(code) || ' Parts Sent', 'Total', 0, NULL::decimal(18,2), 0 FROM c GROUP BY doc
  UNION ALL SELECT doc * 10 + 3, 'order', 'Gross Pay', 0, 2 * net, 1 FROM j UNION ALL SELECT doc * 10 + 3, 'order', 'Net Pay', 0, net, 1 FROM j UNION ALL SELECT doc * 10 + 3, 'order', 'Earning', 0, p, 0 FROM i
  UNION ALL SELECT doc * 10 + 3, 'order', 'Order Total', off, net + s + off, 0 FROM j
  UNION ALL SELECT DISTINCT doc * 10 + 3, x.section, x.type, 0, x.amount, x.customer FROM j, (VALUES ('driver', 'Deduction', -20, 0), ('driver', 'Subtotal', -20, 0), ('recurring', 'Deduction', -25, 0), ('recurring', 'Subtotal', -25, 0),
    ('deductions', 'Deduction', -15, 0), ('deductions', 'Subtotal', -15, 0), ('escrow', 'Account', 0, 1), ('dispatch', 'Information', 0, 0)) x(section, type, amount, customer)
  UNION ALL SELECT doc * 10 + 3, 'pay_summary', 'Total', 0, sum(net + s + off), 0 FROM j GROUP BY doc UNION ALL SELECT DISTINCT doc * 10 + 3, 'pay_summary', 'Total', 0, -60, 0 FROM j
  UNION ALL SELECT doc * 10 + 3, 'pay_summary', 'Total', 0, sum(net + s + off) - 60 + (doc % 11 = 0)::int, 0 FROM j GROUP BY doc
  UNION ALL SELECT DISTINCT doc * 10 + 3, 'escrow', 'Total', 0, 50, 1 FROM j UNION ALL SELECT DISTINCT doc * 10 + 3, 'escrow', 'Total', 0, 25, 1 FROM j
  UNION ALL SELECT DISTINCT doc * 10 + 3, 'escrow', 'Total', 0, 75 + (doc % 17 = 0)::int, 1 FROM j),
r AS (SELECT doc_id, section, type, CASE WHEN bad = 1 THEN 'NEEDS_REVIEW' ELSE 'OK' END AS status, count(*) AS n, sum(amount) AS total, sum(customer) AS customers FROM u GROUP BY ALL)"""

_SKEW = f"""
w AS (SELECT * FROM {_W}),
h AS (SELECT doc_id, count(*) AS n, regr_slope(bottom, (x0 + x1) / 2) AS b, regr_r2(bottom, (x0 + x1) / 2) AS r2,
        regr_sxx(bottom, (x0 + x1) / 2) AS sxx, regr_syy(bottom, (x0 + x1) / 2) AS syy, list_sort(list(bottom - top)) AS hs FROM w GROUP BY doc_id),
k AS (SELECT doc_id, n, CASE WHEN n >= 40 AND sxx >= 1e-6 AND syy >= 1e-6 AND r2 >= 0.5 AND abs(b) <= 0.25 THEN b ELSE 0e0 END AS slope,
        greatest(2e0, 0.45e0 * CASE WHEN hs[n // 2 + 1] = 0 THEN 8e0 ELSE hs[n // 2 + 1] END) AS tol FROM h),
v AS (SELECT w.*, top - slope * (x0 + x1) / 2 AS v, tol FROM w JOIN k USING (doc_id)),
f AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY doc_id ORDER BY v, word_idx) <= tol THEN 0 ELSE 1 END AS f FROM v),
lines AS (SELECT *, cast(sum(f) OVER (PARTITION BY doc_id ORDER BY v, word_idx ROWS UNBOUNDED PRECEDING) AS bigint) AS line_no FROM f)"""

_COLUMNS = f"""
w AS (SELECT * FROM {_W}),
f AS (SELECT *, CASE WHEN x1 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x1, word_idx) <= 6 THEN 0 ELSE 1 END AS f FROM w),
r AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY x1, word_idx ROWS UNBOUNDED PRECEDING) AS run FROM f),
q AS (SELECT doc_id, run, avg(x1) AS center, count(*) AS n FROM r GROUP BY doc_id, run),
cols AS (SELECT doc_id, center, n FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS most FROM q) WHERE n >= 2 OR most < 2)"""

_BOXES = f"""
b AS (SELECT doc_id, word_idx, CASE WHEN word_idx % 17 = 0 THEN ' ' ELSE text END AS text, cast(trunc(x0 * 10) AS int) AS l, cast(trunc(top * 10) AS int) AS t, conf FROM {_W}),
p AS (SELECT doc_id, word_idx, text, l * 0.24e0 AS x0, (l + 125) * 0.24e0 AS x1, t * 0.24e0 AS top, conf FROM b WHERE length(trim(text)) > 0 AND conf >= 0)"""

_OUTCOME = f"""
WITH {_chain(_E, "block_id")},
b AS (SELECT block_id, count(*) AS rows FROM {_E} GROUP BY block_id),
k AS (SELECT block_id, max(CASE WHEN state <> 'UNCHECKED' THEN 1 ELSE 0 END) AS checked, sum(CASE WHEN state = 'NEEDS_REVIEW' THEN n ELSE unread END) AS flagged FROM c GROUP BY block_id),
p AS (SELECT block_id // 3 AS doc_id, block_id, rows, flagged, CASE WHEN checked = 1 THEN flagged = 0 END AS passed, block_id % 11 <> 0 AS complete FROM b JOIN k USING (block_id)),
t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS many,
        CASE WHEN passed THEN 'Each printed running balance follows from the amounts before it.'
             WHEN NOT passed THEN 'Running balances and amounts disagree, or amounts are unread: see the marked rows.'
             ELSE 'Neither two end balances nor a running balance is printed: nothing proves the amounts.' END AS detail FROM p),
d AS (SELECT doc_id, cast(sum(rows) AS bigint) AS rows, cast(sum(flagged) AS bigint) AS flagged, bool_and(coalesce(passed, false)) AS all_passed,
        bool_or(NOT coalesce(passed, true)) AS any_failed, bool_and(complete) AS complete,
        string_agg(CASE WHEN many > 1 THEN 'Account ' || block_id || ': ' || detail ELSE detail END, ' | ' ORDER BY block_id) AS detail FROM t GROUP BY doc_id),
outcome AS (SELECT doc_id, rows, flagged,
        CASE WHEN rows = 0 THEN 'failed' WHEN all_passed AND flagged = 0 AND complete THEN 'proven' ELSE 'unproven' END AS state,
        CASE WHEN all_passed AND flagged = 0 AND complete THEN 'PASSED' WHEN any_failed THEN 'FAILED' ELSE 'NOT PROVABLE' END AS verdict,
        CASE WHEN complete THEN detail ELSE 'INCOMPLETE READ | ' || detail END AS detail FROM d)"""

_VOCABULARY = """
v(key, ordinal, pattern, weight) AS (VALUES ('english', 0, ' the ', 30), ('english', 0, ' and ', 15), ('english', 0, ' of ', 10), ('french', 1, ' les? ', 30),
  ('french', 1, ' et ', 15), ('german', 2, ' der ', 30), ('german', 2, ' und ', 15), ('spanish', 3, ' el ', 30), ('spanish', 3, ' los ', 15), ('spanish', 3, ' que ', 5))"""

ORACLE_SQL: dict[str, str] = {
    "money_tokens": f"""
SELECT l_orderkey, l_linenumber, l_partkey, {_PRICE} AS value, cast(CASE l_linenumber % 6 WHEN 1 THEN -1 WHEN 2 THEN -1 WHEN 3 THEN -1 WHEN 4 THEN 1 END AS int) AS sign,
       {_PRICE} AS again FROM lineitem""",
    "document_figures": f"SELECT doc_id, cast(len(f) AS bigint) AS n, cast(coalesce(list_sum(f), 0) AS decimal(18,2)) AS total FROM (SELECT doc_id, {_FIGURES} AS f FROM documents)",
    "date_tokens": """
SELECT l_orderkey, l_linenumber, l_partkey, cast(month(l_shipdate) AS int) AS m, cast(day(l_shipdate) AS int) AS d,
       cast(CASE l_linenumber % 4 WHEN 0 THEN year(l_shipdate) WHEN 1 THEN 2000 + year(l_shipdate) % 100 END AS int) AS y,
       cast(CASE WHEN l_linenumber % 4 = 1 THEN make_date(2000 + year(l_shipdate) % 100, month(l_shipdate), day(l_shipdate)) ELSE l_shipdate END AS date) AS day FROM lineitem""",
    "month_name_dates": "SELECT o_orderkey, cast(month(o_orderdate) AS int) AS m, cast(day(o_orderdate) AS int) AS d FROM orders",
    "statement_periods": """
SELECT o_orderkey, cast(CASE WHEN o_orderkey % 4 = 3 THEN last_day(o_orderdate) - 35 ELSE date_trunc('month', o_orderdate) END AS date) AS start_day,
       last_day(o_orderdate) AS end_day FROM orders""",
    "statement_periods_more": """
SELECT o_orderkey, cast(CASE WHEN o_orderkey % 3 < 2 THEN date_trunc('month', o_orderdate) END AS date) AS start_day,
       cast(CASE WHEN o_orderkey % 3 < 2 THEN last_day(o_orderdate) END AS date) AS end_day FROM orders""",
    "text_facts": r"""
SELECT doc_id, cast(length(regexp_replace(text, '\s+', '', 'g')) AS bigint) AS squashed, cast(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS bigint) AS collapsed,
       substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 60) AS head, format('{:,.2f}', cast(n_chars AS double)) AS chars FROM documents""",
    "native_or_scan": """
SELECT page_id // 4 AS doc_id, cast(coalesce(sum(length(html)), 0) AS bigint) AS chars, count(*) AS pages,
       coalesce(sum(length(html)), 0) >= 200 * greatest(1, count(*) // 3) AS is_native FROM pages GROUP BY 1""",
    "profile_scores": f"""
WITH {_VOCABULARY},
s AS (SELECT doc_id, key, ordinal, cast(sum(weight) AS int) AS score FROM documents, v WHERE regexp_matches(substr(text, 1, 6000), pattern, 'i') GROUP BY doc_id, key, ordinal),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS r FROM s) WHERE r = 1)
SELECT doc_id, coalesce(key, 'generic') AS key, coalesce(score, 0) AS score,
       cast(CASE WHEN key IS NULL THEN 50 WHEN score >= 40 THEN least(97, score + 30) ELSE greatest(40, score) END AS int) AS confidence
FROM documents LEFT JOIN b USING (doc_id)""",
    "statement_split": """
SELECT page_id // 25 AS doc_id, page_id AS page, cast(sum(CASE WHEN page_id % 3 = 0 OR first THEN 1 ELSE 0 END) OVER (PARTITION BY page_id // 25 ORDER BY page_id) AS bigint) AS stmt_no
FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id // 25 ORDER BY page_id) = 1 AS first FROM pages)""",
    "page_skew": f"WITH {_SKEW} SELECT doc_id, n, slope, tol FROM k",
    "line_groups": f"WITH {_SKEW} SELECT doc_id, line_no, count(*) AS n, min(top) AS top, min(word_idx) AS first FROM lines GROUP BY doc_id, line_no",
    "line_text": f"WITH {_SKEW} SELECT doc_id, line_no, string_agg(text, ' ' ORDER BY x0, v, word_idx) AS text FROM lines GROUP BY doc_id, line_no",
    "money_columns": f"WITH {_COLUMNS} SELECT doc_id, round(center, 6) AS center, n FROM cols",
    "nearest_column": f"""
WITH {_COLUMNS},
e AS (SELECT doc_id, word_idx, x1 + word_idx % 9 AS x1 FROM w),
m AS (SELECT e.doc_id, word_idx, arg_min(center, {{'f': abs(center - x1), 'c': center}}) AS center FROM e JOIN cols USING (doc_id) WHERE abs(center - x1) <= 7 GROUP BY e.doc_id, word_idx)
SELECT e.doc_id, round(m.center, 6) AS center, count(*) AS n FROM e LEFT JOIN m ON e.doc_id = m.doc_id AND e.word_idx = m.word_idx GROUP BY 1, 2""",
    "column_labels": f"""
WITH {_COLUMNS},
b AS (SELECT doc_id, min(x1) AS lo, max(x1) AS hi FROM w GROUP BY doc_id),
h AS (SELECT doc_id, 1 AS seq, 'withdrawals' AS name, lo + 10 AS mid FROM b UNION ALL SELECT doc_id, 2, 'deposits', hi - 120 FROM b UNION ALL SELECT doc_id, 3, 'balance', hi + 30 FROM b),
m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS many FROM cols)
SELECT m.doc_id, round(center, 6) AS center, arg_min(name, {{'f': abs(mid - center), 's': seq}}) AS label FROM m JOIN h USING (doc_id)
WHERE many >= 2 AND abs(mid - center) < 80 GROUP BY m.doc_id, center""",
    "ocr_confidence": f"WITH {_BOXES} SELECT doc_id, round(avg(conf), 6) AS conf, cast(round(avg(conf)) AS int) || '%' AS percent, count(*) AS n, round(max(x1), 6) AS right_edge FROM p GROUP BY doc_id",
    "ocr_lines": f"WITH {_BOXES} SELECT doc_id, cast(floor(top / 8e0) AS bigint) AS bucket, string_agg(text, ' ' ORDER BY x0, word_idx, text) AS text FROM p GROUP BY 1, 2",
    "balance_chain": f"WITH {_chain(_E, 'block_id')} SELECT * EXCLUDE (unread) FROM c",
    "chain_flags": f"""
WITH {_chain(_E, 'block_id')}
SELECT s.block_id, s.seq, CASE WHEN state = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' ELSE 'OK' END AS status,
  CASE WHEN state <> 'NEEDS_REVIEW' THEN ''
       WHEN n = 1 THEN 'Amount ' || {_money('amount')} || ' against a balance change of ' || {_money('closing - opening')} || ': ' || {_money('opening')} || ' before, ' || {_money('closing')} || ' after.'
       ELSE n || ' amounts add up to ' || {_money('move')} || '; from balance ' || {_money('opening')} || ' to balance ' || {_money('closing')} || ' it should be ' || {_money('closing - opening')} || '.' END AS note
FROM s JOIN c ON s.block_id = c.block_id AND s.seg = c.seg""",
    "block_proof": f"""
SELECT block_id, n, total, ending, abs(100 + total - ending) <= 0.01 AS passed,
  '100.00 + ' || {_money('total')} || ' (' || n || ' amounts) = ' || {_money('100 + total')} ||
  CASE WHEN abs(100 + total - ending) <= 0.01 THEN ', as printed at the end.' ELSE ', printed at the end is ' || {_money('ending')} || ', off by ' || {_money('ending - 100 - total')} || '.' END AS detail
FROM (SELECT block_id, count(*) AS n, cast(sum(amount) AS decimal(18,2)) AS total, max(ending) AS ending FROM {_L} GROUP BY block_id)""",
    "hot_account_proof": f"""
WITH l AS (SELECT * FROM {_HOT}), {_chain("l", "block_id")},
k AS (SELECT block_id, max(CASE WHEN state <> 'UNCHECKED' THEN 1 ELSE 0 END) AS checked, cast(sum(CASE WHEN state = 'NEEDS_REVIEW' THEN n ELSE unread END) AS bigint) AS flagged FROM c GROUP BY block_id),
t AS (SELECT block_id, count(*) AS n, cast(sum(amount) AS decimal(18,2)) AS total FROM l GROUP BY block_id)
SELECT block_id, n, total, flagged, CASE WHEN checked = 1 THEN flagged = 0 END AS passed FROM t JOIN k USING (block_id)""",
    "hot_account_flags": f"""
WITH l AS (SELECT * FROM {_HOT}), {_chain("l", 'block_id')}
SELECT s.block_id, s.seq, CASE WHEN state = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' ELSE 'OK' END AS status,
  CASE WHEN state <> 'NEEDS_REVIEW' THEN ''
       WHEN n = 1 THEN 'Amount ' || {_money('amount')} || ' against a balance change of ' || {_money('closing - opening')} || ': ' || {_money('opening')} || ' before, ' || {_money('closing')} || ' after.'
       ELSE n || ' amounts add up to ' || {_money('move')} || '; from balance ' || {_money('opening')} || ' to balance ' || {_money('closing')} || ' it should be ' || {_money('closing - opening')} || '.' END AS note
FROM s JOIN c ON s.block_id = c.block_id AND s.seg = c.seg""",
    "hot_section_fill": f"""
WITH m AS (SELECT block_id, seq, CASE section WHEN 'error' THEN 'x' WHEN 'signup' THEN section WHEN 'view' THEN section END AS mark FROM {_HOT}),
f AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cur FROM m)
SELECT block_id, seq, CASE WHEN cur IN ('signup', 'view') THEN cur ELSE '' END AS section, CASE cur WHEN 'signup' THEN 1 WHEN 'view' THEN -1 END AS section_dir FROM f""",
    "section_totals": f"""
WITH l AS (SELECT * FROM {_L}), a AS (SELECT block_id, sum(amount) AS found FROM l GROUP BY block_id),
t AS (SELECT block_id, 'Deposits and Additions ' || section AS name, sum(amount) + CASE WHEN block_id % 5 = 0 THEN 2 ELSE 0 END AS printed FROM l GROUP BY block_id, section)
SELECT block_id, name, cast(printed AS decimal(18,2)) AS printed, cast(found AS decimal(18,2)) AS found FROM t JOIN a USING (block_id) WHERE abs(found - printed) > 0.01""",
    "document_outcome": f"{_OUTCOME} SELECT * FROM outcome",
    "run_summary": f"{_OUTCOME} SELECT state, count(*) AS documents, cast(CASE state WHEN 'proven' THEN 0 WHEN 'unproven' THEN 1 ELSE 2 END AS int) AS severity FROM outcome GROUP BY state",
    "run_severity": f"{_OUTCOME} SELECT count(*) AS documents, cast(coalesce(max(CASE state WHEN 'proven' THEN 0 WHEN 'unproven' THEN 1 ELSE 2 END), 3) AS int) AS severity FROM outcome",
    "unexpected_states": f"{_OUTCOME} SELECT state, count(*) AS documents FROM outcome WHERE state <> 'proven' GROUP BY state",
    "statements_end_to_end": f"""
WITH l AS (SELECT * FROM {_FLOW}), {_chain("l", "block_id")},
k AS (SELECT block_id, sum(CASE WHEN state = 'NEEDS_REVIEW' THEN n ELSE 0 END) AS flagged FROM c GROUP BY block_id),
n AS (SELECT block_id, count(*) AS rows FROM l GROUP BY block_id)
SELECT block_id AS doc_id, rows, cast(flagged AS bigint) AS flagged, CASE WHEN block_id % 7 <> 0 AND flagged = 0 THEN 'proven' ELSE 'unproven' END AS state,
       CASE WHEN block_id % 7 = 0 THEN 'FAILED' WHEN flagged = 0 THEN 'PASSED' ELSE 'NOT PROVABLE' END AS verdict FROM n JOIN k USING (block_id)""",
    "account_proofs": f"""
WITH l AS (SELECT * FROM {_FLOW}), {_chain("l", "block_id")},
k AS (SELECT block_id, sum(CASE WHEN state = 'NEEDS_REVIEW' THEN n ELSE 0 END) AS flagged FROM c GROUP BY block_id),
n AS (SELECT block_id, count(*) AS rows, cast(sum(amount) AS decimal(18,2)) AS total, max(ending) AS ending FROM l GROUP BY block_id)
SELECT block_id AS doc_id, cast(1 AS bigint) AS block, 'No-' || block_id AS block_name, rows, total, cast(0 AS decimal(18,2)) AS beginning, ending, cast(flagged AS bigint) AS flagged,
       block_id % 7 <> 0 AS passed, true AS complete FROM n JOIN k USING (block_id)""",
    "mixed_statements": f"""
SELECT doc_id, cast(stmt_no AS bigint) AS stmt_no, cast(1 AS bigint) AS block, 'No-' || doc_id AS block_name, CASE doc_id % 3 WHEN 0 THEN 'columns' WHEN 1 THEN 'running' ELSE 'headings' END AS key, cast(70 AS int) AS confidence,
       count(*) AS rows, cast(sum(amount) AS decimal(18,2)) AS total, max(beginning) AS beginning, max(ending) AS ending, cast(0 AS bigint) AS flagged,
       max(ending) = max(beginning) + sum(amount) AS passed, true AS complete FROM {_BUNDLE} GROUP BY doc_id, stmt_no""",
    "mixed_ledger": f"""
SELECT doc_id, cast(stmt_no AS bigint) AS stmt_no, seq AS n, day AS date, amount, CASE WHEN doc_id % 3 = 1 THEN running END AS balance, 'OK' AS status, 'No-' || doc_id AS block_name,
       CASE doc_id % 3 WHEN 0 THEN 'columns' WHEN 1 THEN 'running' ELSE 'headings' END AS key FROM {_BUNDLE}""",
    "mixed_outcomes": f"""
WITH s AS (SELECT doc_id, stmt_no, count(*) AS rows, max(ending) = max(beginning) + sum(amount) AS passed FROM {_BUNDLE} GROUP BY doc_id, stmt_no)
SELECT doc_id, cast(sum(rows) AS bigint) AS rows, cast(0 AS bigint) AS flagged, CASE WHEN min(passed) THEN 'proven' ELSE 'unproven' END AS state, CASE WHEN min(passed) THEN 'PASSED' ELSE 'FAILED' END AS verdict,
       CASE doc_id % 3 WHEN 0 THEN 'columns' WHEN 1 THEN 'running' ELSE 'headings' END AS profile, cast(70 AS int) AS confidence FROM s GROUP BY doc_id""",
    "document_kind": """
SELECT DISTINCT o_custkey * 10 + 1 AS doc_id, 'jobs' AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT DISTINCT l_suppkey * 10 + 2, 'codes' FROM lineitem
UNION ALL SELECT DISTINCT o_custkey * 10 + 3, 'loads' FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT doc_id * 10 + 4, NULL FROM documents""",
    "settlement_route": f"""
WITH {_ROUTED},
f AS (SELECT doc_id, sum(n) AS rows, sum(CASE WHEN status <> 'OK' THEN n ELSE 0 END) AS flagged FROM r GROUP BY doc_id),
p AS (SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN m % 9 <> 0 WHEN 2 THEN m % 3 <> 0 AND m % 5 <> 0 ELSE m % 11 <> 0 AND m % 17 <> 0 AND flagged = 0 END AS passed, rows, flagged FROM (SELECT *, doc_id // 10 AS m FROM f) x)
SELECT doc_id, cast(rows AS bigint) AS rows, cast(flagged AS bigint) AS flagged, CASE WHEN passed THEN 'proven' ELSE 'unproven' END AS state, CASE WHEN passed THEN 'PASSED' ELSE 'FAILED' END AS verdict,
       CASE doc_id % 10 WHEN 1 THEN 'jobs' WHEN 2 THEN 'codes' ELSE 'loads' END AS profile, cast(97 AS int) AS confidence FROM p""",
    "settlement_projection": f"""
WITH {_ROUTED} SELECT doc_id, section, type, status, cast(sum(n) AS bigint) AS n, cast(sum(total) AS decimal(18,2)) AS total, cast(sum(CASE WHEN status <> 'OK' THEN n ELSE 0 END) AS bigint) AS raws,
       cast(sum(customers) AS bigint) AS customers FROM r GROUP BY ALL""",
    "run_info": f"""
WITH s AS (SELECT doc_id, stmt_no, count(*) AS rows, max(ending) = max(beginning) + sum(amount) AS passed, (count(*) * CASE WHEN doc_id % 3 = 2 THEN 3 ELSE 1 END - 1) // 33 + 1 AS pages FROM {_BUNDLE} GROUP BY doc_id, stmt_no)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'columns' WHEN 1 THEN 'running' ELSE 'headings' END AS profile, cast(70 AS int) AS confidence, 'native' AS method, 'n/a' AS ocr_confidence, cast(sum(pages) AS bigint) AS pages,
       cast(sum(rows) AS bigint) AS rows, cast(0 AS bigint) AS to_review, CASE WHEN min(passed) THEN 'proven' ELSE 'unproven' END AS state, CASE WHEN min(passed) THEN 'PASSED' ELSE 'FAILED' END AS verdict,
       CASE WHEN min(passed) THEN 0 ELSE 1 END AS severity FROM s GROUP BY doc_id""",
    "unread_tail": f"""
WITH l AS (SELECT *, event_id % 41 = 0 AS stop FROM {_LINES}), s AS (SELECT doc_id, min(CASE WHEN stop THEN page END) AS stop_page, max(page) AS pages FROM l GROUP BY doc_id),
t AS (SELECT doc_id, bool_or(page > stop_page AND event_type = 'purchase') AS tail, bool_or(stop AND seq = 1) AS at_once FROM l JOIN s USING (doc_id) GROUP BY doc_id)
SELECT doc_id, cast(coalesce(stop_page, pages) AS bigint) AS pages_read, cast(pages AS bigint) AS pages, coalesce(tail, false) OR coalesce(at_once, false) AS incomplete FROM s JOIN t USING (doc_id)""",
    "amount_balance": f"""
WITH l AS (SELECT *, {_PRICE} AS price, l_linenumber % 3 AS k, CASE WHEN l_partkey % 4 = 0 THEN -1 END AS s1, CASE WHEN l_partkey % 5 = 0 THEN -1 END AS s2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, price, CASE WHEN k <> 1 THEN price END AS amount, CASE WHEN k <> 1 THEN s1 END AS sign, CASE WHEN k = 0 THEN cast(300 AS double) END AS column,
       cast(CASE WHEN k = 1 THEN price * coalesce(s1, 1) ELSE (price + 1) * coalesce(s2, 1) END AS decimal(18,2)) AS balance FROM l""",
    "job_rows": f"""
WITH i AS (SELECT o_custkey AS doc_id, o_orderkey AS job, {_PRICE} AS p, l_returnflag = 'R' AS back FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT doc_id, job, sum(p) AS s, coalesce(sum(CASE WHEN back THEN p END), 0) AS given, count(*) AS n, job % 10 = 0 AS bad FROM i GROUP BY doc_id, job),
r AS (SELECT doc_id, 'Job' AS section, 'COD' AS type, 3 AS amount, 0 AS bad FROM j UNION ALL SELECT doc_id, 'Job', 'Total Cost', s + 1000, bad::int FROM j
      UNION ALL SELECT doc_id, 'Job', 'Subtotal', 2 * given + 1000 + bad::int, bad::int FROM j
      UNION ALL SELECT doc_id, 'Job', CASE WHEN back THEN 'Add-back' ELSE 'Deduction' END, CASE WHEN back THEN p ELSE -p END, (job % 10 = 0)::int FROM i
      UNION ALL SELECT doc_id, 'Summary', 'Subtotal', sum(2 * given + 1000 + bad::int), 0 FROM j GROUP BY doc_id UNION ALL SELECT DISTINCT doc_id, 'Summary', 'Adjustment', -5, 0 FROM j
      UNION ALL SELECT doc_id, 'Summary', 'Total', sum(2 * given + 1000 + bad::int) - 5 + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END, 0 FROM j GROUP BY doc_id
      UNION ALL SELECT DISTINCT doc_id, 'Side column', 'Entry', 2, 0 FROM j UNION ALL SELECT DISTINCT doc_id, 'Notes', 'Balance', 4, 0 FROM j)
SELECT doc_id, section, type, count(*) AS n, cast(sum(amount) AS decimal(18,2)) AS total, cast(sum(bad) AS bigint) AS flagged FROM r GROUP BY doc_id, section, type""",
    "job_settlement": f"""
WITH j AS (SELECT o_custkey AS doc_id, o_orderkey AS job, 2 * coalesce(sum(CASE WHEN l_returnflag = 'R' THEN {_PRICE} END), 0) + 1000 + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS net
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT doc_id, count(*) AS jobs, cast(sum(net) AS decimal(18,2)) AS nets, true AS jobs_ok, doc_id % 9 <> 0 AS pay_ok, doc_id % 9 <> 0 AS passed FROM j GROUP BY doc_id""",
    "coded_report": """
WITH s AS (SELECT l_suppkey AS doc_id, count(*) AS rows, count(DISTINCT l_returnflag) AS codes FROM lineitem GROUP BY 1)
SELECT doc_id, rows, codes, cast(1 AS bigint) AS reports, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN codes ELSE 0 END AS mismatches, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS passed,
       codes AS sections, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN rows ELSE 0 END AS flagged FROM s""",
    "load_settlement": f"""
WITH i AS (SELECT o_custkey AS doc_id, o_orderkey AS job, cast(o_totalprice AS decimal(18,2)) AS net, {_PRICE} AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT doc_id, job, max(net) AS net, max(net) + sum(p) + CASE WHEN job % 13 = 0 THEN 1 ELSE 0 END AS t FROM i GROUP BY doc_id, job),
r AS (SELECT doc_id, 'order' AS section, 'Gross Pay' AS type, job, net * 2 AS amount, 0 AS bad FROM o UNION ALL SELECT doc_id, 'order', 'Net Pay', job, net, 0 FROM o
      UNION ALL SELECT doc_id, 'order', 'Earning', job, p, 0 FROM i UNION ALL SELECT doc_id, 'order', 'Order Total', job, t, (job % 13 = 0)::int FROM o
      UNION ALL SELECT DISTINCT doc_id, 'driver', 'Deduction', NULL::bigint, -20, 0 FROM o UNION ALL SELECT DISTINCT doc_id, 'driver', 'Subtotal', NULL::bigint, -20, 0 FROM o
      UNION ALL SELECT DISTINCT doc_id, 'pay_summary', 'Total', NULL::bigint, 7, 0 FROM o UNION ALL SELECT DISTINCT doc_id, 'dispatch', 'Information', NULL::bigint, 0, 0 FROM o)
SELECT doc_id, section, type, count(*) AS n, count(DISTINCT job) AS orders, cast(sum(amount) AS decimal(18,2)) AS total, cast(sum(bad) AS bigint) AS flagged FROM r GROUP BY doc_id, section, type""",
    "code_totals": f"""
WITH r AS (SELECT *, (seq - 1) // 10 AS seg FROM {_CODES}),
g AS (SELECT doc_id, cast(seg AS bigint) AS seg, count(amount) AS n, cast(coalesce(sum(amount), 0) AS decimal(18,2)) AS total, max(printed_n) AS printed_n, max(printed_sum) AS printed_sum FROM r GROUP BY doc_id, seg)
SELECT *, CASE WHEN n <> printed_n THEN 'count' WHEN abs(total - printed_sum) > 0.01 THEN 'sum' END AS mismatch FROM g WHERE printed_n IS NOT NULL""",
    "job_chain": f"WITH {_chain(_JOBS, 'job_id')} SELECT * EXCLUDE (unread) FROM c",
    "job_proof": f"""
WITH r AS (SELECT * FROM {_JOBS}),
last AS (SELECT job_id, max(CASE WHEN balance IS NOT NULL THEN seq END) AS last_seq, arg_max(balance, CASE WHEN balance IS NOT NULL THEN seq END) AS sub FROM r GROUP BY job_id),
nets AS (SELECT r.doc_id, r.job_id, coalesce(max(sub), max(beginning)) + coalesce(sum(CASE WHEN last_seq IS NULL OR seq > last_seq THEN amount END), 0) AS net, max(beginning) + sum(amount) AS true_net FROM r JOIN last USING (job_id) GROUP BY r.doc_id, r.job_id),
d AS (SELECT doc_id, count(*) AS jobs, cast(sum(net) AS decimal(18,2)) AS nets, sum(true_net) AS total FROM nets GROUP BY doc_id)
SELECT doc_id, jobs, nets, abs(nets - total) <= 0.01 AS jobs_ok, doc_id % 9 <> 0 AS pay_ok, abs(nets - total) <= 0.01 AND doc_id % 9 <> 0 AS passed FROM d""",
    "order_pay_proof": """
SELECT o_orderkey AS order_id, t AS found, cast(t + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS decimal(18,2)) AS printed, o_orderkey % 13 <> 0 AS ok
FROM (SELECT o_orderkey, cast(max(cast(o_totalprice AS decimal(18,2))) + sum(cast(l_extendedprice AS decimal(18,2))) AS decimal(18,2)) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)""",
    "cross_foot": """
SELECT c_custkey, true AS orders_ok, true AS driver_net_ok, c_custkey % 10 <> 0 AS summary_ok, true AS gross_ok,
       CASE WHEN c_custkey % 17 <> 0 THEN true END AS net_pay_ok, CASE WHEN c_custkey % 17 <> 0 THEN c_custkey % 10 <> 0 END AS passed FROM customer""",
    "section_subtotals": f"""
SELECT l_suppkey AS doc_id, l_returnflag AS section, cast(sum({_PRICE}) AS decimal(18,2)) AS found, count(*) AS n,
       cast(sum({_PRICE}) + CASE WHEN count(*) % 4 = 0 THEN 1 ELSE 0 END AS decimal(18,2)) AS printed, count(*) % 4 <> 0 AS ok FROM lineitem GROUP BY 1, 2""",
    "escrow_rollforward": """
WITH e AS (SELECT user_id AS doc_id, cast(ts AS date) AS account, event_type AS t, cast(value AS decimal(18,2)) AS v FROM events),
w AS (SELECT doc_id, account, cast(coalesce(sum(CASE WHEN t = 'error' THEN v END), 0) AS decimal(18,2)) AS previous,
        cast(coalesce(sum(CASE WHEN t IN ('click', 'signup') THEN v END), 0) AS decimal(18,2)) AS deposits,
        cast(coalesce(sum(CASE WHEN t = 'purchase' THEN -v END), 0) AS decimal(18,2)) AS withdrawals,
        cast(coalesce(sum(CASE WHEN t = 'view' THEN v END), 0) AS decimal(18,2)) AS "new" FROM e GROUP BY 1, 2)
SELECT *, cast(previous + deposits + withdrawals AS decimal(18,2)) AS expected, abs(previous + deposits + withdrawals - "new") <= 0.01 AS ok FROM w""",
    "printed_vs_captured": f"""
SELECT DISTINCT doc_id, value FROM (SELECT doc_id, unnest({_FIGURES}) AS value FROM documents) WHERE doc_id % 2 = 1""",
    "golden_compare": f"""
SELECT block_id, seq, CASE WHEN seq % 101 = 0 THEN 'missing' ELSE 'changed' END AS side, CASE WHEN seq % 101 = 0 THEN '' ELSE 'amount' END AS fields
FROM {_E} WHERE seq % 101 = 0 OR (seq % 103 = 0 AND amount IS NOT NULL)""",
    "bank_projection": f"""
WITH t AS (SELECT *, cast(CASE WHEN block_id % 3 = 0 THEN -amount ELSE amount END AS decimal(18,2)) AS a FROM {_E})
SELECT 'events' AS source, 'Bank' AS institution, CASE WHEN block_id % 4 = 0 THEN '0000' ELSE 'Acct ' || block_id END AS account, day AS date, section || ' ' || seq AS description,
       CASE WHEN a IS NULL THEN '' WHEN a >= 0 THEN 'Credit' ELSE 'Debit' END AS type, a AS amount, balance,
       CASE WHEN amount IS NULL THEN 'NEEDS_REVIEW' ELSE 'OK' END AS status, '' AS note, CASE WHEN amount IS NULL THEN section END AS raw FROM t""",
    "row_scan": f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 < 3 THEN cast(month(l_shipdate) AS int) END AS m, CASE WHEN l_linenumber % 4 < 3 THEN cast(day(l_shipdate) AS int) END AS d,
       l_linenumber % 4 = 1 AS second, CASE l_linenumber % 4 WHEN 2 THEN 2 ELSE 1 END AS n, {_PRICE} AS value, CASE WHEN l_linenumber % 4 IN (1, 2) THEN -1 END AS sign,
       CASE l_linenumber % 4 WHEN 0 THEN 'Card shop' WHEN 1 THEN 'REF123 shop' WHEN 2 THEN 'shop' ELSE 'no date' END AS description FROM lineitem""",
    "section_fill": f"""
WITH m AS (SELECT *, CASE WHEN event_type = 'error' THEN 'x' WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'c' ELSE 'd' END END AS mark FROM {_LINES}),
f AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cur FROM m)
SELECT doc_id, seq, CASE cur WHEN 'c' THEN 'Deposits and other credits' WHEN 'd' THEN 'Checks and DEBITS' ELSE '' END AS section, CASE cur WHEN 'c' THEN 1 WHEN 'd' THEN -1 END AS section_dir FROM f""",
    "stop_resume": f"""
WITH l AS (SELECT *, event_id % 41 = 0 AS stop, event_id % 29 = 0 AND doc_id % 2 = 0 AS resume FROM {_LINES}),
r AS (SELECT doc_id, max(page) AS resume_page FROM l WHERE resume GROUP BY doc_id),
s AS (SELECT l.doc_id, min(seq) AS stop_seq, min(page) AS stop_page FROM l LEFT JOIN r USING (doc_id) WHERE stop AND NOT coalesce(resume_page > page, false) GROUP BY l.doc_id)
SELECT l.doc_id, count(*) AS n, max(seq) AS last, coalesce((SELECT bool_or(x.page > s2.stop_page AND x.event_type = 'purchase') FROM l x JOIN s s2 USING (doc_id) WHERE x.doc_id = l.doc_id), false) AS incomplete
FROM l LEFT JOIN s USING (doc_id) WHERE stop_seq IS NULL OR seq < stop_seq GROUP BY l.doc_id""",
    "wrapped_rows": f"""
WITH a AS (SELECT *, sum(CASE WHEN kind IN ('R','N','C') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS anc, lead(kind) OVER (PARTITION BY doc_id ORDER BY seq) AS nk FROM {_LINES}),
b AS (SELECT *, max(CASE WHEN kind = 'R' OR (kind = 'N' AND nk = 'M') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, anc) AS ok FROM a WHERE kind <> 'T')
SELECT doc_id, min(seq) AS anchor, count(*) AS lines, string_agg(text, ' ' ORDER BY seq) AS description, arg_min(value, seq) FILTER (WHERE kind IN ('R', 'M')) AS amount
FROM b WHERE ok = 1 GROUP BY doc_id, anc""",
    "sign_resolution": f"""
WITH l AS (SELECT *, event_id % 7 = 0 AS ex, CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 11 = 0 THEN -1 ELSE 0 END AS col, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 13 = 0 THEN -1 ELSE 0 END AS sec,
        CASE event_type WHEN 'purchase' THEN -1 WHEN 'signup' THEN 1 ELSE 0 END AS wd FROM {_LINES}),
s AS (SELECT *, CASE WHEN ex THEN 'explicit' WHEN col = 1 THEN 'column:credit' WHEN col = -1 THEN 'column:debit' WHEN doc_id % 2 = 0 AND sec <> 0 THEN 'section' WHEN wd <> 0 THEN 'row-words'
        WHEN sec <> 0 THEN 'section' WHEN doc_id % 5 = 0 THEN 'default' ELSE 'unknown' END AS sign_source FROM l),
t AS (SELECT *, CASE sign_source WHEN 'column:credit' THEN 1 WHEN 'column:debit' THEN -1 WHEN 'section' THEN sec WHEN 'row-words' THEN wd WHEN 'default' THEN -1 ELSE 0 END AS dir FROM s)
SELECT doc_id, seq, cast(CASE WHEN sign_source = 'explicit' THEN CASE WHEN doc_id % 3 = 0 THEN value ELSE -value END WHEN dir = 0 THEN value
         ELSE abs(value) * CASE WHEN doc_id % 3 = 0 THEN -dir ELSE dir END END AS decimal(18,2)) AS signed, sign_source,
       CASE WHEN sign_source = 'unknown' THEN 'NEEDS_REVIEW' ELSE 'OK' END AS status,
       CASE WHEN sign_source = 'unknown' THEN 'Nothing tells whether ' || value || ' is a credit or a debit.' ELSE '' END AS note FROM t""",
    "card_summary_charges": f"""
WITH s AS (SELECT doc_id, seq, CASE WHEN event_id % 2 = 0 THEN 'Interest' ELSE 'Fees' END AS charge, CASE WHEN event_id % 9 = 0 THEN 0 ELSE value END AS amount FROM {_LINES} WHERE event_type = 'view' AND event_id % 4 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, charge ORDER BY seq) AS r FROM s),
named AS (SELECT DISTINCT doc_id FROM {_LINES} WHERE event_type = 'purchase' AND event_id % 50 = 0)
SELECT doc_id, date '2024-01-31' AS date, charge || ' charged' AS description, cast(amount AS decimal(18,2)) AS amount FROM f
WHERE r = 1 AND amount <> 0 AND NOT (charge = 'Interest' AND doc_id IN (SELECT doc_id FROM named))""",
    "incremental_ingest": "SELECT user_id, count(*) AS n, cast(sum(cast(value AS decimal(18,2))) AS decimal(18,2)) AS total FROM events GROUP BY user_id",
    "account_blocks": f"""
WITH l AS (SELECT *, event_type = 'signup' AS b, event_id % 3 <> 0 AS v FROM {_LINES}),
p AS (SELECT doc_id, seq, coalesce(lag(seq) OVER (PARTITION BY doc_id ORDER BY seq), 0) AS prev, lag(v) OVER (PARTITION BY doc_id ORDER BY seq) AS prev_v FROM l WHERE b),
o AS (SELECT doc_id, seq FROM p WHERE coalesce(prev_v, false) OR EXISTS (SELECT 1 FROM l WHERE l.doc_id = p.doc_id AND l.seq > p.prev AND l.seq < p.seq AND l.event_type = 'purchase'))
SELECT l.doc_id, l.seq, 1 + (SELECT count(*) FROM o WHERE o.doc_id = l.doc_id AND o.seq <= l.seq) AS block_no FROM l""",
    "printed_balances": f"""
WITH e AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM {_LINES}),
f AS (SELECT doc_id, page, event_type, first(v ORDER BY seq) AS a, last(v ORDER BY seq) AS z FROM e WHERE v IS NOT NULL GROUP BY ALL)
SELECT d.doc_id, d.page, coalesce(s.a, c.a) AS beginning, coalesce(x.z, w.a) AS ending FROM (SELECT DISTINCT doc_id, page FROM e) d
LEFT JOIN f s ON s.doc_id = d.doc_id AND s.page = d.page AND s.event_type = 'signup' LEFT JOIN f c ON c.doc_id = d.doc_id AND c.page = d.page AND c.event_type = 'click'
LEFT JOIN f x ON x.doc_id = d.doc_id AND x.page = d.page AND x.event_type = 'error' LEFT JOIN f w ON w.doc_id = d.doc_id AND w.page = d.page AND w.event_type = 'view'""",
    "section_total_lines": """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Checks paid' WHEN 1 THEN o_orderpriority || ' orders' END AS name,
       CASE WHEN o_orderkey % 3 < 2 THEN cast(o_totalprice AS decimal(18,2)) END AS amount FROM orders""",
    "native_pages": """
SELECT page_id // 5 AS doc_id, cast(coalesce(sum(length(html)), 0) AS bigint) AS chars, count(*) AS pages,
       coalesce(sum(length(html)), 0) >= 10000 * greatest(1, count(*) // 3) AS is_native FROM pages GROUP BY 1""",
    "statement_split_pages": r"""
SELECT doc_id, page_id AS page, cast(sum(CASE WHEN page_id % 5 = 0 OR first OR inside THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_id) AS bigint) AS stmt_no
FROM (SELECT page_id, page_id // 12 AS doc_id, row_number() OVER (PARTITION BY page_id // 12 ORDER BY page_id) = 1 AS first,
        coalesce(regexp_matches(html, 'page\s*1\s*of\s*[0-9]+', 'i'), false) AS inside FROM pages)""",
    "printed_vs_altered": f"""
WITH f AS (SELECT doc_id, unnest(f) AS value, generate_subscripts(f, 1) AS i FROM (SELECT doc_id, {_FIGURES} AS f FROM documents)),
h AS (SELECT doc_id, CASE WHEN i % 3 = 1 THEN value + 1000000 ELSE value END AS value FROM f UNION SELECT doc_id, 1.00 FROM f)
SELECT DISTINCT doc_id, value FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = f.doc_id AND h.value = f.value)""",
    "cross_foot_parts": """
SELECT c_custkey, c_custkey % 7 <> 0 AS earnings_ok, true AS gross_ok, c_custkey % 11 <> 0 AS deductions_ok, c_custkey % 13 <> 0 AS reimbursements_ok, true AS net_pay_ok,
       c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AS passed FROM customer""",
    "report_totals": """
WITH s AS (SELECT l_suppkey AS doc_id, count(*) AS rows FROM lineitem GROUP BY 1),
p AS (SELECT *, CASE WHEN doc_id % 11 <> 0 THEN 1 ELSE 0 END AS codes, CASE WHEN doc_id % 7 <> 0 THEN 1 ELSE 0 END AS reports FROM s),
m AS (SELECT *, CASE WHEN reports = 1 AND (doc_id % 5 = 0 OR doc_id % 3 = 0) THEN 1 ELSE 0 END AS mismatches FROM p)
SELECT doc_id, rows, cast(codes AS bigint) AS codes, cast(reports AS bigint) AS reports, cast(mismatches AS bigint) AS mismatches,
       CASE WHEN codes + reports > 0 THEN mismatches = 0 AND codes = 1 AND reports = 1 END AS passed FROM m""",
}
