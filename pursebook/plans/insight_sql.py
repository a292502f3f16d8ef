"""DuckDB SQL for the queries over orders, written independently of the DataFrame code.

Only the mapping of the driver's tables to ledger columns is shared text."""

from __future__ import annotations

from pursebook.plans.ledger_sql import ORACLE_SQL as LEDGER_SQL
from pursebook.sources.adapters import BOOK_COLUMNS, BOOK_TODAY, BUDGET_COLUMNS, OPENING_PAISA, PART_COLUMNS, RULES, SALES_COLUMNS, SAVED_FILTERS, SUPPLIER_RULES, TRANSACTION_COLUMNS

_columns = lambda c: ", ".join(f"{e} AS {n}" for n, e in c.items())
_B = f"b AS (SELECT {_columns(BOOK_COLUMNS)} FROM orders)"
_LOCAL = "(occurred_at + INTERVAL '345' MINUTE)"
_SIGN = "CASE WHEN direction = 'CREDIT' THEN amount_paisa ELSE -amount_paisa END"
_M = f"m AS (SELECT user_id, category_id, currency, CAST(date_trunc('month', {_LOCAL}) AS DATE) AS month, sum(amount_paisa) FILTER (direction = 'DEBIT') AS s FROM b WHERE NOT excluded_from_spend GROUP BY ALL)"
_CHAIN = f"""r AS (SELECT *, CAST(sum({_SIGN}) OVER (PARTITION BY account_id ORDER BY occurred_at, id) AS BIGINT) + {OPENING_PAISA} AS bal FROM b),
 c AS (SELECT account_id, id, occurred_at, {_SIGN} AS s, CASE WHEN id % 5 <> 0 THEN bal END AS bal FROM r WHERE id % 97 <> 0)"""
_AT = """k AS (SELECT i.account_id, instant, arg_max(struct_pack(b := bal, t := c.occurred_at, i := c.id), (c.occurred_at, c.id)) FILTER (bal IS NOT NULL) AS a FROM i LEFT JOIN c ON c.account_id = i.account_id AND c.occurred_at <= i.instant GROUP BY 1, 2),
 z AS (SELECT k.account_id, k.instant, any_value(a) AS a, coalesce(sum(s), 0) AS moved, count(s) AS n FROM k LEFT JOIN c ON c.account_id = k.account_id AND c.occurred_at <= k.instant AND (c.occurred_at, c.id) > (k.a.t, k.a.i) GROUP BY 1, 2)
SELECT account_id, instant, CAST(a.b + moved AS BIGINT) AS balance_paisa, a.t AS known_at, CAST(CASE WHEN a IS NOT NULL THEN n END AS BIGINT) AS rolled FROM z"""
_CAT = """cat AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey + 100 AS parent_id, CAST(NULL AS BOOLEAN) AS is_spend FROM nation
 UNION ALL SELECT r_regionkey + 100, r_name, NULL, r_regionkey <> 4 FROM region)"""
_PARTS = f"""q AS (SELECT {_columns(PART_COLUMNS)} FROM lineitem WHERE l_orderkey % 3 <> 0),
 w AS (SELECT q.*, b.amount_paisa AS amount, CASE WHEN max(weight) OVER x > 0 THEN weight ELSE 1 END AS v FROM q JOIN b ON b.id = q.txn_id WINDOW x AS (PARTITION BY txn_id)),
 y AS (SELECT *, sum(v) OVER (PARTITION BY txn_id) AS total, CAST(amount AS HUGEINT) * v AS exact FROM w),
 u AS (SELECT *, exact // total AS base, row_number() OVER (PARTITION BY txn_id ORDER BY exact % total DESC, part_no, category_id, v DESC) AS rank FROM y),
 p AS (SELECT txn_id, part_no, category_id, CAST(base + CASE WHEN rank <= amount - sum(base) OVER (PARTITION BY txn_id) THEN 1 ELSE 0 END AS BIGINT) AS paisa FROM u),
 sp AS (SELECT b.* REPLACE (p.category_id AS category_id, paisa AS amount_paisa), p.part_no FROM b JOIN p ON p.txn_id = b.id WHERE paisa > 0
        UNION ALL SELECT b.*, NULL FROM b WHERE id NOT IN (SELECT txn_id FROM p))"""
_LOST = "SELECT b.id, any_value(b.amount_paisa) AS amount_paisa, CAST(sum(s.amount_paisa) AS BIGINT) AS parts_paisa"

_T = f"t AS (SELECT {_columns(TRANSACTION_COLUMNS)} FROM events)"
_SR = f"sr AS (SELECT {_columns(SUPPLIER_RULES)} FROM supplier)"
_RULE = lambda text, of: "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}', 'i') THEN {(i, c)[of]}" for i, (_, p, c) in enumerate(RULES)) + " END"
_FILTERS = {c: e.replace("array(o_custkey)", "[o_custkey]").replace("array()", "[]") for c, e in SAVED_FILTERS.items()}

ORACLE_SQL = {
    "top_merchants": f"""
WITH s AS (SELECT {_columns(SALES_COLUMNS)} FROM lineitem),
 g AS (SELECT user_id, currency, CAST(date_trunc('month', {_LOCAL}) AS DATE) AS month, merchant, CAST(sum(amount_paisa) AS BIGINT) AS spent_paisa, count(*) AS txn_count FROM s
       WHERE direction = 'DEBIT' AND NOT excluded_from_spend AND merchant IS NOT NULL GROUP BY ALL)
SELECT *, CAST(rank() OVER (PARTITION BY user_id, currency, month ORDER BY spent_paisa DESC) AS INTEGER) AS rank FROM g QUALIFY rank <= 20
""",
    "rule_match_bulk": LEDGER_SQL["rule_match_first"],
    "implied_rules": f"""
WITH {_T}, e AS (SELECT user_id, trim(description_raw) AS d, id, category_id, CASE WHEN id % 5 <> 0 THEN id % 12 END AS n FROM t WHERE id % 2 = 0),
 g AS (SELECT user_id, d AS description_raw, arg_max(n, id) AS category_id, count(*) AS n_edits, count(DISTINCT n) AS n_categories FROM e WHERE n IS NOT NULL AND n IS DISTINCT FROM category_id AND d <> '' GROUP BY 1, 2)
SELECT user_id, description_raw, CAST(category_id AS INTEGER) AS category_id, n_edits, n_categories, CAST(CASE WHEN {_RULE('description_raw', 1)} <> category_id THEN {_RULE('description_raw', 0)} END AS INTEGER) AS against_rule FROM g
""",
    "saved_filter_counts": f"""
WITH f AS (SELECT {', '.join(f'{e} AS "{c}"' for c, e in _FILTERS.items())} FROM orders)
SELECT id, CAST((coalesce(trim(search), '') <> '')::INT + (start IS NOT NULL OR "end" IS NOT NULL)::INT + coalesce(len(category_ids) > 0, FALSE)::INT + coalesce(len(account_ids) > 0, FALSE)::INT + (direction IS NOT NULL)::INT + (status IS NOT NULL)::INT
 + coalesce(transfers <> 'shown', FALSE)::INT + (min_paisa IS NOT NULL OR max_paisa IS NOT NULL)::INT + coalesce(uncategorized_only, FALSE)::INT AS INTEGER) AS active FROM f
""",
    "edited_supplier_rules": f"""
WITH {_SR} SELECT id, priority, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE pattern END AS pattern, coalesce(c_nationkey, category_id) AS category_id
FROM sr LEFT JOIN (FROM customer WHERE c_custkey % 7 = 0) ON c_custkey = id WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0)
""",
    "repointed_supplier_rules": f"WITH {_SR} SELECT id, priority, pattern, coalesce(n_regionkey + 100, category_id) AS category_id FROM sr LEFT JOIN (FROM nation WHERE n_nationkey % 2 = 0) ON n_name = pattern",
    "span_labels_by_time": """
WITH x AS (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS moment FROM orders),
 y AS (SELECT *, greatest(CAST(floor((epoch(TIMESTAMP '1999-01-01 10:30:00') - epoch(moment)) / 86400) AS BIGINT), 0) AS n FROM x)
SELECT o_orderkey, strftime(moment, '%Y-%m-%d') || ' (' || CASE WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'about 1 day back' WHEN n < 14 THEN 'about ' || n || ' days back' WHEN n < 70 THEN 'about ' || CAST(round_even(n / 7.0, 0) AS INTEGER) || ' weeks back'
 WHEN n < 400 THEN 'about ' || CAST(round_even(n / 30.0, 0) AS INTEGER) || ' months back' ELSE 'about ' || printf('%.1f', n / 365.0) || ' years back' END || ')' AS label FROM y
""",
    "foreign_card_mails": f"""
WITH {_T} SELECT 'm' || id AS message_id, 'nabil.card_txn' AS template_key, CAST(1 AS INTEGER) AS parser_version, amount_paisa, ['USD', 'EUR', 'INR', 'JPY', 'NPR'][id % 5 + 1] AS currency, 'SHOP ' || id % 9 AS counterparty, 'SHOP ' || id % 9 || '; CITY' AS description_raw
FROM t WHERE id % 4 <> 0
""",
    "payment_mails": f"""
WITH {_T}, x AS (SELECT *, id % 7 <> 0 AS ours, id % 10 <> 0 AS legible FROM t)
SELECT 'm' || id AS message_id, CASE WHEN NOT ours THEN 'IGNORED' WHEN legible THEN 'PARSED' ELSE 'FAILED' END AS status, CASE WHEN NOT ours THEN 'no parser matched' WHEN NOT legible THEN 'esewa.payment_success: body did not match the expected shape' END AS error,
 CASE WHEN ours THEN date_trunc('second', occurred_at) END AS occurred_at, CASE WHEN ours THEN 'DEBIT' END AS direction, CASE WHEN ours AND legible THEN amount_paisa END AS amount_paisa, CASE WHEN ours THEN 'P' || id END AS reference,
 CASE WHEN ours THEN 'Shop ' || id % 13 END AS counterparty, CASE WHEN ours THEN 'WALLET_PAYMENT' END AS channel, CASE WHEN ours THEN 'esewa:P' || id END AS dedupe_key FROM x
""",
    "recurring_series": f"""
WITH RECURSIVE {_B},
 d AS (SELECT user_id, merchant, currency, CAST({_LOCAL} AS DATE) AS day, CAST(sum(amount_paisa) AS BIGINT) AS a FROM b WHERE direction = 'DEBIT' AND NOT excluded_from_spend AND merchant IS NOT NULL GROUP BY ALL),
 n AS (SELECT x.user_id, x.merchant, x.currency, x.day, min(y.day) AS nxt FROM d x JOIN d y USING (user_id, merchant, currency)
       WHERE y.day - x.day BETWEEN 28 AND 31 AND 100 * abs(y.a - x.a) <= 25 * x.a GROUP BY ALL),
 l AS (SELECT user_id, merchant, currency, nxt, max(day) AS prev FROM n GROUP BY ALL),
 c AS (SELECT user_id, merchant, currency, day AS head, day, a FROM d ANTI JOIN (SELECT user_id, merchant, currency, nxt AS day FROM l) USING (user_id, merchant, currency, day)
       UNION ALL SELECT c.user_id, c.merchant, c.currency, head, d.day, d.a FROM c JOIN l ON l.user_id = c.user_id AND l.merchant = c.merchant AND l.currency = c.currency AND l.prev = c.day
        JOIN d ON d.user_id = c.user_id AND d.merchant = c.merchant AND d.currency = c.currency AND d.day = l.nxt)
SELECT user_id, merchant, currency, head AS first_day, max(day) AS last_day, count(*) AS n, list_sort(list(a))[(count(*) - 1) // 2 + 1] AS median_paisa FROM c GROUP BY ALL HAVING count(*) >= 3
""",
    "budget_report": f"""
WITH {_B}, {_M},
 g AS (SELECT {_columns(BUDGET_COLUMNS)} FROM orders WHERE o_orderkey % 40 IN (1, 2, 3, 4, 5)),
 o AS (SELECT user_id, category_id, currency, date_trunc('month', month) AS month, id, limit_paisa FROM g WHERE month IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY user_id, category_id, currency, date_trunc('month', month) ORDER BY id DESC) = 1),
 f AS (SELECT user_id, category_id, currency, date_trunc('month', valid_from) AS since, id, limit_paisa FROM g WHERE month IS NULL
       QUALIFY row_number() OVER (PARTITION BY user_id, category_id, currency, date_trunc('month', valid_from) ORDER BY id DESC) = 1),
 k AS (SELECT user_id, category_id, currency, coalesce(min(month), date_trunc('month', DATE '{BOOK_TODAY}')) AS a
       FROM (SELECT user_id, category_id, currency, month FROM m WHERE s IS NOT NULL UNION ALL SELECT user_id, category_id, currency, month FROM o UNION ALL SELECT user_id, category_id, currency, since FROM f) GROUP BY ALL),
 e AS (SELECT user_id, category_id, currency, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), TIMESTAMP '{BOOK_TODAY[:8]}01', INTERVAL '1' MONTH)) AS DATE) AS month FROM k),
 r AS (SELECT e.*, coalesce(m.s, 0) AS spent, o.id IS NOT NULL AS is_override, o.limit_paisa AS over,
        (SELECT f.limit_paisa FROM f WHERE f.user_id = e.user_id AND f.currency = e.currency AND f.category_id IS NOT DISTINCT FROM e.category_id AND (f.since IS NULL OR f.since <= e.month) ORDER BY f.since DESC NULLS LAST LIMIT 1) AS dflt
       FROM e LEFT JOIN m ON m.user_id = e.user_id AND m.currency = e.currency AND m.category_id IS NOT DISTINCT FROM e.category_id AND m.month = e.month
       LEFT JOIN o ON o.user_id = e.user_id AND o.currency = e.currency AND o.category_id IS NOT DISTINCT FROM e.category_id AND o.month = e.month)
SELECT user_id, category_id, currency, month, CAST(spent AS BIGINT) AS spent_paisa, CASE WHEN is_override THEN over ELSE dflt END AS limit_paisa, is_override,
       CAST(CASE WHEN is_override THEN over ELSE dflt END - spent AS BIGINT) AS rest_paisa FROM r
""",
    "balances_at_month_ends": f"""
WITH {_B}, {_CHAIN},
 v AS (SELECT account_id, unnest(generate_series(date_trunc('month', min({_LOCAL})), date_trunc('month', max({_LOCAL})), INTERVAL '1' MONTH)) AS month FROM c GROUP BY 1),
 i AS (SELECT account_id, CAST(month AS TIMESTAMP) + INTERVAL '1' MONTH - INTERVAL '345' MINUTE - INTERVAL '1' MICROSECOND AS instant FROM v),
 {_AT}
""",
    "balances_now": f"WITH {_B}, {_CHAIN}, i AS (SELECT DISTINCT account_id, TIMESTAMP '{BOOK_TODAY}' AS instant FROM c), {_AT}",
    "cumulative_burn": f"""
WITH {_B},
 d AS (SELECT user_id, currency, CAST({_LOCAL} AS DATE) AS day, coalesce(sum(amount_paisa) FILTER (direction = 'DEBIT'), 0) AS s FROM b WHERE NOT excluded_from_spend AND CAST({_LOCAL} AS DATE) <= DATE '{BOOK_TODAY}' GROUP BY ALL),
 s AS (SELECT user_id, currency, date_trunc('month', min(day)) AS a FROM d GROUP BY ALL),
 g AS (SELECT user_id, currency, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), TIMESTAMP '{BOOK_TODAY}', INTERVAL '1' DAY)) AS DATE) AS day FROM s),
 r AS (SELECT g.user_id, g.currency, g.day, CAST(sum(coalesce(s, 0)) OVER (PARTITION BY g.user_id, g.currency, date_trunc('month', g.day) ORDER BY g.day) AS BIGINT) AS c FROM g LEFT JOIN d USING (user_id, currency, day))
SELECT x.user_id, x.currency, x.day, x.c AS spent_paisa, y.c AS last_month_paisa, x.c - y.c AS difference_paisa
FROM r x LEFT JOIN r y ON y.user_id = x.user_id AND y.currency = x.currency AND y.day = CAST(x.day - INTERVAL '1' MONTH AS DATE)
""",
    "category_changes": f"""
WITH {_B}, {_M}, {_CAT},
 c2 AS (SELECT c.id, c.name AS leaf, coalesce(p.name, c.name) AS grp, coalesce(p.is_spend, c.is_spend, TRUE) AS spend FROM cat c LEFT JOIN cat p ON p.id = c.parent_id),
 n AS (SELECT user_id, currency, month, CASE WHEN coalesce(spend, TRUE) THEN 'spend' ELSE 'excluded' END AS side, coalesce(grp, 'Uncategorized') AS grp, coalesce(leaf, 'Uncategorized') AS leaf, s FROM m LEFT JOIN c2 ON c2.id = m.category_id WHERE s > 0),
 f AS (SELECT user_id, currency, month, side, grp AS group_name, leaf AS leaf_name, sum(s) AS s, grouping(leaf) AS is_group FROM n GROUP BY user_id, currency, month, side, GROUPING SETS ((grp, leaf), (grp))),
 k AS (SELECT user_id, currency, side, group_name, leaf_name, is_group, CAST(min(month) AS TIMESTAMP) AS a, least(max(month) + INTERVAL '1' MONTH, TIMESTAMP '{BOOK_TODAY[:8]}01') AS z FROM f GROUP BY ALL),
 g AS (SELECT user_id, currency, side, group_name, leaf_name, is_group, CAST(unnest(generate_series(a, z, INTERVAL '1' MONTH)) AS DATE) AS month FROM k),
 r AS (SELECT g.*, CAST(coalesce(s, 0) AS BIGINT) AS s FROM g LEFT JOIN f ON f.user_id = g.user_id AND f.currency = g.currency AND f.side = g.side AND f.group_name = g.group_name AND f.leaf_name IS NOT DISTINCT FROM g.leaf_name AND f.month = g.month),
 t AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY user_id, currency, side, group_name, leaf_name, is_group ORDER BY month), 0) AS before, sum(s) OVER (PARTITION BY user_id, currency, month, side, is_group) AS total FROM r)
SELECT user_id, currency, month, side, group_name, leaf_name, s AS spent_paisa, before AS previous_paisa, s - before AS change_paisa, CAST(CASE WHEN side = 'spend' AND total > 0 THEN CAST(s AS HUGEINT) * 10000 // total END AS BIGINT) AS share_bp FROM t
""",
    "split_transactions": f"WITH {_B}, {_PARTS} SELECT id, part_no, category_id, amount_paisa FROM sp",
    "split_monthly_spend": f"""
WITH {_B}, {_PARTS}
SELECT user_id, date_trunc('month', {_LOCAL}) AS month, category_id, currency, CAST(sum(amount_paisa) FILTER (direction = 'DEBIT') AS BIGINT) AS spent_paisa,
 CAST(sum(amount_paisa) FILTER (direction = 'CREDIT') AS BIGINT) AS received_paisa, count(*) AS txn_count FROM sp WHERE NOT excluded_from_spend GROUP BY ALL
""",
    "split_violations": f"""
WITH {_B}, {_PARTS}
{_LOST}, 'all' AS "of" FROM b LEFT JOIN sp s ON s.id = b.id GROUP BY b.id HAVING sum(s.amount_paisa) IS DISTINCT FROM any_value(b.amount_paisa)
UNION ALL {_LOST}, 'lost' AS "of" FROM b LEFT JOIN (FROM sp WHERE coalesce(part_no, 0) <> 6) s ON s.id = b.id GROUP BY b.id HAVING sum(s.amount_paisa) IS DISTINCT FROM any_value(b.amount_paisa)
""",
    "events_streamed_twice": f"""
WITH {_T}, x AS (SELECT *, id // 2 AS k, CASE WHEN id % 2 = 1 THEN id * 7919 % 100003 END AS bal FROM (SELECT DISTINCT * FROM t)),
 f AS (SELECT user_id, k, arg_min(account_id, (occurred_at, id)) AS account_id, min((occurred_at, id)) AS place, arg_min({_SIGN}, (occurred_at, id)) AS s, arg_min(bal, (occurred_at, id)) FILTER (bal IS NOT NULL) AS bal FROM x GROUP BY ALL),
 g AS (SELECT bal - lag(bal) OVER (PARTITION BY account_id ORDER BY place) - s AS missing FROM f WHERE bal IS NOT NULL),
 n AS (SELECT (SELECT count(*) FROM x) AS parsed, (SELECT count(*) FROM f) AS rows, (SELECT count(*) FROM g WHERE missing <> 0) AS gaps)
SELECT CAST(1 AS INTEGER) AS run, parsed, rows AS ledger_rows, rows AS new_rows, gaps, gaps AS new_gaps FROM n UNION ALL SELECT 2, 0, rows, 0, gaps, 0 FROM n UNION ALL SELECT 3, parsed, rows, 0, gaps, 0 FROM n
""",
    "synced_twice": f"""
WITH {_T}, k AS (SELECT id, account_id, id % 3 AS third, (account_id, date_trunc('minute', occurred_at), direction, amount_paisa, regexp_replace(upper(left(description_raw, 18)), '[^A-Z0-9]', '', 'g')) AS key FROM t),
 n AS (SELECT (SELECT count(*) FROM k WHERE third = 0) + (SELECT count(DISTINCT key) FROM k WHERE third = 1 OR third = 2 AND account_id = 2) AS txns, (SELECT count(DISTINCT key) FROM k WHERE third > 0 AND account_id = 2) AS mails,
  (SELECT count(DISTINCT account_id) FROM k WHERE third = 1 OR third = 2 AND account_id = 2) + (SELECT count(*) FROM (FROM k WHERE third = 0 LIMIT 1)) AS accounts)
SELECT CAST(run AS INTEGER) AS run, txns AS transactions, CASE run WHEN 1 THEN txns ELSE 0 END AS new_transactions, CAST(0 AS BIGINT) AS changed, accounts, greatest(mails - 1, 0) AS gaps, CASE run WHEN 1 THEN greatest(mails - 1, 0) ELSE 0 END AS new_gaps, CAST(0 AS BIGINT) AS rejected, mails AS balances
FROM n, range(1, 3) AS r(run)
""",
}
