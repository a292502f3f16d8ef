"""DuckDB SQL for the ledger queries, written independently of the DataFrame code.

Only the mapping of the driver's tables to ledger columns is shared text."""

from __future__ import annotations

from pursebook.sources.adapters import OPENING_PAISA, RULES, TRANSACTION_COLUMNS

_T = "t AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in TRANSACTION_COLUMNS.items()) + " FROM events)"
_LOCAL = "(occurred_at + INTERVAL '5 hours 45 minutes')"
_SIGN = "CASE WHEN direction = 'CREDIT' THEN amount_paisa ELSE -amount_paisa END"
_CHAIN = f"""r AS (SELECT *, CAST(sum({_SIGN}) OVER (PARTITION BY account_id ORDER BY occurred_at, id) AS BIGINT) + {OPENING_PAISA} AS b FROM t),
 chain AS (SELECT * EXCLUDE (b), CASE WHEN id % 5 <> 0 THEN b END AS balance_after_paisa FROM r WHERE id % 97 <> 0)"""


def _gaps(rows: str = "chain", name: str = "g") -> str:
    return f"""{name}0 AS (SELECT account_id, id, balance_after_paisa AS b, {_SIGN} AS s, lag(id) OVER w AS p, lag(balance_after_paisa) OVER w AS pb FROM {rows}
   WHERE balance_after_paisa IS NOT NULL WINDOW w AS (PARTITION BY account_id ORDER BY occurred_at, id)),
 {name} AS (SELECT account_id, p AS after_txn_id, id AS before_txn_id, b - pb - s AS missing_paisa FROM {name}0 WHERE p IS NOT NULL AND b - pb <> s)"""


_ACC = "acc AS (SELECT account_id AS id, max(institution) AS institution, max(institution) || ' ' || lpad(CAST(account_id AS VARCHAR), 8, '0') AS display_name FROM t GROUP BY 1)"
_CAT = """cat AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey + 100 AS parent_id, CAST(NULL AS BOOLEAN) AS is_spend FROM nation
 UNION ALL SELECT r_regionkey + 100, r_name, NULL, r_regionkey <> 4 FROM region)"""
_MONTHLY = f"""m AS (SELECT user_id, date_trunc('month', {_LOCAL}) AS month, category_id, currency, CAST(sum(amount_paisa) FILTER (direction = 'DEBIT') AS BIGINT) AS spent_paisa,
 CAST(sum(amount_paisa) FILTER (direction = 'CREDIT') AS BIGINT) AS received_paisa, count(*) AS txn_count FROM t WHERE NOT excluded_from_spend GROUP BY ALL)"""
_MONTH_OUT = "SELECT user_id, CAST(month AS TIMESTAMP) AS month, category_id, currency, spent_paisa, received_paisa, txn_count FROM m"
_DAILY = f"""dd AS (SELECT user_id, CAST({_LOCAL} AS DATE) AS day, currency, CAST(sum(amount_paisa) FILTER (direction = 'DEBIT') AS BIGINT) AS spent_paisa,
 count(*) FILTER (direction = 'DEBIT') AS txn_count FROM t WHERE NOT excluded_from_spend GROUP BY ALL)"""
_LEAVES = """c2 AS (SELECT c.id, c.name AS leaf, coalesce(p.name, c.name) AS grp, coalesce(p.is_spend, c.is_spend, TRUE) AS spend FROM cat c LEFT JOIN cat p ON p.id = c.parent_id),
 lv AS (SELECT CASE WHEN coalesce(spend, TRUE) THEN 'spend' ELSE 'excluded' END AS side, coalesce(grp, 'Uncategorized') AS group_name, coalesce(leaf, 'Uncategorized') AS leaf_name,
  CAST(sum(spent_paisa) AS BIGINT) AS spent_paisa, CAST(sum(txn_count) AS BIGINT) AS txn_count FROM m LEFT JOIN c2 ON c2.id = m.category_id WHERE spent_paisa > 0 GROUP BY ALL)"""
_OPEN = f"""{_gaps()},
 og AS (SELECT g.*, acc.display_name AS account_display_name, a.occurred_at AS after_occurred_at, a.balance_after_paisa AS after_balance_paisa, b.occurred_at AS before_occurred_at, b.balance_after_paisa AS before_balance_paisa
  FROM g JOIN acc ON acc.id = g.account_id JOIN chain a ON a.id = g.after_txn_id JOIN chain b ON b.id = g.before_txn_id WHERE g.before_txn_id % 5 <> 0)"""
_HEAT = f"""{_gaps('chain', 'hg')}, au AS (SELECT DISTINCT account_id, user_id FROM t),
 sp AS (SELECT au.user_id, CAST(a.occurred_at + INTERVAL '5 hours 45 minutes' AS DATE) AS x, CAST(b.occurred_at + INTERVAL '5 hours 45 minutes' AS DATE) AS y FROM hg JOIN au ON au.account_id = hg.account_id JOIN chain a ON a.id = after_txn_id JOIN chain b ON b.id = before_txn_id),
 dn AS (SELECT user_id, day, spent_paisa FROM dd WHERE currency = 'NPR'),
 e AS (SELECT user_id, min(day) AS earliest FROM dn GROUP BY 1),
 q0 AS (SELECT user_id, list(spent_paisa ORDER BY spent_paisa) AS v FROM dn WHERE spent_paisa > 0 GROUP BY 1),
 q AS (SELECT user_id, v[least(len(v) * 1 // 4, len(v) - 1) + 1] AS q1, v[least(len(v) * 2 // 4, len(v) - 1) + 1] AS q2, v[least(len(v) * 3 // 4, len(v) - 1) + 1] AS q3 FROM q0),
 days AS (SELECT e.user_id, earliest, CAST(DATE '2024-01-20' - CAST(i AS INTEGER) AS DATE) AS day FROM e, range(0, 371) x(i)),
 qw0 AS (SELECT user_id, list(spent_paisa ORDER BY spent_paisa) AS v FROM dn WHERE spent_paisa > 0 AND day BETWEEN DATE '2024-01-20' - 370 AND DATE '2024-01-20' GROUP BY 1),
 qw AS (SELECT user_id, v[least(len(v) * 1 // 4, len(v) - 1) + 1] AS q1, v[least(len(v) * 2 // 4, len(v) - 1) + 1] AS q2, v[least(len(v) * 3 // 4, len(v) - 1) + 1] AS q3 FROM qw0),
 hm AS (SELECT days.user_id, days.day, CASE WHEN days.day < earliest THEN 'beforeData' WHEN EXISTS (SELECT 1 FROM sp WHERE sp.user_id = days.user_id AND days.day > x AND days.day < y) THEN 'uncertainGap' ELSE 'spend' END AS kind,
  coalesce(spent_paisa, 0) AS s, q1, q2, q3 FROM days LEFT JOIN dn ON dn.user_id = days.user_id AND dn.day = days.day LEFT JOIN qw ON qw.user_id = days.user_id)"""
_ALL_HEAT = _HEAT
_PAIRS = """pr AS (SELECT d.id AS d_id, c.id AS c_id, d.amount_paisa, abs(epoch_us(d.occurred_at) - epoch_us(c.occurred_at)) AS apart_us,
  coalesce(contains(lower(d.description_raw), lower(c.institution)), FALSE) OR coalesce(contains(lower(d.counterparty), lower(c.institution)), FALSE)
  OR coalesce(contains(lower(c.description_raw), lower(d.institution)), FALSE) OR coalesce(contains(lower(c.counterparty), lower(d.institution)), FALSE) AS mentioned
 FROM t d JOIN t c ON d.user_id = c.user_id AND d.amount_paisa = c.amount_paisa AND d.direction = 'DEBIT' AND c.direction = 'CREDIT' AND d.account_id <> c.account_id
  AND abs(epoch_us(d.occurred_at) - epoch_us(c.occurred_at)) <= 1800000000),
 sc AS (SELECT *, count(*) OVER (PARTITION BY d_id) > 1 OR count(*) OVER (PARTITION BY c_id) > 1 AS ambiguous FROM pr),
 ss AS (SELECT *, 0.5 + CASE WHEN mentioned THEN 0.3 ELSE 0 END + CASE WHEN apart_us <= 300000000 THEN 0.2 ELSE 0 END - CASE WHEN ambiguous THEN 0.3 ELSE 0 END AS confidence FROM sc)"""
_RULE = "CASE " + " ".join(f"WHEN regexp_matches(description_raw, '{p}', 'i') THEN {i}" for i, (_, p, _) in enumerate(RULES)) + " END"
_RULE_CAT = "CASE " + " ".join(f"WHEN regexp_matches(description_raw, '{p}', 'i') THEN {c}" for _, p, c in RULES) + " END"
_MASKED = "k AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'XXXX4321' WHEN id % 2 = 0 THEN '001#####2345' || lpad(CAST(account_id AS VARCHAR), 2, '0') ELSE '001##345' || lpad(CAST(account_id AS VARCHAR), 2, '0') END AS mask FROM t)"
_CANON = "CASE WHEN length(regexp_replace(mask, '[^0-9]', '', 'g')) >= 8 THEN left(regexp_replace(mask, '[^0-9]', '', 'g'), 3) || right(regexp_replace(mask, '[^0-9]', '', 'g'), 5) ELSE mask END"
_ARR = """ar AS (SELECT user_id, 'k' || CAST(id % 3000 AS VARCHAR) AS dedupe_key, id, occurred_at AS arrival, amount_paisa, direction, substr(description_raw, 1, 5 + CAST(id % 20 AS INTEGER)) AS description_raw,
  CASE WHEN id % 2 = 0 THEN id * 10 END AS balance_after_paisa, CASE WHEN id % 3 = 0 THEN 'ref' || CAST(id AS VARCHAR) END AS reference, nullif(counterparty, '') AS counterparty, CAST(NULL AS VARCHAR) AS channel FROM t)"""
_KEYED = "rk AS (SELECT *, 'k' || CAST(id % 2500 AS VARCHAR) AS new_key, occurred_at AS created_at FROM chain)"
_ALL_MSG = """msg AS (SELECT event_id AS message_id, ts AS received_at, CASE WHEN event_id % 17 = 0 THEN 'FAILED' WHEN event_id % 19 = 0 THEN 'IGNORED' ELSE 'PARSED' END AS status,
 CAST(event_id % 17 <> 0 AND event_id % 19 <> 0 AS INTEGER) AS txn_count, CASE WHEN event_id % 2 = 0 THEN 'SMS' ELSE 'EMAIL' END AS channel, props || repeat('-', 71) AS body FROM events)"""
_MSG = _ALL_MSG
_COLS = "id, account_id, occurred_at, direction, amount_paisa, status, category_id"
_CHANNEL = """CASE WHEN starts_with(lower(description_raw), 'salary for') THEN 'SALARY' WHEN starts_with(description_raw, 'ATM WDL') THEN 'ATM' WHEN starts_with(description_raw, 'MPAY FPQR') THEN 'FONEPAY'
 WHEN starts_with(description_raw, 'MPAY ') THEN 'MOBILE_BANKING' WHEN starts_with(description_raw, 'C-ASBA Fee') THEN 'CHARGE' WHEN starts_with(description_raw, 'CASBA allot') THEN 'IPO_ALLOTMENT'
 WHEN starts_with(description_raw, 'eSewa Load') OR starts_with(description_raw, 'ESW DLA:') THEN 'ESEWA_LOAD' END"""
_TEN = "order by occurred_at desc, id desc"

ORACLE_SQL = {
    "monthly_spend": f"WITH {_T}, {_MONTHLY} {_MONTH_OUT}",
    "monthly_totals_npr": f"WITH {_T}, {_MONTHLY} SELECT user_id, CAST(month AS TIMESTAMP) AS month, CAST(sum(coalesce(spent_paisa, 0)) AS BIGINT) AS spent_paisa, CAST(sum(coalesce(received_paisa, 0)) AS BIGINT) AS received_paisa FROM m WHERE currency = 'NPR' GROUP BY ALL",
    "orders_monthly_spend": f"""WITH t AS (SELECT 'u' AS user_id, 'NPR' AS currency, o_orderdate AS occurred_at, CASE WHEN o_orderstatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS direction,
 CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_paisa, c_nationkey AS category_id, FALSE AS excluded_from_spend FROM orders JOIN customer ON o_custkey = c_custkey), {_MONTHLY} {_MONTH_OUT}""",
    "daily_spend": f"WITH {_T}, {_DAILY} SELECT * FROM dd",
    "category_leaves": f"WITH {_T}, {_MONTHLY}, {_CAT}, {_LEAVES} SELECT * FROM lv",
    "category_breakdown": f"""WITH {_T}, {_MONTHLY}, {_CAT}, {_LEAVES}, gr AS (SELECT side, group_name, CAST(sum(spent_paisa) AS BIGINT) AS spent_paisa, CAST(sum(txn_count) AS BIGINT) AS txn_count FROM lv GROUP BY ALL),
 pc AS (SELECT *, spent_paisa * 100 / sum(spent_paisa) OVER (PARTITION BY side) AS p, CAST(row_number() OVER (PARTITION BY side ORDER BY spent_paisa DESC, group_name) AS INTEGER) AS rank FROM gr)
 SELECT side, group_name, spent_paisa, txn_count, rank, CASE WHEN side = 'spend' THEN CASE WHEN p < 1 THEN '<1%' ELSE CAST(CAST(round(p, 0) AS INTEGER) AS VARCHAR) || '%' END END AS share FROM pc""",
    "open_gap_detection": f"WITH {_T}, {_CHAIN}, {_gaps()} SELECT account_id, after_txn_id, before_txn_id, CAST(missing_paisa AS BIGINT) AS missing_paisa FROM g",
    "gap_resolution": f"""WITH {_T}, {_CHAIN}, {_gaps()},
 kn AS (SELECT account_id, after_txn_id, CASE WHEN before_txn_id % 7 = 0 THEN before_txn_id + 1000000000 ELSE before_txn_id END AS before_txn_id, missing_paisa FROM g WHERE before_txn_id % 3 <> 0),
 k2 AS (SELECT *, before_txn_id % 5 = 0 AS resolved, CASE WHEN before_txn_id % 5 = 0 THEN 'USER' END AS resolved_by FROM kn)
 SELECT k2.account_id, k2.after_txn_id, k2.before_txn_id, CAST(k2.missing_paisa AS BIGINT) AS missing_paisa, k2.resolved OR g.account_id IS NULL AS resolved,
  CASE WHEN NOT k2.resolved AND g.account_id IS NULL THEN 'RECONCILER' ELSE k2.resolved_by END AS resolved_by
 FROM k2 LEFT JOIN g ON g.account_id = k2.account_id AND g.after_txn_id = k2.after_txn_id AND g.before_txn_id = k2.before_txn_id
 UNION ALL SELECT account_id, after_txn_id, before_txn_id, CAST(missing_paisa AS BIGINT), FALSE, NULL FROM g WHERE (account_id, after_txn_id, before_txn_id) NOT IN (SELECT account_id, after_txn_id, before_txn_id FROM k2)""",
    "open_gaps_view": f"WITH {_T}, {_CHAIN}, {_ACC}, {_OPEN} SELECT account_id, account_display_name, after_txn_id, before_txn_id, CAST(missing_paisa AS BIGINT) AS missing_paisa, after_occurred_at, before_occurred_at, after_balance_paisa, before_balance_paisa FROM og",
    "gap_fill_suggestions": f"""WITH {_T}, {_CHAIN}, {_ACC}, {_OPEN}, s AS (SELECT *, (epoch_us(before_occurred_at) - epoch_us(after_occurred_at)) // 1000000 AS sec FROM og)
 SELECT account_id, after_txn_id, before_txn_id, CASE WHEN missing_paisa < 0 THEN 'DEBIT' ELSE 'CREDIT' END AS missing_direction, CAST(abs(missing_paisa) AS BIGINT) AS missing_amount, sec >= 2 AS has_room,
  after_occurred_at + to_seconds(sec // 2) AS midpoint, CAST(after_balance_paisa + missing_paisa AS BIGINT) AS chained_balance FROM s""",
    "heatmap_days": f"WITH {_T}, {_CHAIN}, {_DAILY}, {_HEAT} SELECT user_id, day, kind, CASE WHEN kind = 'spend' THEN s END AS spent_paisa, CASE WHEN kind = 'spend' THEN CASE WHEN s <= 0 THEN 0 WHEN s <= q1 THEN 1 WHEN s <= q2 THEN 2 WHEN s <= q3 THEN 3 ELSE 4 END END AS bucket FROM hm",
    "week_grid": f"WITH {_T}, {_CHAIN}, {_DAILY}, {_HEAT} SELECT user_id, day, CAST(((day - DATE '2023-01-15') + dayofweek(DATE '2023-01-15')) // 7 AS INTEGER) AS week, CAST(dayofweek(day) AS INTEGER) AS weekday FROM hm",
    "spend_quartiles": f"WITH {_T}, {_CHAIN}, {_DAILY}, {_HEAT} SELECT user_id, q1, q2, q3 FROM q",
    "transfer_pairs": f"WITH {_T}, {_PAIRS} SELECT d_id, c_id, amount_paisa, apart_us FROM pr",
    "transfer_scores": f"WITH {_T}, {_PAIRS} SELECT d_id, c_id, ambiguous, mentioned, CAST(confidence AS DOUBLE) AS confidence, confidence >= 0.8 AS auto_link FROM ss",
    "transfer_linked_monthly": f"""WITH t0 AS (SELECT * FROM (WITH {_T} SELECT * FROM t)), p AS (SELECT * FROM (WITH {_T}, {_PAIRS} SELECT * FROM ss)),
 x AS (SELECT d_id AS id FROM p WHERE confidence >= 0.8 UNION SELECT c_id FROM p WHERE confidence >= 0.8), t AS (SELECT t0.* REPLACE (excluded_from_spend OR id IN (SELECT id FROM x) AS excluded_from_spend) FROM t0), {_MONTHLY} {_MONTH_OUT}""",
    "filter_range_amount": f"WITH {_T} SELECT {_COLS} FROM t WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-15' AND direction = 'DEBIT' AND amount_paisa BETWEEN 2000 AND 9000 AND account_id IN (1, 3, 7)",
    "filter_uncategorized": f"WITH {_T} SELECT {_COLS} FROM t WHERE category_id IS NULL AND status = 'CONFIRMED'",
    "filter_transfer_modes": f"""WITH {_T}, f AS (SELECT * FROM t WHERE category_id IN (2, 4)) SELECT 'shown' AS mode, count(*) AS n, CAST(sum(amount_paisa) AS BIGINT) AS total_paisa FROM f
 UNION ALL SELECT 'hidden', count(*), CAST(sum(amount_paisa) AS BIGINT) FROM f WHERE NOT excluded_from_spend UNION ALL SELECT 'only', count(*), CAST(sum(amount_paisa) AS BIGINT) FROM f WHERE excluded_from_spend""",
    "search_text": f"""WITH {_T} SELECT id, description_raw, counterparty, user_note FROM t WHERE description_raw ILIKE '%50  OFF%' OR counterparty ILIKE '%50  OFF%' OR user_note ILIKE '%50  OFF%'
 UNION ALL SELECT id, description_raw, counterparty, user_note FROM t WHERE description_raw ILIKE '%lunch with%' OR counterparty ILIKE '%lunch with%' OR user_note ILIKE '%lunch with%'""",
    "search_documents": "SELECT doc_id FROM documents WHERE text ILIKE '%tion of%'",
    "page_2": f"WITH {_T} SELECT id, occurred_at FROM t {_TEN} LIMIT 50 OFFSET 100",
    "recent_by_status": f"WITH {_T} SELECT id, occurred_at FROM t WHERE status = 'NEEDS_REVIEW' {_TEN} LIMIT 200",
    "on_day": f"WITH {_T} SELECT id, occurred_at FROM t WHERE CAST({_LOCAL} AS DATE) = DATE '2024-01-10'",
    "day_sections": f"WITH {_T} SELECT user_id, CAST({_LOCAL} AS DATE) AS day, count(*) AS n, CAST(sum(CASE WHEN transfer_group_id IS NOT NULL OR excluded_from_spend THEN 0 ELSE {_SIGN} END) AS BIGINT) AS net_paisa FROM t GROUP BY 1, 2",
    "page_totals": f"""WITH {_T}, p AS (SELECT * FROM t {_TEN} LIMIT 50), f AS (SELECT * FROM p WHERE transfer_group_id IS NULL AND NOT excluded_from_spend)
 SELECT CAST(coalesce(sum(amount_paisa) FILTER (direction = 'DEBIT'), 0) AS BIGINT) AS out_paisa, CAST(coalesce(sum(amount_paisa) FILTER (direction = 'CREDIT'), 0) AS BIGINT) AS in_paisa FROM f""",
    "txn_with_names": f"WITH {_T}, {_ACC}, {_CAT} SELECT t.id, acc.display_name AS account_name, cat.name AS category_name, coalesce(nullif(counterparty, ''), description_raw) AS title, transfer_group_id IS NOT NULL OR excluded_from_spend AS is_transfer FROM t LEFT JOIN acc ON acc.id = account_id LEFT JOIN cat ON cat.id = category_id",
    "rule_match_first": f"WITH {_T} SELECT id, {_RULE} AS rule_id, {_RULE_CAT} AS rule_category FROM t",
    "categorize_decisions": f"""WITH {_T}, x AS (SELECT *, {_RULE_CAT} AS rc FROM t WHERE status = 'NEEDS_REVIEW') SELECT id, coalesce(rc, category_id) AS category_id, CASE WHEN rc IS NOT NULL THEN 'rule' ELSE category_source END AS category_source,
 CASE WHEN rc IS NOT NULL THEN 1.0::DOUBLE END AS confidence, CASE WHEN rc IS NOT NULL THEN 'CATEGORIZED' ELSE 'NEEDS_REVIEW' END AS status FROM x""",
    "recategorize_decisions": f"""WITH {_T}, x AS (SELECT *, CASE WHEN id % 17 = 0 THEN 101 ELSE category_id END AS c, {_RULE_CAT} AS rc FROM t WHERE transfer_group_id IS NULL),
 y AS (SELECT *, CASE WHEN category_source = 'user' AND coalesce(c, 0) < 100 THEN 'kept' WHEN coalesce(category_source, '') <> 'user' AND rc IS NOT NULL THEN CASE WHEN rc = c THEN 'kept' ELSE 'by_rule' END
  WHEN c >= 100 THEN 'needs_review' ELSE 'kept' END AS decision FROM x) SELECT id, c AS old_category_id, CASE WHEN decision = 'by_rule' THEN rc ELSE c END AS new_category_id, decision FROM y""",
    "recategorize_counts": f"""WITH {_T}, x AS (SELECT *, CASE WHEN id % 17 = 0 THEN 101 ELSE category_id END AS c, {_RULE_CAT} AS rc FROM t WHERE transfer_group_id IS NULL)
 SELECT CASE WHEN category_source = 'user' AND coalesce(c, 0) < 100 THEN 'kept' WHEN coalesce(category_source, '') <> 'user' AND rc IS NOT NULL THEN CASE WHEN rc = c THEN 'kept' ELSE 'by_rule' END
  WHEN c >= 100 THEN 'needs_review' ELSE 'kept' END AS decision, count(*) AS n FROM x GROUP BY 1""",
    "leaf_categories": f"WITH {_CAT} SELECT id, name FROM cat WHERE id NOT IN (SELECT parent_id FROM cat WHERE parent_id IS NOT NULL)",
    "category_choices": "SELECT r_name AS group_name, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    "rule_coverage": f"WITH {_T} SELECT count(*) AS n, count({_RULE}) AS matched FROM t",
    "learned_rules": f"""WITH {_T} SELECT DISTINCT user_id, regexp_replace(substr(trim(description_raw), 1, 40), '([\\\\.\\[\\]{{}}()*+?^$|\\-#&~\\s])', '\\\\\\1', 'g') AS pattern, CAST(account_id AS INTEGER) AS category_id
 FROM t WHERE category_source = 'user' AND category_id IS DISTINCT FROM account_id""",
    "merchant_labels": f"""WITH {_T} SELECT id, CASE event_no WHEN 1 THEN 'MEGA MART ' || CAST(id % 7 AS VARCHAR) || ' (note: snacks)' WHEN 2 THEN 'eSewa wallet load to a phone number' WHEN 8 THEN 'eSewa wallet load' WHEN 9 THEN 'KHAJA GHAR (note: lunch)'
 WHEN 10 THEN 'mobile payment (rent)' ELSE coalesce(nullif(counterparty, ''), description_raw) END AS label FROM (SELECT *, id % 12 AS event_no FROM t)""",
    "remark_channel": f"WITH {_T} SELECT {_CHANNEL} AS channel, count(*) AS n FROM t GROUP BY 1",
    "canonical_mask": f"WITH {_T}, {_MASKED} SELECT id, {_CANON} AS canonical FROM k",
    "dedupe_keys": f"""WITH {_T}, {_MASKED} SELECT id, 'nabil:' || {_CANON} || ':' || strftime({_LOCAL}, '%Y-%m-%dT%H:%M') || ':' || direction || ':' || CAST(amount_paisa AS VARCHAR) || ':' || substr(sha256(regexp_replace(upper(substr(description_raw, 1, 18)), '[^A-Z0-9]', '', 'g')), 1, 8) AS dedupe_key,
 sha256(institution || '|' || CAST(id AS VARCHAR) || '|' || description_raw) AS content_hash FROM k""",
    "upsert_collapse": f"""WITH RECURSIVE {_T}, {_ARR}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, dedupe_key ORDER BY arrival, id) AS n FROM ar),
 w(user_id, dedupe_key, n, d) AS (SELECT user_id, dedupe_key, n, description_raw FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.dedupe_key, o.n, CASE WHEN starts_with(o.description_raw, w.d) THEN o.description_raw ELSE w.d END FROM w JOIN o ON o.user_id = w.user_id AND o.dedupe_key = w.dedupe_key AND o.n = w.n + 1),
 l AS (SELECT user_id, dedupe_key, arg_max(d, n) AS description_raw FROM w GROUP BY ALL),
 f AS (SELECT user_id, dedupe_key, arg_min(balance_after_paisa, n) FILTER (balance_after_paisa IS NOT NULL) AS balance_after_paisa, arg_min(reference, n) FILTER (reference IS NOT NULL) AS reference,
  arg_min(counterparty, n) FILTER (counterparty IS NOT NULL) AS counterparty, CAST(NULL AS VARCHAR) AS channel FROM o GROUP BY ALL)
 SELECT o.user_id, o.dedupe_key, o.id, o.arrival, o.amount_paisa, o.direction, l.description_raw, f.balance_after_paisa, f.reference, f.counterparty, f.channel FROM o JOIN l USING (user_id, dedupe_key) JOIN f USING (user_id, dedupe_key) WHERE n = 1""",
    "insert_ignore": f"""WITH {_T}, {_ARR}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id, dedupe_key ORDER BY arrival, id) AS n FROM ar WHERE id % 10 >= 2)
 SELECT user_id, dedupe_key, id FROM i WHERE n = 1 AND (user_id, dedupe_key) NOT IN (SELECT user_id, dedupe_key FROM ar WHERE id % 10 < 2)""",
    "survivor_rank": f"WITH {_T}, {_CHAIN}, {_KEYED} SELECT id, CAST(row_number() OVER (PARTITION BY user_id, new_key ORDER BY balance_after_paisa IS NULL, created_at, id) AS INTEGER) AS rank FROM rk",
    "survivor_category": f"""WITH {_T}, {_CHAIN}, {_KEYED}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id, new_key ORDER BY created_at, id) AS n FROM rk WHERE category_id IS NOT NULL)
 SELECT user_id, new_key, category_id, category_source FROM x WHERE n = 1""",
    "merge_fold": f"""WITH {_T}, {_CHAIN}, {_KEYED}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, new_key ORDER BY created_at, id) AS n, row_number() OVER (PARTITION BY user_id, new_key ORDER BY balance_after_paisa IS NULL, created_at, id) AS k,
  row_number() OVER (PARTITION BY user_id, new_key ORDER BY length(description_raw) DESC, description_raw DESC) AS dl FROM rk),
 f AS (SELECT *, max(CASE WHEN k = 1 THEN description_raw END) OVER w AS kept, max(CASE WHEN dl = 1 THEN description_raw END) OVER w AS longest FROM o WINDOW w AS (PARTITION BY user_id, new_key))
 SELECT user_id, new_key, count(*) AS n, max(CASE WHEN k = 1 THEN id END) AS keep_id, max(balance_after_paisa) AS balance_after_paisa, arg_min(counterparty, n) FILTER (counterparty IS NOT NULL) AS counterparty,
  arg_min(user_note, n) FILTER (user_note IS NOT NULL) AS user_note, arg_min(transfer_group_id, n) FILTER (transfer_group_id IS NOT NULL) AS transfer_group_id, bool_or(excluded_from_spend) AS excluded_from_spend,
  bool_or(status = 'CONFIRMED') AS confirmed, max(CASE WHEN length(longest) > length(kept) AND starts_with(longest, kept) THEN longest ELSE kept END) AS description_raw FROM f GROUP BY 1, 2""",
    "account_survivor": f"""WITH {_T}, {_MASKED}, a AS (SELECT DISTINCT institution, mask, institution || '/' || mask AS id, {_CANON} AS canon FROM k)
 SELECT id, canon, first_value(id) OVER (PARTITION BY institution, canon ORDER BY mask <> canon, id) AS keep_id FROM a""",
    "new_accounts": f"""WITH {_T}, {_MASKED}, q AS (SELECT DISTINCT user_id, institution, coalesce(CASE WHEN id % 3 > 0 THEN mask END, '') AS mask FROM k)
 SELECT user_id, institution, mask, CASE WHEN mask LIKE '001##3%' THEN 'known' ELSE trim(institution || ' ' || mask) END AS display_name, CAST(1 AS BIGINT) AS n FROM q""",
    "statement_audit_missing": """WITH l AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS BIGINT) AS amount_paisa, l_returnflag AS direction, l_orderkey, l_linenumber FROM lineitem),
 e AS (SELECT day, amount_paisa, direction, row_number() OVER (PARTITION BY day, amount_paisa, direction) AS n FROM l WHERE l_orderkey % 3 <> 0),
 s AS (SELECT *, row_number() OVER (PARTITION BY day, amount_paisa, direction ORDER BY l_orderkey, l_linenumber) AS n FROM l)
 SELECT day, amount_paisa, direction, l_orderkey, l_linenumber FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.day = s.day AND e.amount_paisa = s.amount_paisa AND e.direction = s.direction AND e.n = s.n)""",
    "retention_candidates": f"""WITH {_T}, {_MSG} SELECT message_id FROM msg WHERE status = 'PARSED' AND txn_count > 0 AND received_at < TIMESTAMP '2024-01-09'
 AND message_id NOT IN (SELECT id FROM t WHERE CASE WHEN id % 2 = 0 THEN 'CONFIRMED' ELSE status END <> 'CONFIRMED')""",
    "status_counts": f"WITH {_MSG} SELECT status, count(*) AS n FROM msg GROUP BY 1",
    "message_issues": f"WITH {_MSG} SELECT message_id, status, CASE WHEN length(body) > 80 THEN substr(body, 1, 80) || '…' ELSE body END AS preview FROM msg WHERE status IN ('FAILED', 'IGNORED')",
    "run_summary": f"WITH {_MSG} SELECT channel, count(*) AS fetched, count(*) FILTER (status = 'PARSED') AS parsed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'IGNORED') AS ignored, CAST(sum(txn_count) AS BIGINT) AS txns FROM msg GROUP BY 1",
    "last_success": """WITH r AS (SELECT ts AS started_at, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL '5 minutes' END AS completed_at, event_id % 3 = 0 AS bad FROM events)
 SELECT max(completed_at) FILTER (NOT bad) AS last_success, max(started_at) AS last_attempt, max(completed_at) AS last_completed, coalesce(max(completed_at) FILTER (NOT bad), TIMESTAMP '2023-01-01') - INTERVAL '3 days' AS next_since FROM r""",
    "export_rows": f"""WITH {_T}, {_ACC}, {_CAT} SELECT t.id, occurred_at, acc.display_name AS account_name, direction, amount_paisa, CAST(CAST(amount_paisa AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2))::VARCHAR AS amount, currency, description_raw, coalesce(cat.name, '') AS category
 FROM t LEFT JOIN acc ON acc.id = account_id LEFT JOIN cat ON cat.id = category_id""",
    "constraint_violations": f"""WITH {_T} SELECT id, 'amount_positive' AS violation FROM t WHERE id % 31 = 0
 UNION ALL SELECT id, 'manual_has_no_parser' FROM t WHERE id % 10 = 0 AND id % 20 <> 0 UNION ALL SELECT id, 'manual_key_namespace' FROM t WHERE (id % 10 = 0) <> (id % 30 = 0)""",
    "duplicate_keys": f"WITH {_T}, {_ARR} SELECT user_id, dedupe_key, count(*) AS n FROM ar GROUP BY ALL HAVING count(*) > 1",
    "parse_amounts": """WITH x AS (SELECT *, CAST(l_extendedprice * 10 AS DECIMAL(18,3)) AS a FROM lineitem)
 SELECT l_orderkey, l_linenumber, CAST(round_even(a * 100, 0) AS BIGINT) AS paisa, CAST(CAST(l_quantity AS DECIMAL(10,1)) * 100 AS BIGINT) AS typed FROM x""",
    "format_amounts": f"WITH {_T} SELECT id, CASE WHEN currency = 'NPR' THEN 'Rs.' ELSE currency END || ' ' || format('{{:,}}', amount_paisa * 137 // 100) || '.' || lpad(CAST(amount_paisa * 137 % 100 AS VARCHAR), 2, '0') AS text FROM t",
    "statement_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS parsed FROM orders",
    "sms_parse": f"""WITH {_T} SELECT 'h' || CAST(id AS VARCHAR) AS message_id, 'NABIL' AS institution, '00134' || '5' || lpad(CAST(account_id AS VARCHAR), 2, '0') AS account_mask, date_trunc('second', occurred_at) AS occurred_at, 'SECOND' AS occurred_precision, direction, amount_paisa, 'NPR' AS currency,
  CAST(NULL AS VARCHAR) AS reference, description_raw, CAST(NULL AS VARCHAR) AS counterparty, {_CHANNEL} AS channel FROM t WHERE id % 3 = 1
 UNION ALL SELECT 'h' || CAST(id AS VARCHAR), 'LAXMI', '98765', CAST(CAST({_LOCAL} AS DATE) AS TIMESTAMP) - INTERVAL '5 hours 45 minutes', 'DAY', direction, amount_paisa, 'NPR', '44700000D4T4', 'QR-Pay,CMPAY,44700000D4T4/KK Store,Sales;Sales', 'KK Store', 'QR_PAY' FROM t WHERE id % 3 = 0""",
    "sms_outcomes": "SELECT CASE WHEN event_id % 3 = 2 THEN 'IGNORED' ELSE 'PARSED' END AS status, count(*) AS n, count(*) FILTER (event_id % 3 <> 2) AS txns FROM events GROUP BY 1",
    "user_edits": f"""WITH {_T} SELECT id, CASE WHEN id % 18 = 0 THEN 7 ELSE category_id END AS category_id, CASE WHEN id % 18 = 0 THEN 'user' ELSE category_source END AS category_source,
 CASE WHEN id % 27 = 0 THEN NULL WHEN id % 18 = 0 THEN 'tea' ELSE user_note END AS user_note, CASE WHEN id % 45 = 0 THEN 'CONFIRMED' WHEN id % 18 = 0 THEN 'CATEGORIZED' ELSE status END AS status FROM t""",
    "all_retention_candidates": f"""WITH {_T}, {_ALL_MSG} SELECT message_id FROM msg WHERE status = 'PARSED' AND received_at < TIMESTAMP '2024-01-09'
 AND message_id NOT IN (SELECT id FROM t WHERE id % 2 <> 0 AND status <> 'CONFIRMED')""",
    "all_status_counts": f"WITH {_ALL_MSG} SELECT status, count(*) AS n FROM msg GROUP BY 1",
    "all_message_issues": f"WITH {_ALL_MSG} SELECT message_id, status, CASE WHEN length(body) > 80 THEN substr(body, 1, 80) || '…' ELSE body END AS preview FROM msg WHERE status IN ('FAILED', 'IGNORED')",
    "all_run_summary": f"WITH {_ALL_MSG} SELECT channel, count(*) AS fetched, count(*) FILTER (status = 'PARSED') AS parsed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'IGNORED') AS ignored, CAST(sum(txn_count) AS BIGINT) AS txns FROM msg GROUP BY 1",
    "all_heatmap_days": f"WITH {_T}, {_CHAIN}, {_DAILY}, {_ALL_HEAT} SELECT user_id, day, kind, CASE WHEN kind = 'spend' THEN s END AS spent_paisa, CASE WHEN kind = 'spend' THEN CASE WHEN s <= 0 THEN 0 WHEN s <= q1 THEN 1 WHEN s <= q2 THEN 2 WHEN s <= q3 THEN 3 ELSE 4 END END AS bucket FROM hm",
    "all_day_sections": f"WITH {_T} SELECT user_id, CAST({_LOCAL} AS DATE) AS day, count(*) AS n, CAST(sum(CASE WHEN transfer_group_id IS NOT NULL OR excluded_from_spend THEN 0 ELSE {_SIGN} END) AS BIGINT) AS net_paisa FROM t GROUP BY 1, 2",
}
