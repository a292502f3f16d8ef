"""DuckDB SQL for the intake queries, written independently of the DataFrame code.

Only the mapping of the driver's tables to ledger columns and fixed lists are shared."""

from __future__ import annotations

from pursebook.operators.categorize import seed_rows
from pursebook.plans.ledger_sql import _CAT, _CHAIN, _CHANNEL, _LOCAL, _MSG, _T, _gaps
from pursebook.sources.adapters import RULES

_KNOWN = f"""{_gaps()},
 kn AS (SELECT account_id, after_txn_id, CASE WHEN before_txn_id % 7 = 0 THEN before_txn_id + 1000000000 ELSE before_txn_id END AS before_txn_id, missing_paisa FROM g WHERE before_txn_id % 3 <> 0),
 k2 AS (SELECT *, before_txn_id % 5 = 0 AS resolved FROM kn)"""
_STAGED = """st AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'ESEWA_STATEMENT' WHEN 1 THEN 'NABIL_STATEMENT' WHEN 2 THEN 'LAXMI_STATEMENT' WHEN 3 THEN 'BANK_STATEMENT' WHEN 4 THEN 'NABIL_ALERT' WHEN 5 THEN 'laxmi' ELSE 'promo' END AS sender,
 props AS body, ts AS received_at, lpad(CAST(event_id AS VARCHAR), 12, '0') AS padded FROM events)"""
_RULES = "ru AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {p}, '{pattern}', {c})" for i, (p, pattern, c) in enumerate(RULES)) + ") x(id, priority, pattern, category_id))"
_SEED = "se AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {'NULL' if p is None else chr(39) + p[1:] + chr(39)}, {s})" for _, _, n, p, s in seed_rows("")) + ") x(name, parent, is_spend))"
_DRAFTS = """dr AS (SELECT *, CASE WHEN id % 6 = 5 THEN 'SIDEWAYS' ELSE direction END AS way, CASE WHEN id % 9 = 0 THEN 0 ELSE amount_paisa END AS amount, CASE id % 4 WHEN 0 THEN 'with tea' WHEN 1 THEN repeat('x', 501) END AS said,
 CASE WHEN id % 9 = 0 THEN 'amount is not positive' WHEN id % 6 = 5 THEN 'direction is neither DEBIT nor CREDIT' WHEN id % 4 = 1 THEN 'note is longer than 500 characters' END AS reason FROM t)"""
_DAY = f"CAST({_LOCAL} AS DATE)"
_AGO = "(epoch_us(TIMESTAMP '2024-03-05 12:00:00') - epoch_us(occurred_at)) // 1000000"

#: The whole merge: reports, their new keys and ranks, what follows from them.
_MERGE = f"""{_T}, {_CHAIN},
 rp AS (SELECT id, user_id, CASE WHEN account_id = 7 THEN 'LAXMI' ELSE 'NABIL' END AS institution,
   CASE WHEN account_id = 7 THEN '77###' WHEN id % 2 = 0 THEN '001#####23' ELSE '001' END || lpad(CAST(account_id AS VARCHAR), 5, '0') AS mask, occurred_at AS created_at, date_trunc('day', occurred_at) AS moment, direction, amount_paisa % 3 + 1 AS amount,
   balance_after_paisa, ['PAYMENT TO TEA SHOP IN THE OLD TOWN', 'PAYMENT TO TEA SHOP', 'PAYMENT TO TEA SHOP', 'RENT', 'Activate bit.ly/y', 'PAYMENT TO TEA SHELF'][id % 6 + 1] AS clean,
   ['PAYMENT TO TEA SHOP IN THE OLD TOWN', 'PAYMENT TO TEA SHOP', 'PAYMENT TO TEA SHOP Activate bit.ly/x', 'RENT', 'Activate bit.ly/y', 'PAYMENT TO TEA SHELF'][id % 6 + 1] AS raw,
   CASE WHEN id % 4 = 0 THEN 'r' || id END AS reference, nullif(counterparty, '') AS counterparty, CASE WHEN id % 5 = 0 THEN 'SMS' END AS channel, user_note, transfer_group_id, excluded_from_spend, category_id, category_source, status FROM chain),
 ac AS (SELECT DISTINCT user_id, institution, mask, user_id || '/' || mask AS id, CASE WHEN institution = 'NABIL' THEN '001' || right(mask, 5) ELSE mask END AS canon FROM rp),
 sv AS (SELECT *, first_value(id) OVER (PARTITION BY user_id, institution, canon ORDER BY mask <> canon, id) AS keep_id FROM ac),
 mk AS (SELECT rp.* EXCLUDE (mask), sv.keep_id AS account_id, CASE WHEN rp.institution = 'NABIL' THEN clean ELSE raw END AS text,
   CASE WHEN rp.institution <> 'NABIL' THEN 'old' || rp.id ELSE concat_ws(':', 'nabil', canon, strftime(moment + INTERVAL '345 minutes', '%Y-%m-%dT%H:%M'), direction, amount, substr(sha256(regexp_replace(upper(left(clean, 18)), '[^A-Z0-9]', '', 'g')), 1, 8)) END AS new_key
   FROM rp JOIN sv ON sv.user_id = rp.user_id AND sv.mask = rp.mask),
 rk AS (SELECT *, row_number() OVER w AS rank, first_value(id) OVER w AS stays FROM mk WINDOW w AS (PARTITION BY user_id, new_key ORDER BY balance_after_paisa IS NULL, created_at, id)),
 fo AS (SELECT user_id, new_key, max(balance_after_paisa) AS b, first(reference ORDER BY created_at, id) FILTER (reference IS NOT NULL) AS re, first(counterparty ORDER BY created_at, id) FILTER (counterparty IS NOT NULL) AS cp,
   first(channel ORDER BY created_at, id) FILTER (channel IS NOT NULL) AS ch, first(user_note ORDER BY created_at, id) FILTER (user_note IS NOT NULL) AS un, first(transfer_group_id ORDER BY created_at, id) FILTER (transfer_group_id IS NOT NULL) AS tg,
   bool_or(excluded_from_spend) AS ex, bool_or(status = 'CONFIRMED') AS co, first(text ORDER BY length(text) DESC, text DESC) AS longest,
   first({{'c': category_id, 's': category_source}} ORDER BY created_at, id) FILTER (category_id IS NOT NULL) AS ca FROM rk WHERE rank > 1 GROUP BY ALL)"""

ORACLE_SQL = {
    "merged_transactions": f"""WITH {_MERGE}
 SELECT k.id, k.user_id, account_id, direction, amount AS amount_paisa, coalesce(balance_after_paisa, b) AS balance_after_paisa, CASE WHEN length(longest) > length(text) AND starts_with(longest, text) THEN longest ELSE text END AS description_raw,
  coalesce(reference, re) AS reference, coalesce(counterparty, cp) AS counterparty, coalesce(channel, ch) AS channel, coalesce(user_note, un) AS user_note, coalesce(transfer_group_id, tg) AS transfer_group_id,
  excluded_from_spend OR coalesce(ex, FALSE) AS excluded_from_spend, coalesce(category_id, ca.c) AS category_id, coalesce(category_source, ca.s) AS category_source, CASE WHEN co THEN 'CONFIRMED' ELSE status END AS status, k.new_key AS dedupe_key
 FROM rk k LEFT JOIN fo ON fo.user_id = k.user_id AND fo.new_key = k.new_key WHERE rank = 1""",
    "merged_accounts": f"WITH {_MERGE} SELECT id, user_id, institution, canon AS mask FROM sv WHERE id = keep_id",
    "merged_gaps": f"""WITH {_MERGE},
 gp AS (SELECT rp.user_id || '/' || rp.mask AS acc, id AS a, id + 1 + id % 2 * 150 AS b FROM rp WHERE id % 3 = 0),
 g2 AS (SELECT sv.keep_id AS account_id, coalesce(x.stays, a) AS after_txn_id, coalesce(y.stays, b) AS before_txn_id FROM gp JOIN sv ON sv.id = gp.acc LEFT JOIN rk x ON x.id = gp.a LEFT JOIN rk y ON y.id = gp.b)
 SELECT DISTINCT account_id, after_txn_id, before_txn_id FROM g2 WHERE after_txn_id <> before_txn_id""",
    "card_keys": f"WITH {_T} SELECT id, 'nabil:4321XX' || lpad(CAST(account_id AS VARCHAR), 2, '0') || ':' || strftime({_LOCAL}, '%Y-%m-%d') || ':DEBIT:' || CAST(amount_paisa AS VARCHAR) || ':' || substr(sha1(description_raw), 1, 8) AS dedupe_key FROM t",
    "archive_paths": f"WITH {_T} SELECT id, strftime(occurred_at, '%Y/%m/') || sha256(CAST(id AS VARCHAR)) || '.eml' AS path FROM t",
    "time_ago_labels": f"""WITH {_T}, x AS (SELECT id, {_AGO} AS s FROM t) SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago'
 WHEN s < 604800 THEN CAST(s // 86400 AS VARCHAR) || 'd ago' WHEN s < 2592000 THEN CAST(s // 604800 AS VARCHAR) || 'w ago' ELSE CAST(s // 2592000 AS VARCHAR) || 'mo ago' END AS label FROM x""",
    "day_labels": f"""WITH {_T}, x AS (SELECT id, {_DAY} AS day FROM t) SELECT id, CASE WHEN day = DATE '2024-01-20' THEN 'Today' WHEN day = DATE '2024-01-19' THEN 'Yesterday' WHEN day > DATE '2024-01-13' THEN strftime(day, '%A')
 WHEN year(day) = 2024 THEN strftime(day, '%a %-d %b') ELSE strftime(day, '%a %-d %b %Y') END AS label FROM x""",
    "span_labels": """WITH x AS (SELECT o_orderkey, o_orderdate AS moment, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01'), 0) AS n FROM orders)
 SELECT o_orderkey, strftime(moment, '%Y-%m-%d') || ' (' || CASE WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'about 1 day back' WHEN n < 14 THEN 'about ' || CAST(n AS VARCHAR) || ' days back' WHEN n < 70 THEN 'about ' || CAST(CAST(round_even(n / 7.0, 0) AS INTEGER) AS VARCHAR) || ' weeks back'
  WHEN n < 400 THEN 'about ' || CAST(CAST(round_even(n / 30.0, 0) AS INTEGER) AS VARCHAR) || ' months back' ELSE 'about ' || printf('%.1f', n / 365.0) || ' years back' END || ')' AS label FROM x""",
    "editable_amounts": f"WITH {_T} SELECT id, CAST(CAST(amount_paisa * 7 AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2))::VARCHAR AS text FROM t",
    "preset_totals": f"""WITH {_T}, p(preset, a, b) AS (VALUES ('thisMonth', DATE '2024-01-01', DATE '2024-02-01'), ('lastMonth', DATE '2023-12-01', DATE '2024-01-01'), ('last3Months', DATE '2023-11-01', DATE '2024-02-01'),
  ('thisYear', DATE '2024-01-01', DATE '2025-01-01'), ('all', DATE '0001-01-01', DATE '9999-01-01'))
 SELECT preset, count(id) AS n, CAST(coalesce(sum(amount_paisa), 0) AS BIGINT) AS total_paisa FROM p LEFT JOIN t ON {_LOCAL} >= a AND {_LOCAL} < b GROUP BY 1""",
    "active_filter_counts": "SELECT CAST(f AS INTEGER) AS filter, CAST(n AS INTEGER) AS active FROM (VALUES (0, 0), (1, 0), (2, 1), (3, 9)) x(f, n)",
    "one_transaction": f"WITH {_T} SELECT id, amount_paisa, direction FROM t WHERE id = 42",
    "oldest_in_review": f"WITH {_T} SELECT id, occurred_at FROM t WHERE status = 'NEEDS_REVIEW' ORDER BY occurred_at, id LIMIT 500",
    "account_range": f"WITH {_T} SELECT id, occurred_at FROM t WHERE account_id = 3 AND occurred_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09'",
    "look_back": f"WITH {_T} SELECT id FROM t WHERE occurred_at >= TIMESTAMP '2024-01-12'",
    "earliest_transaction": "SELECT min(ts) AS earliest_at FROM events",
    "attention_counts": f"WITH {_T}, {_CHAIN}, {_KNOWN}, {_MSG} SELECT (SELECT count(*) FROM msg WHERE status = 'FAILED') AS failed_messages, (SELECT count(*) FROM k2 WHERE NOT resolved) AS open_gaps",
    "gap_states": f"""WITH {_T}, {_CHAIN}, {_KNOWN} SELECT account_id, after_txn_id, before_txn_id, CASE WHEN EXISTS (SELECT 1 FROM k2 WHERE NOT resolved AND k2.account_id = g.account_id AND k2.after_txn_id = g.after_txn_id AND k2.before_txn_id = g.before_txn_id) THEN 'open' ELSE 'gone' END AS state FROM g""",
    "audit_ranges": f"WITH {_T} SELECT account_id, min({_DAY}) AS first_day, max({_DAY}) AS last_day FROM t GROUP BY 1",
    "expired_files": f"""WITH {_T}, {_MSG} SELECT message_id, strftime(received_at, '%Y/%m/') || sha256(CAST(message_id AS VARCHAR)) || '.eml' AS path FROM msg WHERE status = 'PARSED' AND txn_count > 0 AND received_at < TIMESTAMP '2024-01-09'
 AND message_id NOT IN (SELECT id FROM t WHERE status <> 'CONFIRMED')""",
    "uploaded_statements": f"""WITH {_STAGED} SELECT padded AS content_hash, CASE event_id % 7 WHEN 0 THEN 'eSewa statement' WHEN 1 THEN 'Nabil statement' WHEN 2 THEN 'Laxmi statement' ELSE 'Bank statement' END AS display_name, received_at
 FROM st WHERE event_id % 7 < 4 ORDER BY received_at DESC, padded DESC LIMIT 50""",
    "pending_queue": f"WITH {_STAGED} SELECT padded AS content_hash, received_at FROM st WHERE event_id % 5 = 0 ORDER BY received_at, padded LIMIT 500",
    "message_dedupe": "SELECT 'h' || CAST(event_id % 4001 AS VARCHAR) AS content_hash, min(event_id) AS event_id FROM events GROUP BY 1",
    "sms_scan": f"WITH {_STAGED} SELECT event_id, sha256(sender || '|' || CAST(epoch_us(received_at) // 1000 AS VARCHAR) || '|' || body) AS content_hash FROM st WHERE event_id % 7 IN (2, 4, 5) AND received_at > TIMESTAMP '2024-01-05' AND body IS NOT NULL",
    "sms_since": "SELECT max(ts) - INTERVAL '6 hours' AS since FROM events WHERE event_id % 2 = 0",
    "statement_senders": "SELECT CASE event_id % 4 WHEN 2 THEN 'NABIL_STATEMENT' WHEN 3 THEN 'BANK_STATEMENT' ELSE 'LAXMI_STATEMENT' END AS sender, count(*) AS n FROM events GROUP BY 1",
    "mail_fetch": """SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS message_id, CASE event_id % 3 WHEN 0 THEN 'b@x' ELSE 'a@x' END AS from_addr FROM events WHERE event_id % 3 < 2 AND ts >= TIMESTAMP '2024-01-10' ORDER BY from_addr, ts DESC, message_id LIMIT 300""",
    "mail_counts": """SELECT CASE event_id % 3 WHEN 1 THEN 'a@x' ELSE 'c@x' END AS sender, count(*) AS n FROM events WHERE event_id % 3 > 0 AND ts >= TIMESTAMP '2024-01-10' GROUP BY 1
 UNION ALL SELECT NULL, count(*) FROM events WHERE event_id % 3 > 0 AND ts >= TIMESTAMP '2024-01-10'""",
    "wallet_statement": f"""WITH {_T} SELECT 'f' || CAST(id // 50 AS VARCHAR) AS message_id, 'esewa:R' || CAST(id AS VARCHAR) AS dedupe_key, make_timestamp(epoch_us(occurred_at) // 100000 * 100000) AS occurred_at, direction, amount_paisa,
 CAST(100050 AS BIGINT) AS balance_after_paisa, 'Tea Shop' AS counterparty, 'WALLET_PAYMENT' AS channel FROM t WHERE id % 10 NOT IN (3, 4)""",
    "bank_statement": f"""WITH {_T} SELECT 'f' || CAST(id // 50 AS VARCHAR) AS message_id, '00178901' AS account_mask, CAST(CAST(occurred_at AS DATE) AS TIMESTAMP) - INTERVAL '5 hours 45 minutes' AS occurred_at, direction, amount_paisa,
 CAST(CASE WHEN id % 10 <> 4 THEN 200000 END AS BIGINT) AS balance_after_paisa, description_raw FROM t WHERE id % 10 <> 3""",
    "reparse_statements": f"""WITH {_T}, f AS (SELECT id // 50 AS f, count(*) FILTER (id % 10 <> 3) AS n FROM t GROUP BY 1) SELECT CASE WHEN n > 0 THEN 'PARSED' ELSE 'FAILED' END AS status, count(*) AS n, CAST(sum(n) AS BIGINT) AS txns FROM f GROUP BY 1""",
    "mail_alerts": f"""WITH {_T} SELECT 'm' || CAST(id AS VARCHAR) AS message_id, 'nabil.txn_alert' AS template_key, date_trunc('minute', occurred_at) AS occurred_at, 'MINUTE' AS occurred_precision, direction, amount_paisa, CAST(100050 AS BIGINT) AS balance_after_paisa,
  CAST(NULL AS VARCHAR) AS reference, description_raw, {_CHANNEL} AS channel FROM t WHERE id % 2 = 0
 UNION ALL SELECT 'm' || CAST(id AS VARCHAR), 'esewa.fund_load', date_trunc('second', occurred_at), 'SECOND', 'CREDIT', amount_paisa, NULL, 'R' || CAST(id AS VARCHAR), 'Some Bank', 'WALLET_LOAD' FROM t WHERE id % 2 = 1""",
    "card_mails": f"""WITH {_T} SELECT 'm' || CAST(id AS VARCHAR) AS message_id, CAST(CAST(occurred_at AS DATE) AS TIMESTAMP) - INTERVAL '5 hours 45 minutes' AS occurred_at, amount_paisa, 'USD' AS currency, 'SHOP ' || CAST(id % 9 AS VARCHAR) AS counterparty,
 'SHOP ' || CAST(id % 9 AS VARCHAR) || '; CITY' AS description_raw FROM t""",
    "manual_entries": f"""WITH {_T}, {_DRAFTS} SELECT 'manual:' || sha256(CAST(account_id AS VARCHAR) || '|' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z|' || direction || '|' || CAST(amount_paisa AS VARCHAR) || '|' || currency || '|' || trim(description_raw) || '|' || coalesce(said, '')) AS dedupe_key,
 amount_paisa, CASE WHEN category_id IS NOT NULL THEN 'user' END AS category_source, CASE WHEN category_id IS NOT NULL THEN 'CATEGORIZED' ELSE 'NEEDS_REVIEW' END AS status, said AS user_note, 'MANUAL' AS entry_source, CAST(0 AS INTEGER) AS parser_version FROM dr WHERE reason IS NULL""",
    "rejected_drafts": f"WITH {_T}, {_DRAFTS} SELECT id, reason FROM dr WHERE reason IS NOT NULL",
    "closed_gaps": f"""WITH {_T}, {_CHAIN}, {_KNOWN} SELECT account_id, after_txn_id, before_txn_id, resolved OR before_txn_id % 2 = 0 AS resolved, CASE WHEN resolved OR before_txn_id % 2 = 0 THEN 'USER' END AS resolved_by,
 CAST(CASE WHEN NOT resolved AND before_txn_id % 2 = 0 THEN 600 END AS INTEGER) AS note_chars FROM k2""",
    "marked_messages": """SELECT event_id AS content_hash, CASE WHEN event_id % 3 <> 0 THEN 'PENDING' WHEN event_id % 2 = 0 THEN 'FAILED' ELSE 'PARSED' END AS status, CASE WHEN event_id % 6 = 0 THEN 'bad' END AS error,
 CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS txn_count FROM events""",
    "run_log": f"""WITH {_MSG} SELECT 'r1' AS id, 'u' AS user_id, 'm' AS machine, TIMESTAMP '2024-01-20' AS started_at, TIMESTAMP '2024-01-20 00:05:00' AS completed_at, TIMESTAMP '2024-01-17' AS since, CAST(count(*) AS INTEGER) AS fetched,
 CAST(count(*) FILTER (status = 'PARSED') AS INTEGER) AS parsed, CAST(count(*) FILTER (status = 'FAILED') AS INTEGER) AS failed, CAST(sum(txn_count) AS INTEGER) AS txns_inserted, CAST(NULL AS VARCHAR) AS error FROM msg""",
    "edited_rules": f"WITH {_RULES} SELECT CAST(id AS INTEGER) AS id, CAST(priority AS INTEGER) AS priority, pattern, CAST(CASE WHEN id % 3 = 0 THEN 77 ELSE category_id END AS INTEGER) AS category_id FROM ru WHERE id % 4 <> 1",
    "seeded_categories": f"WITH {_T}, {_SEED}, us AS (SELECT DISTINCT user_id FROM t) SELECT user_id || ':' || name AS id, user_id, name, user_id || ':' || parent AS parent_id, is_spend FROM us, se",
    "reparented": f"""WITH {_CAT} SELECT CAST(id AS VARCHAR) AS id, 'u' AS user_id, CASE name WHEN 'KENYA' THEN 'Kenya (moved)' ELSE name END AS name, CASE WHEN id IN (1, 2) THEN '999' ELSE CAST(parent_id AS VARCHAR) END AS parent_id,
 CASE WHEN id IN (1, 2) THEN coalesce(is_spend, TRUE) ELSE is_spend END AS is_spend FROM cat UNION ALL SELECT 'n', 'u', 'Brand new', '999', FALSE""",
    "repointed_rules": f"WITH {_RULES} SELECT CAST(id AS INTEGER) AS id, CAST(priority AS INTEGER) AS priority, pattern, CAST(CASE pattern WHEN 'MPAY' THEN 55 ELSE category_id END AS INTEGER) AS category_id FROM ru",
    "last_written": f"WITH {_T} SELECT 'k' || CAST(id % 700 AS VARCHAR) AS key, max(id) AS id, arg_max(amount_paisa, id) AS amount_paisa, arg_min(occurred_at, id) AS first_seen FROM t GROUP BY 1",
    "merged_ledger": f"""WITH {_T}, {_CHAIN}, k AS (SELECT id, user_id, lpad(CAST(account_id AS VARCHAR), 5, '0') AS acc, date_trunc('hour', occurred_at) + INTERVAL '5 hours 45 minutes' AS moment, direction, amount_paisa % 5 * 100 + 100 AS amount, balance_after_paisa, counterparty, user_note,
  transfer_group_id, excluded_from_spend, category_id, category_source, status, occurred_at AS created_at FROM chain),
 n AS (SELECT *, 'nabil:001' || acc || ':' || strftime(moment, '%Y-%m-%dT%H:%M') || ':' || direction || ':' || CAST(amount AS VARCHAR) || ':' || substr(sha256('SHOP'), 1, 8) AS new_key FROM k),
 mr AS (SELECT *, row_number() OVER (PARTITION BY user_id, new_key ORDER BY balance_after_paisa IS NULL, created_at, id) AS rank FROM n),
 f AS (SELECT user_id, new_key, max(balance_after_paisa) AS b, arg_min(counterparty, (created_at, id)) FILTER (counterparty IS NOT NULL) AS cp, arg_min(user_note, (created_at, id)) FILTER (user_note IS NOT NULL) AS un,
  arg_min(transfer_group_id, (created_at, id)) FILTER (transfer_group_id IS NOT NULL) AS tg, bool_or(excluded_from_spend) AS ex, bool_or(status = 'CONFIRMED') AS co,
  min({{'c': created_at, 'i': id, 'cat': category_id, 'src': category_source}}) FILTER (category_id IS NOT NULL) AS ca FROM mr r WHERE rank > 1 GROUP BY 1, 2)
 SELECT r.id, '001#####23' || acc AS account_id, r.new_key AS dedupe_key, coalesce(r.balance_after_paisa, f.b) AS balance_after_paisa, coalesce(r.counterparty, f.cp) AS counterparty, coalesce(r.user_note, f.un) AS user_note, coalesce(r.transfer_group_id, f.tg) AS transfer_group_id,
  r.excluded_from_spend OR coalesce(f.ex, FALSE) AS excluded_from_spend, coalesce(r.category_id, f.ca.cat) AS category_id, coalesce(r.category_source, f.ca.src) AS category_source, CASE WHEN f.co THEN 'CONFIRMED' ELSE r.status END AS status
 FROM mr r LEFT JOIN f ON f.user_id = r.user_id AND f.new_key = r.new_key WHERE r.rank = 1""",
}
