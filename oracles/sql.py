"""The same queries as SQL over the parquet tables, row by row and without cells."""

from __future__ import annotations

from functools import cache

from ledgerloom import texts
from ledgerloom.config import DEFAULT as CFG
from ledgerloom.plans.catalog import RUN_DATE
from oracles.base import with_tables

# Rounds written out below; what they leave open is listed as links, so that it shows.
ROUNDS = 12


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tuple(items) -> str:
    return "(" + ", ".join(_quote(i) for i in items) + ")"


def _case(column: str, table: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_quote(a)} THEN {_quote(b)}" for a, b in table.items()) + f" ELSE {other} END"


def _money_text(c: str) -> str:
    return (f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || (abs({c}) // 100)::VARCHAR || '.' || lpad((abs({c}) % 100)::VARCHAR, 2, '0'))")


def _confidence(cost: str) -> str:
    """Whole percent of 1 - cost / 30 units, a half by the double nearest to it, as a plain round() does."""
    return f"greatest(55, round(100 * format('{{:.2f}}', 1 - ({cost}::DOUBLE / 100) / 30)::DOUBLE)::BIGINT)::BIGINT"


_TURN = "md5(concat_ws('|', cl, least(c1, c2), CASE WHEN c2 IS NOT NULL THEN greatest(c1, c2) END))"


def _greedy(name: str, edges: str) -> list[tuple[str, str]]:
    """Sequential walk as unrolled rounds; ``edges`` gives l, r1, r2 (or null), their cells cl, c1, c2, cost and more."""
    out = [(f"{name}_e0", f"SELECT *, row_number() OVER (ORDER BY cost, {_TURN}, l, r1, r2) AS eid FROM ({edges})")]
    for i in range(ROUNDS):
        out.append((f"{name}_n{i}", f"""SELECT node, min(eid) AS eid FROM (
  SELECT l AS node, eid FROM {name}_e{i} UNION ALL SELECT r1, eid FROM {name}_e{i}
  UNION ALL SELECT r2, eid FROM {name}_e{i} WHERE r2 IS NOT NULL) GROUP BY node"""))
        out.append((f"{name}_d{i}", f"""SELECT e.* FROM {name}_e{i} e JOIN {name}_n{i} a ON a.node = e.l AND a.eid = e.eid
  JOIN {name}_n{i} b ON b.node = e.r1 AND b.eid = e.eid
  LEFT JOIN {name}_n{i} c ON c.node = e.r2 WHERE e.r2 IS NULL OR c.eid = e.eid"""))
        out.append((f"{name}_u{i}", f"SELECT l AS node FROM {name}_d{i} UNION ALL SELECT r1 FROM {name}_d{i} UNION ALL SELECT r2 FROM {name}_d{i} WHERE r2 IS NOT NULL"))
        out.append((f"{name}_e{i + 1}", f"""SELECT * FROM {name}_e{i} WHERE l NOT IN (SELECT node FROM {name}_u{i})
  AND r1 NOT IN (SELECT node FROM {name}_u{i}) AND (r2 IS NULL OR r2 NOT IN (SELECT node FROM {name}_u{i}))"""))
    parts = [*(f"{name}_d{i}" for i in range(ROUNDS)), f"{name}_e{ROUNDS}"]
    out.append((name, " UNION ALL ".join(f"SELECT * FROM {part}" for part in parts)))
    return out


def _cells(table: str, key: str, *same: str, where: str) -> str:
    """Rows named by the first row that nothing but the identifier tells them from."""
    return f"(SELECT {key}, min({key}) OVER (PARTITION BY {', '.join(same)}) AS cell FROM {table} WHERE {where})"


def _leg_cells(legs: str, *more: str) -> str:
    return _cells(legs, "settlement_id", "merchant_id", "payment_rail", "sign(net_c)", "currency", "has_expected", "recon_c",
                  "settlement_date", *more, where="net_c <> 0")


def _line_cells(lines: str, *more: str) -> str:
    return _cells(lines, "bank_txn_id", "merchant_id", "payment_rail", "sign(amount_c)", "currency", "amount_c", "value_date", *more,
                  where="amount_c <> 0")


def _walked(edges: str, cost: str, leg_cells: str, line_cells: str, where: str = "true") -> str:
    return f"""SELECT {cost} AS cost, settlement_id AS l, bank_txn_id AS r1, NULL::VARCHAR AS r2, x.cell AS cl, y.cell AS c1,
  NULL::VARCHAR AS c2, amount_diff_c, day_diff
FROM ({edges}) e JOIN {leg_cells} x USING (settlement_id) JOIN {line_cells} y USING (bank_txn_id) WHERE {where}"""


def _walked_pairs(edges: str, leg_cells: str, line_cells: str) -> str:
    return f"""SELECT 0 AS cost, settlement_id AS l, first_bank_id AS r1, second_bank_id AS r2, x.cell AS cl, y.cell AS c1,
  z.cell AS c2, amount_diff_c
FROM ({edges}) e JOIN {leg_cells} x USING (settlement_id) JOIN {line_cells} y ON y.bank_txn_id = first_bank_id
JOIN {line_cells} z ON z.bank_txn_id = second_bank_id"""


def _walked_groups(edges: str, groups: str, lines: str) -> str:
    name = "concat_ws('|', order_id, merchant_id, payment_rail, currency)"
    group_cells = _cells(f"(SELECT *, {name} AS gid FROM {groups})", "gid", "merchant_id", "payment_rail", "currency", "expected_c",
                         "settlement_date", where="true")
    line_cells = _cells(lines, "bank_txn_id", "merchant_id", "payment_rail", "currency", "amount_c", "value_date", where="amount_c > 0")
    return f"""SELECT 0 AS cost, x.gid AS l, bank_txn_id AS r1, NULL::VARCHAR AS r2, x.cell AS cl, y.cell AS c1, NULL::VARCHAR AS c2,
  amount_diff_c, day_diff
FROM (SELECT *, {name} AS gid FROM ({edges})) e JOIN {group_cells} x USING (gid) JOIN {line_cells} y USING (bank_txn_id)"""


_TOKENS = ("list_sort(list_distinct(list_filter(regexp_split_to_array(upper(narration), '[^A-Z0-9_]+'), lambda w: w <> '')))")



def _named(ref: str) -> str:
    return (f"(regexp_matches({ref}, '[A-Z0-9_]') AND contains(upper(narration), {ref}) AND "
            f"regexp_matches(' ' || upper(narration) || ' ', '[^A-Z0-9_]' || regexp_escape({ref}) || '[^A-Z0-9_]'))")


_PAIR = "s.merchant_id = b.merchant_id AND s.payment_rail = b.payment_rail"
_FX = "(s.currency = b.currency OR s.has_expected)"
_TYPES = _tuple(texts.MATCHABLE_TYPES)


def _edges(legs: str, lines: str, sign: str = "net_c") -> str:
    return f"""SELECT s.settlement_id, b.bank_txn_id, abs(b.amount_c - s.recon_c) AS amount_diff_c,
  abs(b.value_date - s.settlement_date)::INT AS day_diff,
  abs(b.amount_c - s.recon_c) + 200 * abs(b.value_date - s.settlement_date) AS cost_c,
  b.narration, upper(s.order_id) AS ref
FROM {legs} s JOIN {lines} b ON {_PAIR} AND {_FX} AND sign(s.{sign}) = sign(b.amount_c) AND s.{sign} <> 0
WHERE abs(b.amount_c - s.recon_c) <= 1000 AND abs(b.value_date - s.settlement_date) <= 7"""


def _exact(legs: str, lines: str) -> str:
    return f"""SELECT s.settlement_id, b.bank_txn_id, abs(b.amount_c - s.recon_c) AS amount_diff_c,
  abs(b.value_date - s.settlement_date)::INT AS day_diff
FROM {legs} s JOIN {lines} b ON {_PAIR} AND {_FX} AND sign(s.net_c) = sign(b.amount_c)
WHERE abs(b.amount_c - s.recon_c) <= 300 AND abs(b.value_date - s.settlement_date) <= 3 AND {_named('upper(s.order_id)')}"""


def _splits(legs: str, lines: str) -> str:
    return f"""SELECT s.settlement_id, b.bank_txn_id AS first_bank_id, c.bank_txn_id AS second_bank_id,
  abs(b.amount_c + c.amount_c - s.recon_c) AS amount_diff_c
FROM {legs} s JOIN {lines} b ON {_PAIR} AND {_FX} AND sign(s.net_c) = sign(b.amount_c)
JOIN {lines} c ON c.merchant_id = b.merchant_id AND c.payment_rail = b.payment_rail AND sign(c.amount_c) = sign(b.amount_c)
  AND (s.currency = c.currency OR s.has_expected) AND b.bank_txn_id < c.bank_txn_id
WHERE abs(b.amount_c + c.amount_c - s.recon_c) <= 500 AND abs(b.value_date - s.settlement_date) <= 5
  AND abs(c.value_date - s.settlement_date) <= 5"""


_BASE, _ADJ = _tuple(texts.BASE_TYPES), _tuple(texts.ADJUSTMENT_TYPES)


def _groups(legs: str) -> str:
    return f"""SELECT merchant_id, payment_rail, currency, order_id, sum(net_c)::BIGINT AS expected_c,
  count(*) FILTER (type IN {_BASE}) AS base_legs, count(*) FILTER (type IN {_ADJ}) AS adjustment_legs,
  max(settlement_id) FILTER (type IN {_BASE}) AS base_id, max(settlement_date) FILTER (type IN {_BASE}) AS settlement_date
FROM {legs} WHERE (type IN {_BASE} OR type IN {_ADJ}) AND trim(order_id) <> '' GROUP BY ALL
HAVING count(*) FILTER (type IN {_BASE}) = 1 AND count(*) FILTER (type IN {_ADJ}) > 0"""


def _group_lines(groups: str, lines: str) -> str:
    return f"""SELECT s.*, b.bank_txn_id, b.value_date, abs(b.amount_c - s.expected_c) AS amount_diff_c,
  abs(b.value_date - s.settlement_date)::INT AS day_diff
FROM {groups} s JOIN {lines} b ON {_PAIR} AND s.currency = b.currency AND b.amount_c > 0
WHERE abs(b.amount_c - s.expected_c) <= 300 AND abs(b.value_date - s.settlement_date) <= 3"""


def _after(table: str, key: str, used: str) -> str:
    return f"SELECT * FROM {table} WHERE {key} NOT IN ({used})"


# ---- the cascade ---------------------------------------------------------

CASCADE = [
    *_greedy("exa", _walked(_exact("legs", "lines"), "0", _leg_cells("legs", "upper(order_id)"), _line_cells("lines", "upper(narration)"))),
    ("legs1", _after("legs", "settlement_id", "SELECT l FROM exa")),
    ("lines1", _after("lines", "bank_txn_id", "SELECT r1 FROM exa")),
    ("edges1", _edges("legs1", "lines1")),
    ("tied1", """SELECT settlement_id FROM (SELECT settlement_id, cost_c, row_number() OVER w AS rn, lead(cost_c) OVER w AS nxt
  FROM edges1 WINDOW w AS (PARTITION BY settlement_id ORDER BY cost_c)) WHERE rn = 1 AND nxt - cost_c <= 100"""),
    *_greedy("fuz", _walked("SELECT * FROM edges1", "cost_c", _leg_cells("legs1"), _line_cells("lines1"),
                            f"{_confidence('cost_c')} >= 85 AND settlement_id NOT IN (SELECT settlement_id FROM tied1)")),
    ("legs2", _after("legs1", "settlement_id", "SELECT l FROM fuz")),
    ("lines2", _after("lines1", "bank_txn_id", "SELECT r1 FROM fuz")),
    *_greedy("spl", _walked_pairs(_splits("legs2", "lines2"), _leg_cells("legs2"), _line_cells("lines2"))),
    ("legs3", _after("legs2", "settlement_id", "SELECT l FROM spl")),
    ("lines3", _after("lines2", "bank_txn_id", "SELECT r1 FROM spl UNION ALL SELECT r2 FROM spl")),
    ("groups3", _groups("legs3")),
    *_greedy("cyc", _walked_groups(_group_lines("groups3", "lines3"), "groups3", "lines3")),
    ("cyclegs", f"""SELECT g.settlement_id AS l, c.r1, c.amount_diff_c FROM legs3 g
  JOIN cyc c ON c.l = concat_ws('|', g.order_id, g.merchant_id, g.payment_rail, g.currency)
  WHERE g.type IN {_BASE} OR g.type IN {_ADJ}"""),
    ("links", f"""SELECT l AS settlement_id, 'exact' AS stage, r1 AS bank_ids, 99::BIGINT AS confidence_pct, amount_diff_c, day_diff FROM exa
UNION ALL SELECT l, 'fuzzy', r1, {_confidence('cost')}, amount_diff_c, day_diff FROM fuz
UNION ALL SELECT l, 'split', r1 || '+' || r2, 80, amount_diff_c, NULL FROM spl
UNION ALL SELECT l, 'lifecycle', r1, 98, amount_diff_c, NULL FROM cyclegs"""),
    ("decisions", """SELECT k.settlement_id, s.order_id, s.merchant_id, s.type, s.currency, s.recon_c, s.source_amount, s.exchange_rate,
  CASE WHEN stage = 'exact' AND s.currency <> 'INR' THEN 'fx_conversion' WHEN stage = 'exact' THEN 'exact_id'
       WHEN stage = 'fuzzy' THEN 'fuzzy_amount_date' WHEN stage = 'split' THEN 'split_bank_entries' ELSE 'lifecycle_adjustment' END AS match_type,
  bank_ids, confidence_pct, amount_diff_c, day_diff,
  CASE WHEN confidence_pct >= 85 THEN 'AUTO_ACCEPTED' ELSE 'NEEDS_REVIEW' END AS decision
FROM links k JOIN legs s USING (settlement_id)"""),
    ("unresolved", _after("legs", "settlement_id", "SELECT settlement_id FROM decisions")),
    ("unexplained", _after("lines", "bank_txn_id", "SELECT unnest(string_split(bank_ids, '+')) FROM decisions")),
    ("leg_exceptions", f"""SELECT 'settlement' AS entity_type, settlement_id, order_id, net_c, settlement_date,
  CASE {" ".join(f"WHEN type = {_quote(k)} THEN {_quote(v)}" for k, v in texts.REASON_BY_TYPE.items())}
   WHEN (SELECT count(*) FROM lines b WHERE {_PAIR} AND {_FX} AND (b.amount_c > 0) = (s.recon_c > 0)
     AND abs(b.amount_c - s.recon_c) <= 1000 AND abs(b.value_date - s.settlement_date) <= 7) > 1 THEN {_quote(texts.REASON_AMBIGUOUS)}
   WHEN NOT EXISTS (SELECT 1 FROM lines b WHERE {_PAIR} AND abs(b.value_date - s.settlement_date) <= 15)
     THEN CASE WHEN net_c < 0 THEN {_quote(texts.REASON_NO_DEBIT)} ELSE {_quote(texts.REASON_NO_CREDIT)} END
   ELSE {_quote(texts.REASON_OUTSIDE)} END AS reason
FROM unresolved s"""),
    ("ledger_exceptions", f"""SELECT 'ledger_record' AS entity_type, '' AS settlement_id, order_id, o.gross_c AS net_c, o.order_date AS settlement_date,
  format('Duplicate ledger entry detected: {{}} internal records but {{}} processor payment leg(s). The extra {{}} ledger record(s) were not treated as missing money.', n, p, n - 1) AS reason
FROM (SELECT order_id, count(*) AS n, max_by(gross_c, record_id) AS gross_c, max(order_date) AS order_date FROM ledger GROUP BY 1 HAVING count(*) > 1) o
JOIN (SELECT order_id, count(*) AS p FROM legs WHERE type IN {_BASE} GROUP BY 1) USING (order_id)"""),
    ("register", "SELECT * FROM leg_exceptions UNION ALL SELECT * FROM ledger_exceptions"),
    ("scored", """SELECT t.*, p.bank_ids, CASE
   WHEN should_match AND replace(p.bank_ids, '+', ';') = expected_bank_ids THEN 'TP' WHEN should_match AND p.bank_ids IS NOT NULL THEN 'FP_FN'
   WHEN should_match THEN 'FN' WHEN p.bank_ids IS NOT NULL THEN 'FP' ELSE 'TN' END AS result
FROM truth t LEFT JOIN decisions p USING (settlement_id)"""),
    ("gaps", """SELECT t.settlement_id, max(abs(b.value_date - t.settlement_date)) AS day_gap, sum(b.amount_c) AS paid
FROM (SELECT settlement_id, settlement_date, unnest(string_split(expected_bank_ids, ';')) AS id FROM truth WHERE should_match) t
JOIN lines b ON b.bank_txn_id = t.id GROUP BY 1"""),
    ("cases", f"""SELECT t.settlement_id, CASE
  WHEN NOT should_match THEN CASE WHEN type = 'duplicate_settlement' THEN 'Duplicate' WHEN contains(order_id, 'AMBIGUOUS') THEN 'Ambiguous candidate' ELSE 'Missing bank transaction' END
  WHEN type IN ('refund', 'partial_refund') THEN CASE WHEN (SELECT count(*) FROM legs x WHERE x.order_id = t.order_id AND x.type = 'partial_refund') > 1
    THEN 'Split refund' ELSE 'Partial refund' END
  WHEN type IN {_ADJ} OR contains(order_id, 'ADJUSTMENT') THEN 'Lifecycle adjustment'
  WHEN contains(order_id, 'AMBIGUOUS') THEN 'Ambiguous candidate'
  WHEN day_gap > 3 THEN 'Delayed settlement' WHEN paid <> net_c THEN 'Small amount discrepancy' ELSE 'Normal match' END AS case_type
FROM truth t LEFT JOIN gaps USING (settlement_id)"""),
    ("status", """SELECT s.*, x.reason, CASE WHEN x.settlement_id IS NOT NULL THEN 'exception' WHEN d.settlement_id IS NOT NULL THEN 'matched' ELSE 'unscored' END AS status,
  d.decision AS tier, d.match_type, d.bank_ids, CASE WHEN x.settlement_id IS NOT NULL THEN 0 ELSE d.confidence_pct END::BIGINT AS confidence_pct
FROM legs s LEFT JOIN decisions d USING (settlement_id) LEFT JOIN leg_exceptions x USING (settlement_id)"""),
    ("first_rows", "SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY record_id) = 1"),
    ("verdict_rows", """SELECT order_id, legs_n, resolved, duplicates, net_c, CASE WHEN legs_n = resolved THEN 'RECONCILED' WHEN resolved = 0 THEN 'UNRESOLVED' ELSE 'PARTIALLY RECONCILED' END AS status,
  CASE WHEN legs_n = 0 THEN 1 WHEN legs_n = resolved THEN round(least_pct::DECIMAL(18,0) / 100, 3) WHEN resolved = 0 THEN 0
    ELSE round(sum_pct::DECIMAL(18,0) / (legs_n * 100), 3) END::DECIMAL(5,3) AS confidence
FROM (SELECT f.order_id, count(*) FILTER (type <> 'duplicate_settlement') AS legs_n,
  count(*) FILTER (type <> 'duplicate_settlement' AND s.status = 'matched') AS resolved,
  count(*) FILTER (type = 'duplicate_settlement') AS duplicates,
  coalesce(sum(net_c) FILTER (type <> 'duplicate_settlement'), 0)::BIGINT AS net_c,
  min(confidence_pct) FILTER (type <> 'duplicate_settlement' AND s.status = 'matched') AS least_pct,
  sum(confidence_pct) FILTER (type <> 'duplicate_settlement' AND s.status = 'matched') AS sum_pct
  FROM first_rows f LEFT JOIN status s USING (order_id) GROUP BY 1)"""),
]

# ---- evidence ranking ----------------------------------------------------

EVIDENCE = [
    ("pool", f"SELECT * FROM legs WHERE type IN {_TYPES}"),
    ("edges", f"SELECT *, {_named('ref')} AS has_id FROM ({_edges('pool', 'lines', 'recon_c')})"),
    ("ranks", """SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY has_id DESC, cost_c, bank_txn_id) AS settlement_rank,
  row_number() OVER (PARTITION BY bank_txn_id ORDER BY has_id DESC, cost_c, settlement_id) AS bank_rank FROM edges"""),
    ("mutual", """SELECT settlement_id, bank_txn_id, has_id, cost_c,
  CASE WHEN s.currency <> 'INR' THEN 'fx_conversion' WHEN has_id AND amount_diff_c <= 300 AND day_diff <= 3 THEN 'exact_id' ELSE 'fuzzy_amount_date' END AS match_type,
  CASE WHEN has_id AND amount_diff_c <= 300 AND day_diff <= 3 THEN 9900 ELSE greatest(5500, floor((3000 - cost_c) * 10000 / 3000)) END::BIGINT AS confidence_bp,
  CASE WHEN (has_id AND amount_diff_c <= 300 AND day_diff <= 3) OR cost_c <= 450 THEN 'AUTO_ACCEPTED' ELSE 'NEEDS_REVIEW' END AS decision
FROM ranks JOIN legs s USING (settlement_id) WHERE settlement_rank = 1 AND bank_rank = 1"""),
    ("queue", """SELECT settlement_id, candidate_count, first_id FROM (
  SELECT settlement_id, count(*) AS candidate_count, min_by(bank_txn_id, (cost_c, bank_txn_id)) AS first_id FROM edges GROUP BY 1)
  LEFT JOIN mutual USING (settlement_id) WHERE decision = 'NEEDS_REVIEW' OR (decision IS NULL AND candidate_count > 1)"""),
    ("coarse", f"""SELECT settlement_id, type, 'EXCEPTION' AS decision, CASE {" ".join(f"WHEN type = {_quote(k)} THEN {_quote(v)}" for k, v in texts.COARSE_BY_TYPE.items())}
  ELSE {_quote(texts.COARSE_OTHER)} END AS reason FROM legs WHERE settlement_id NOT IN (SELECT settlement_id FROM mutual)"""),
    ("reviewed", """SELECT settlement_id, CASE WHEN kk % 2 = 0 THEN 'True' ELSE 'no' END AS approved, string_split(expected_bank_ids, ';')[1] AS actual_bank_txn_id
FROM (SELECT *, regexp_extract(settlement_id, '^SETL([0-9]+)-', 1)::BIGINT AS kk FROM truth) WHERE kk % 9 = 0 AND settlement_id LIKE '%-1' AND should_match"""),
    ("training", """SELECT e.settlement_id, e.bank_txn_id, amount_diff_c, day_diff, has_id, (e.bank_txn_id = actual_bank_txn_id)::BIGINT AS label
FROM edges e JOIN reviewed r ON r.settlement_id = e.settlement_id AND r.approved = 'True'"""),
]

#: Newton steps written out; later ones change nothing.
STEPS = 12


def _newton() -> list[tuple[str, str]]:
    """Logistic regression with a ridge of 1 on all but the intercept: sums by kind, then elimination, step by step."""
    def columns(width):
        return [(j, k) for j in range(4) for k in range(width)]

    out = [("kinds", """SELECT 1::DOUBLE AS x0, amount_diff_c::DOUBLE / 100 AS x1, day_diff::DOUBLE AS x2, has_id::INT::DOUBLE AS x3,
  count(*)::DOUBLE AS n, sum(label)::DOUBLE AS y FROM training GROUP BY ALL"""),
           ("newton0", "SELECT " + ", ".join(f"0::DOUBLE AS w{j}" for j in range(4)))]
    for i in range(STEPS):
        system = ", ".join(
            [f"sum(v * x{j} * x{k}) + {int(j == k and j > 0)} AS a{j}{k}" for j, k in columns(4)]
            + [f"sum(r * x{j}) - {int(j > 0)} * any_value(w{j}) AS a{j}4" for j in range(4)] + [f"any_value(w{j}) AS w{j}" for j in range(4)])
        text = f"""SELECT {system} FROM (SELECT *, n * p * (1 - p) AS v, y - n * p AS r
  FROM (SELECT *, 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2 + w3 * x3))) AS p FROM kinds, newton{i}))"""
        for c in range(3):
            text = "SELECT " + ", ".join(
                [f"a{j}{k} - a{j}{c} / a{c}{c} * a{c}{k} AS a{j}{k}" if j > c else f"a{j}{k}" for j, k in columns(5)]
                + [f"w{j}" for j in range(4)]) + f" FROM ({text})"
        for j in (3, 2, 1, 0):
            rest = "".join(f" - a{j}{k} * d{k}" for k in range(j + 1, 4))
            text = f"SELECT *, (a{j}4{rest}) / a{j}{j} AS d{j} FROM ({text})"
        out.append((f"newton{i + 1}", "SELECT " + ", ".join(f"w{j} + d{j} AS w{j}" for j in range(4)) + f" FROM ({text})"))
    return out


EVIDENCE += _newton()

_KEY = "regexp_extract(settlement_id, '^SETL([0-9]+)-', 1)::BIGINT"
_EVENT = "concat_ws('|', merchant_id, payment_rail, settlement_id, order_id, type, currency, {net}::VARCHAR, recon_c::VARCHAR, settlement_date::VARCHAR)"
_HASH = f"sha256({_EVENT.format(net='net_c')})"
_PRICE = "CASE WHEN o_orderkey % 5 = 0 THEN '  ' WHEN o_orderkey % 5 = 1 THEN 'n/a' ELSE o_totalprice::VARCHAR || '5' END"
_CENTS = "round(o_totalprice * 100)::BIGINT"
_EPOCH = "(o_orderdate::DATE - DATE '1970-01-01')::BIGINT * 86400 + o_orderkey % 86400"

_CATEGORY = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(reason), {_quote(w)})" for w in words) + f" THEN {_quote(name)}"
    for words, name in texts.CATEGORY_RULES) + f" ELSE {_quote(texts.CATEGORY_OTHER)} END"

_NOTES = f"""CASE match_type WHEN 'fx_conversion' THEN 'Converted: ' || source_amount || ' ' || currency || ' times ' || exchange_rate
    || ' is ₹' || {_money_text('recon_c')} || ', and the narration names the order.'
  WHEN 'exact_id' THEN {_quote(texts.NOTE_EXACT)} WHEN 'split_bank_entries' THEN {_quote(texts.NOTE_SPLIT)}
  WHEN 'fuzzy_amount_date' THEN 'Best open line by amount (off by ₹' || {_money_text('amount_diff_c')} || ') and day (off by ' || day_diff || ').'
  ELSE 'Part of an order paid in one credit: ' || CASE WHEN type IN {_BASE} THEN 'base leg' ELSE replace(type, '_', ' ') END
    || '.' END"""

_LABEL = _case("type", texts.LEG_LABELS, "type")
_SIZE = f"'₹' || {_money_text('abs(net_c)')}"


def _r(c):
    return f"'₹' || {_money_text(c)}"


_EVENTS = [
    (f"type IN {_BASE}", "order_date", 1, "'captured'", f"'Processor took ' || {_r('gross_c')} || CASE WHEN type = 'split_payment' THEN ', a part of the payment' ELSE '' END"),
    (f"type IN {_BASE} AND fee_c + tax_c > 0", "order_date", 2, "'fee'", f"{_r('(fee_c + tax_c)')} || ' withheld: fee ' || {_r('fee_c')} || ', tax ' || {_r('tax_c')}"),
    ("type = 'duplicate_settlement'", "settlement_date", 3, "'duplicate'", f"'Second notice of ' || {_r('net_c')} || ', no money behind it.'"),
    (f"type IN {_tuple(texts.REVERSAL_TYPES)}", "settlement_date", 4, "CASE WHEN type = 'chargeback' THEN 'chargeback' ELSE 'refund_initiated' END",
     f"CASE WHEN type = 'chargeback' THEN 'Charged back: ' || {_SIZE} || ', not a refund' ELSE {_LABEL} || ' of ' || {_SIZE} || ' started' END"),
    (f"type IN {_ADJ}", "settlement_date", 4, "'adjustment'", f"{_LABEL} || ': ' || CASE WHEN net_c > 0 THEN '+' ELSE '' END || {_r('net_c')}"),
    ("type <> 'duplicate_settlement' AND status = 'matched'", "settlement_date", 5, "'bank_matched'",
     f"CASE WHEN type = 'chargeback' THEN 'Charged back at the bank' WHEN net_c < 0 THEN 'Paid back at the bank' ELSE 'Paid in at the bank' END || ': ' || {_SIZE} || ' on ' || bank_ids || ' (' || match_type || ', ' || confidence_pct || '%): ' || notes"),
    ("type <> 'duplicate_settlement' AND status <> 'matched'", "settlement_date", 5, "'unresolved'",
     f"'Nothing at the bank for ' || lower({_LABEL}) || ' of ' || {_SIZE} || ': ' || reason"),
]
_TIMELINE = ("SELECT order_id, order_date AS event_date, '' AS settlement_id, 0 AS step, 'order_placed' AS kind, 'Order over ' || "
             + _r("gross_c") + " AS text FROM first_rows UNION ALL "
             + " UNION ALL ".join(
                 f"SELECT order_id, {day} AS event_date, settlement_id, {step} AS step, {kind} AS kind, {text} AS text FROM (SELECT s.*, f.order_date, n.notes FROM status s JOIN first_rows f USING (order_id) LEFT JOIN (SELECT settlement_id, {_NOTES} AS notes FROM decisions) n USING (settlement_id)) WHERE {cond}"
                 for cond, day, step, kind, text in _EVENTS))
_NARRATIVE = f"""SELECT order_id, 0 AS part, '' AS settlement_id, 'Every leg has its line.' AS text FROM verdict_rows WHERE status = 'RECONCILED'
UNION ALL SELECT order_id, 1, '', 'Net of all legs: ' || {_r('net_c')} || '.' FROM verdict_rows
UNION ALL SELECT order_id, 2, '', 'Repeated notices are left out.' FROM verdict_rows WHERE duplicates > 0
UNION ALL SELECT order_id, 3, settlement_id, 'Still open: ' || {_LABEL} || ' (' || {_SIZE} || '): ' || reason FROM status WHERE type <> 'duplicate_settlement' AND status <> 'matched'"""

_STAGE_COLS = "l AS settlement_id, r1 AS bank_ids"

BODIES = {
    "source_scan": "SELECT settlement_id, order_id, merchant_id, payment_rail, currency, type, gross_c, fee_c, tax_c, net_c, recon_c, has_expected, settlement_date FROM legs",
    "conform_defaults": "SELECT record_id, order_id, 'default' AS merchant_id, 'default' AS payment_rail, 'INR' AS currency FROM ledger",
    "money_quantise": f"SELECT o_orderkey, (TRY_CAST({_PRICE} AS DECIMAL(18,2)) * 100)::BIGINT AS amount_c, CASE WHEN o_orderkey % 5 <> 1 THEN o_orderdate::DATE END AS order_date FROM orders",
    "blank_default": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'default' ELSE o_orderstatus END AS status FROM orders",
    "recon_amount": "SELECT settlement_id, recon_c FROM legs",
    "block_keys": "SELECT settlement_id, abs(recon_c) // 1000 AS amount_bucket, ((settlement_date - DATE '1970-01-01') // 7)::BIGINT AS date_bucket FROM legs",
    "narration_normalise": "SELECT bank_txn_id, regexp_replace(upper(narration), '[^A-Z0-9]', '', 'g') AS narration_normalized FROM lines",
    "rejected_rows": f"""SELECT 'settlements' AS source, settlement_id AS row_id, 'net_amount' AS "column", '₹' || {_money_text('net_c')} AS raw
FROM legs WHERE net_c % 97 = 0
UNION ALL SELECT 'settlements', settlement_id, 'settlement_date', '01/03/2024' FROM legs WHERE gross_c % 89 = 0""",
    "duplicate_ids": """SELECT 'bank' AS source, bank_txn_id AS row_id, CASE WHEN amount_c % 62 = 0 THEN 3 ELSE 2 END::BIGINT AS copies
FROM lines WHERE amount_c % 31 = 0""",
    "narration_tokens": f"SELECT bank_txn_id, array_to_string({_TOKENS}, ' ') AS tokens FROM lines",
    "event_fingerprint": f"SELECT settlement_id, {_HASH} AS event_hash FROM legs",
    "bank_id_sets": "SELECT settlement_id, array_to_string(list_sort(list_distinct(list_append(list_filter(string_split(expected_bank_ids, ';'), lambda x: x <> ''), 'ZZ'))), '+') AS bank_ids, len(list_filter(string_split(expected_bank_ids, ';'), lambda x: x <> ''))::BIGINT AS n, should_match AS matched FROM truth",
    "minor_units": f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN -{_CENTS} ELSE {_CENTS} END AS net_c, DATE '1970-01-01' + (CASE WHEN o_orderkey % 4 > 1 THEN ({_EPOCH}) // 86400 ELSE ({_EPOCH} + 86400) // 86400 END)::INT AS settlement_date FROM orders",
    "type_mapping": "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 1 THEN 'refund' WHEN 2 THEN 'settlement_adjustment' WHEN 3 THEN 'transfer' ELSE 'settlement' END AS type FROM orders",
    "fee_derivation": f"SELECT o_orderkey, fee_c, tax_c, c - fee_c - tax_c AS net_c FROM (SELECT *, (18 * fee_c + 50) // 100 AS tax_c FROM (SELECT o_orderkey, {_CENTS} AS c, (2 * {_CENTS} + 50) // 100 AS fee_c FROM orders))",
    "confidence_score": f"SELECT settlement_id, bank_txn_id, {_confidence('cost_c')} AS confidence_pct FROM edges",
    "match_labels": f"SELECT settlement_id, match_type, {_NOTES} AS notes FROM decisions",
    "leg_labels": f"SELECT settlement_id, {_LABEL} AS label FROM legs",
    "exception_category": f"SELECT {_CATEGORY} AS category, count(*) AS exceptions FROM leg_exceptions GROUP BY 1",
    "match_type_display": f"SELECT settlement_id, {_case('match_type', texts.MATCH_DISPLAY, 'match_type')} AS display_name FROM decisions",
    "direction_pools": "SELECT sign(net_c)::INT AS direction, count(*) AS legs, sum(net_c)::BIGINT AS net_c FROM legs WHERE net_c <> 0 GROUP BY 1",
    "exact_id_candidates": _exact("legs", "lines"),
    "candidate_edges": f"SELECT settlement_id, bank_txn_id, amount_diff_c, day_diff, cost_c FROM ({_edges('legs', 'lines')})",
    "candidate_ranks": "SELECT settlement_id, bank_txn_id, has_id, cost_c, settlement_rank::INT AS settlement_rank, bank_rank::INT AS bank_rank FROM ranks",
    "candidate_sets": "SELECT settlement_id, max(n) AS candidate_count, string_agg(cost_c || ':' || bank_txn_id, ' ' ORDER BY cost_c, bank_txn_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY cost_c, bank_txn_id) AS rn, count(*) OVER (PARTITION BY settlement_id) AS n FROM edges) WHERE rn <= 5 GROUP BY 1",
    "ambiguous_settlements": f"SELECT settlement_id FROM (SELECT settlement_id, cost_c, row_number() OVER w AS rn, lead(cost_c) OVER w AS nxt FROM ({_edges('legs', 'lines')}) WINDOW w AS (PARTITION BY settlement_id ORDER BY cost_c)) WHERE rn = 1 AND nxt - cost_c <= 100",
    "lifecycle_groups": f"SELECT merchant_id, order_id, expected_c, base_legs, adjustment_legs, base_id, settlement_date FROM ({_groups('legs')})",
    "lifecycle_candidates": f"SELECT order_id, merchant_id, bank_txn_id, expected_c, value_date, amount_diff_c, day_diff FROM ({_group_lines('(' + _groups('legs') + ')', 'lines')})",
    "split_candidates": _splits("legs", "lines"),
    "fx_evidence": f"SELECT settlement_id, bank_txn_id, amount_diff_c, day_diff, cost_c FROM ({_edges('legs', 'lines')}) WHERE settlement_id IN (SELECT settlement_id FROM legs WHERE currency <> 'INR')",
    "blocking_efficiency": """SELECT sign(s.recon_c)::INT AS direction, count(*) AS blocked_pairs FROM legs s JOIN lines b ON s.merchant_id = b.merchant_id AND s.payment_rail = b.payment_rail
  AND sign(s.recon_c) = sign(b.amount_c) AND abs(abs(s.recon_c) // 1000 - abs(b.amount_c) // 1000) <= 1
  AND abs((s.settlement_date - DATE '1970-01-01') // 7 - (b.value_date - DATE '1970-01-01') // 7) <= 1 GROUP BY 1""",
    "edge_audit": f"SELECT settlement_id, bank_txn_id, settlement_rank = 1 AS selected_by_settlement, bank_rank = 1 AS selected_by_bank, CASE WHEN settlement_rank = 1 AND bank_rank = 1 THEN 'SELECTED' ELSE 'REJECTED' END AS candidate_disposition, CASE WHEN settlement_rank > 1 THEN {_quote(texts.REJECTED_BY_LEG)} WHEN bank_rank > 1 THEN {_quote(texts.REJECTED_BY_LINE)} END AS rejection_reason FROM ranks",
    "greedy_assignment": "SELECT l AS settlement_id, r1 AS bank_txn_id, cost AS cost_c FROM allg",
    "greedy_increment": "SELECT l AS settlement_id, r1 AS bank_txn_id, cost AS cost_c FROM allg",
    "mutual_best_match": "SELECT settlement_id, bank_txn_id, match_type, confidence_bp, decision, cost_c, has_id FROM mutual",
    "exact_id_match": f"SELECT {_STAGE_COLS}, 99::BIGINT AS confidence_pct, amount_diff_c FROM exa",
    "fuzzy_match": f"SELECT {_STAGE_COLS}, {_confidence('cost')} AS confidence_pct, amount_diff_c FROM fuz",
    "split_match": "SELECT l AS settlement_id, r1 || '+' || r2 AS bank_ids, 80::BIGINT AS confidence_pct, amount_diff_c FROM spl",
    "lifecycle_match": f"SELECT {_STAGE_COLS}, 98::BIGINT AS confidence_pct, amount_diff_c FROM cyclegs",
    "reconcile_cascade": "SELECT settlement_id, order_id, merchant_id, match_type, bank_ids, confidence_pct, amount_diff_c, decision FROM decisions",
    "decision_tiers": "SELECT match_type, decision, count(*) AS links, sum(amount_diff_c)::BIGINT AS amount_diff_c FROM decisions GROUP BY ALL",
    "exception_reasons": "SELECT settlement_id, order_id, net_c, settlement_date, reason FROM leg_exceptions",
    "exception_reasons_coarse": "SELECT * FROM coarse",
    "exception_register": "SELECT * FROM register",
    "unexplained_bank": "SELECT bank_txn_id, amount_c, value_date, narration FROM unexplained",
    "ledger_duplicates": "SELECT l.merchant_id, order_id, l.records, 'Duplicate ledger records: ' || l.records || ' entries share this order ID.' AS reason, x.net_c, x.reason AS paid_reason FROM (SELECT merchant_id, order_id, count(*) AS records FROM ledger GROUP BY ALL HAVING count(*) > 1) l LEFT JOIN ledger_exceptions x USING (order_id)",
    "ledger_first": "SELECT order_id, record_id, customer, gross_c, order_date FROM first_rows",
    "replay_dedup": f"""SELECT {_HASH} AS event_hash, settlement_id || '/' || copy AS source_row, CASE WHEN copy = 1 THEN 'KEPT' ELSE 'REPLAY' END AS outcome
FROM (SELECT *, unnest(range(1, CASE WHEN {_KEY} % 180 = 30 THEN 5 WHEN {_KEY} % 90 = 30 THEN 3 ELSE 2 END)) AS copy FROM legs)""",
    "idempotent_increment": f"""SELECT settlement_id, net2 AS net_c FROM (SELECT *, CASE WHEN {_KEY} % 11 = 0 THEN net_c + 100 ELSE net_c END AS net2 FROM legs)
WHERE sha256({_EVENT.format(net='net2')}) NOT IN (SELECT {_HASH} FROM legs WHERE settlement_id IN (SELECT settlement_id FROM mutual))""",
    "run_summary": """SELECT (SELECT count(*) FROM legs) AS total_settlements, count(*) AS matched_count,
  round(count(*)::DECIMAL(18,0) * 100 / (SELECT count(*) FROM legs), 1)::DECIMAL(18,1) AS match_rate_pct,
  count(*) FILTER (decision = 'AUTO_ACCEPTED') AS auto_accepted_count, count(*) FILTER (decision = 'NEEDS_REVIEW') AS needs_review_count,
  (SELECT count(*) FROM register) AS exception_count, (SELECT count(*) FROM unexplained) AS unexplained_count FROM decisions""",
    "run_counters": "SELECT 'legs' AS table_name, count(*) AS row_count FROM legs UNION ALL SELECT 'lines', count(*) FROM lines UNION ALL SELECT 'candidate_edges', count(*) FROM edges UNION ALL SELECT 'accepted', count(*) FROM mutual UNION ALL SELECT 'review_queue', count(*) FROM queue UNION ALL SELECT 'exceptions', count(*) FROM coarse",
    "match_breakdown": f"SELECT match_type, count(*) AS matches, {_case('match_type', texts.MATCH_DISPLAY, 'match_type')} AS display_name FROM decisions GROUP BY match_type",
    "review_queue": f"SELECT settlement_id, candidate_count, 'NEEDS_REVIEW' AS decision, {_quote(texts.QUEUE_REASON)} AS queue_reason, {_quote(CFG.policy_version)} AS policy_version FROM queue",
    "review_batch": "SELECT settlement_id, candidate_count FROM queue ORDER BY settlement_id LIMIT 50",
    "review_labels": f"SELECT *, approved = 'True' AS is_approved, DATE '{RUN_DATE}' AS event_date FROM reviewed",
    "candidate_packs": f"""SELECT u.settlement_id, u.pack_size, a.bank_txn_id, a.confidence_pct, a.match_type FROM (
  SELECT s.settlement_id, count(*) AS pack_size FROM unresolved s JOIN unexplained b ON {_PAIR} AND abs(b.value_date - s.settlement_date) <= 15 GROUP BY 1) u
LEFT JOIN (SELECT min(s.settlement_id) AS settlement_id, b.bank_txn_id, least(arg_min(s.conf, s.settlement_id), 79)::BIGINT AS confidence_pct, 'llm_review_candidate' AS match_type
  FROM (SELECT *, kk % 60 + 40 AS conf, 'BANK' || kk || CASE kk % 3 WHEN 0 THEN '-9' WHEN 1 THEN '-11' ELSE '-1' END AS want
        FROM (SELECT *, {_KEY} AS kk FROM unresolved)) s
  JOIN unexplained b ON {_PAIR} AND b.bank_txn_id = s.want AND abs(b.value_date - s.settlement_date) <= 15
  WHERE s.conf >= 60 GROUP BY b.bank_txn_id) a USING (settlement_id)""",
    "recommendation_gate": f"""SELECT settlement_id, CASE WHEN {_KEY} % 4 = 0 THEN first_id END AS recommended_bank_txn_id,
  CASE {_KEY} % 4 WHEN 0 THEN 'closest' WHEN 1 THEN 'no evidence' WHEN 2 THEN {_quote(texts.GATE_UNKNOWN_ID)} ELSE {_quote(texts.GATE_MALFORMED)} END AS reason,
  {_quote(texts.ADVICE)} AS decision FROM queue""",
    "ranker_training_set": "SELECT * FROM training",
    "ranker_scores": f"""SELECT settlement_id, bank_txn_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY settlement_id ORDER BY score DESC, bank_txn_id) AS model_rank
FROM (SELECT settlement_id, bank_txn_id, 1 / (1 + exp(-(w0 + w1 * (amount_diff_c::DOUBLE / 100) + w2 * day_diff + w3 * has_id::INT))) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY cost_c, bank_txn_id) AS place FROM edges
        WHERE settlement_id IN (SELECT settlement_id FROM queue)), newton{STEPS} WHERE place <= 5)""",
    "ranker_class_balance": "SELECT label, count(*) AS examples FROM training GROUP BY 1",
    "evaluation_outcomes": "SELECT settlement_id, expected_outcome, result FROM scored",
    "precision_recall": """SELECT count(*) AS total_records, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, forced AS incorrect_forced_matches,
  round(tp::DECIMAL(18,0) / nullif(tp + fp, 0), 3)::DECIMAL(5,3) AS precision, round(tp::DECIMAL(18,0) / nullif(tp + fn, 0), 3)::DECIMAL(5,3) AS recall,
  round(linked::DECIMAL(18,0) * 100 / n, 1)::DECIMAL(18,1) AS match_rate_pct FROM (SELECT count(*) FILTER (result = 'TP') AS tp, count(*) FILTER (result IN ('FP', 'FP_FN')) AS fp,
  count(*) FILTER (result IN ('FN', 'FP_FN')) AS fn, count(*) FILTER (result = 'TN') AS tn, count(*) FILTER (result = 'FP_FN') AS forced, count(bank_ids) AS linked, count(*) AS n FROM scored)""".replace("SELECT count(*) AS total_records", "SELECT n AS total_records"),
    "auto_accept_precision": """SELECT n AS auto_accept_count, tp AS auto_true_positives, n - tp AS auto_false_positives, round(tp::DECIMAL(18,0) / nullif(n, 0), 3)::DECIMAL(5,3) AS auto_accept_precision
FROM (SELECT count(*) AS n, count(*) FILTER (result = 'TP') AS tp FROM scored JOIN decisions USING (settlement_id) WHERE decision = 'AUTO_ACCEPTED')""",
    "case_types": "SELECT * FROM cases",
    "evaluation_by_case": "SELECT case_type, count(*) AS total, count(*) FILTER (result = 'TP') AS true_positives, count(*) FILTER (result IN ('FN', 'TN')) AS exceptions, count(*) FILTER (result IN ('FP', 'FP_FN')) AS incorrect_forced_matches FROM scored JOIN cases USING (settlement_id) GROUP BY 1",
    "leg_status": "SELECT settlement_id, status, tier, match_type, confidence_pct FROM status",
    "story_timeline": _TIMELINE,
    "story_verdicts": "SELECT order_id, legs_n AS legs, resolved, duplicates, net_c, status, confidence, CASE status WHEN 'UNRESOLVED' THEN 0 WHEN 'PARTIALLY RECONCILED' THEN 1 ELSE 2 END AS severity FROM verdict_rows",
    "open_stories": "SELECT order_id, status, 0 AS severity FROM verdict_rows WHERE status = 'UNRESOLVED'",
    "edge_preview": f"""SELECT settlement_id, bank_txn_id, amount_diff_c, day_diff, cost_c FROM ({_edges('legs', 'lines')})
ORDER BY cost_c, settlement_id, bank_txn_id LIMIT 100""",
    "story_narrative": _NARRATIVE,
    "story_portfolio": "SELECT status, count(*) AS stories, round(sum(confidence) / count(*), 3)::DECIMAL(5,3) AS mean_confidence FROM verdict_rows GROUP BY 1",
}

_ALL = _greedy("allg", f"""SELECT cost_c AS cost, settlement_id AS l, bank_txn_id AS r1, NULL::VARCHAR AS r2, settlement_id AS cl,
  bank_txn_id AS c1, NULL::VARCHAR AS c2 FROM ({_edges('legs', 'lines')})""")


@cache
def oracle_sql() -> dict[str, str]:
    return {name: with_tables(body, *CASCADE, *EVIDENCE, *_ALL) for name, body in BODIES.items()}


def leftover_sql() -> dict[str, str]:
    """Candidates still open after the unrolled rounds; must be empty."""
    return {name: with_tables(f"SELECT count(*) FROM {name}_e{ROUNDS}", *CASCADE, *EVIDENCE, *_ALL)
            for name in ("exa", "fuz", "spl", "cyc", "allg")}
