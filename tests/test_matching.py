"""Stages against a plain sequential walk on small, dense, copy-rich data."""

import datetime as dt
import hashlib
import itertools
import random

import pytest

from ledgerloom.config import DEFAULT
from ledgerloom.operators import evidence, matching
from ledgerloom.operators.greedy import greedy_match

LEG = ("settlement_id string, order_id string, merchant_id string, payment_rail string, currency string, type string, "
       "gross_c bigint, fee_c bigint, tax_c bigint, net_c bigint, recon_c bigint, has_expected boolean, "
       "source_amount string, exchange_rate string, settlement_date date")
LINE = ("bank_txn_id string, merchant_id string, payment_rail string, currency string, amount_c bigint, "
        "value_date date, narration string")
DAY = dt.date(2024, 3, 1)


def make_legs(rows):
    """rows: (id, order, cents, day, type)"""
    return [(i, o, "m", "r", "INR", t, c, 0, 0, c, c, False, None, None, DAY + dt.timedelta(d)) for i, o, c, d, t in rows]


def make_lines(rows):
    """rows: (id, cents, day, narration)"""
    return [(i, "m", "r", "INR", c, DAY + dt.timedelta(d), n) for i, c, d, n in rows]


def frames(spark, legs, lines):
    return spark.createDataFrame(make_legs(legs), LEG), spark.createDataFrame(make_lines(lines), LINE)


def links(df):
    return {(r.settlement_id, *r.bank_ids) for r in df.collect()}


def fits(leg, line, cents, days):
    return abs(leg[2] - line[1]) <= cents and abs(leg[3] - line[2]) <= days


def named(rows, *same):
    """The cell of every row: the first row that only the identifier tells it from."""
    first = {}
    for row in sorted(rows):
        first.setdefault(tuple(f(row) for f in same), row[0])
    return {row[0]: first[tuple(f(row) for f in same)] for row in rows}


def cells_of(legs, lines, exact=False):
    """Cells of legs and of lines, as the stages see them."""
    left = named(legs, lambda l: l[2], lambda l: l[3], *([lambda l: l[1]] if exact else []))
    right = named(lines, lambda b: b[1], lambda b: b[2], *([lambda b: b[3].upper()] if exact else []))
    return left | right


def turn(cells, left, *right):
    ends = sorted(cells[r] for r in right)
    return hashlib.md5("|".join([cells[left], *ends]).encode()).hexdigest()


def walk(edges, cells=None):
    """``edges`` are (left, *right) or, with ``cells``, (cost, left, *right) in any order."""
    if cells is not None:
        edges = [e[1:] for e in sorted(edges, key=lambda e: (e[0], turn(cells, *e[1:]), e[1:]))]
    used, out = set(), set()
    for edge in edges:
        ends = [("l", edge[0]), *[("r", x) for x in edge[1:]]]
        if not used & set(ends):
            used |= set(ends)
            out.add(tuple(edge))
    return out


def data(seed, n_legs, n_lines, amounts, days, orders=4):
    rng = random.Random(seed)
    ids = [f"S{i:03d}" for i in range(n_legs)]
    rng.shuffle(ids)
    legs = [(i, f"ORD{rng.randrange(orders)}", rng.choice(amounts), rng.randrange(days), "settlement") for i in ids]
    bids = [f"B{i:03d}" for i in range(n_lines)]
    rng.shuffle(bids)
    lines = [(i, rng.choice(amounts), rng.randrange(days), f"NEFT/ORD{rng.randrange(orders)}/ORD{rng.randrange(orders)}") for i in bids]
    return legs, lines


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_equals_walk(spark, seed):
    legs, lines = data(seed, 40, 40, [10000, 10200, 10500, 20000], 5)
    edges = [(0, l[0], b[0]) for l in legs for b in lines if l[1] in b[3].split("/") and fits(l, b, 300, 3)]
    assert links(matching.exact_id_match(*frames(spark, legs, lines))) == walk(edges, cells_of(legs, lines, exact=True))


def fuzzy_walk(legs, lines):
    edges = sorted((abs(l[2] - b[1]) + 200 * abs(l[3] - b[2]), l[0], b[0])
                   for l in legs for b in lines if fits(l, b, 1000, 7))
    tied = set()
    for leg in legs:
        costs = [e[0] for e in edges if e[1] == leg[0]]
        if len(costs) > 1 and costs[1] - costs[0] <= 100:
            tied.add(leg[0])
    return walk([e for e in edges if e[1] not in tied and e[0] <= DEFAULT.fuzzy_cost_cut], cells_of(legs, lines)), tied


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_fuzzy_equals_walk(spark, seed):
    # Copies of legs compete for one near line, then for a group of copies.
    rng = random.Random(seed)
    legs = [(f"S{i:02d}", "O", 99900 + rng.choice([0, 0, 0, 150]), 3, "settlement") for i in rng.sample(range(100), 30)]
    lines = [("B90", 99900, 3, "")] + [(f"B{i:02d}", 99900 + rng.choice([210, 210, 340]), 3, "") for i in rng.sample(range(90), 20)]
    want, tied = fuzzy_walk(legs, lines)
    pair = frames(spark, legs, lines)
    assert links(matching.fuzzy_match(*pair)) == want
    assert {r.settlement_id for r in matching.ambiguous_settlements(*pair).collect()} == tied


@pytest.mark.parametrize("seed", [6, 7])
def test_fuzzy_sparse_equals_walk(spark, seed):
    legs, lines = data(seed, 60, 60, list(range(10000, 16000, 130)), 6)
    want, _ = fuzzy_walk(legs, lines)
    assert links(matching.fuzzy_match(*frames(spark, legs, lines))) == want


@pytest.mark.parametrize("seed,amounts", [(8, [5000, 5100, 10000, 10300]), (9, list(range(1000, 9000, 170)))])
def test_split_equals_walk(spark, seed, amounts):
    legs, lines = data(seed, 14, 24, amounts, 9)
    triples = sorted((l[0], *sorted((a[0], b[0]))) for l in legs for a, b in itertools.combinations(lines, 2)
                     if abs(a[1] + b[1] - l[2]) <= 500 and abs(a[2] - l[3]) <= 5 and abs(b[2] - l[3]) <= 5)
    pair = frames(spark, legs, lines)
    found = [(r.settlement_id, r.first_bank_id, r.second_bank_id) for r in matching.split_candidates(*pair).collect()]
    assert sorted(found) == triples
    assert links(matching.split_match(*pair)) == walk([(0, *t) for t in triples], cells_of(legs, lines))


def test_lifecycle_equals_walk(spark):
    rng = random.Random(10)
    legs, lines = [], []
    for i in rng.sample(range(40), 12):
        legs += [(f"S{i:02d}a", f"O{i:02d}", 50000, 2, "settlement"),
                 (f"S{i:02d}b", f"O{i:02d}", -5000, 4, "settlement_adjustment")]
    legs.append(("S99", "O99", 50000, 2, "settlement"))
    lines = [(f"B{i}", 45000 + rng.choice([0, 0, 200, 400]), rng.randrange(7), "") for i in range(9)]
    groups = [(f"{o}|m|r|INR", 45000, 2) for o in {l[1] for l in legs if l[1] != "O99"}]
    edges = [(0, g[0], b[0]) for g in groups for b in lines if abs(b[1] - 45000) <= 300 and abs(b[2] - 2) <= 3]
    cells = named(groups, lambda g: g[1]) | named(lines, lambda b: b[1], lambda b: b[2])
    won = {g.split("|")[0]: b for g, b in walk(edges, cells)}
    want = {(l[0], won[l[1]]) for l in legs if l[1] in won}
    assert links(matching.lifecycle_match(*frames(spark, legs, lines))) == want


@pytest.mark.parametrize("seed", [11, 12])
def test_mutual_best_equals_ranks(spark, seed):
    legs, lines = data(seed, 50, 50, [10000, 10200, 10500, 10600], 5, orders=20)
    pair = frames(spark, legs, lines)
    edges = [(b[0], l[0], l[1] not in b[3].split("/"), abs(l[2] - b[1]) + 200 * abs(l[3] - b[2]))
             for l in legs for b in lines if fits(l, b, 1000, 7)]
    best_leg, best_line = {}, {}
    for bid, sid, no_id, cost in edges:
        best_leg[sid] = min(best_leg.get(sid, (2,)), (no_id, cost, bid))
        best_line[bid] = min(best_line.get(bid, (2,)), (no_id, cost, sid))
    want = {(s, v[2]) for s, v in best_leg.items() if best_line[v[2]][2] == s}
    got = {(r.settlement_id, r.bank_txn_id) for r in evidence.mutual_best(*pair).collect()}
    assert got == want
    rows = evidence.edge_audit(evidence.evidence_edges(*pair)).collect()
    assert len(rows) == len(edges)
    assert {(r.settlement_id, r.bank_txn_id) for r in rows if r.candidate_disposition == "SELECTED"} == want


@pytest.mark.parametrize("seed", [13, 14])
def test_greedy_equals_walk_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = {(f"L{rng.randrange(25)}", f"R{rng.randrange(25)}"): rng.randrange(6) for _ in range(120)}
    rows = [(l, r, c) for (l, r), c in edges.items()]
    want = walk([(c, l, r) for l, r, c in rows], {x: x for row in rows for x in row[:2]})
    got = greedy_match(spark.createDataFrame(rows, "l string, r string, c bigint"), "l", "r", "c").collect()
    assert {(r.l, r.r) for r in got} == want


def test_order_of_input_rows_does_not_matter(spark):
    legs, lines = data(15, 30, 30, [10000, 10200, 10400], 4)
    first = links(matching.exact_id_match(*frames(spark, legs, lines)))
    second = links(matching.exact_id_match(*frames(spark, legs[::-1], lines[::-1])))
    assert first == second


@pytest.mark.parametrize("gap,days,linked", [(300, 3, True), (301, 3, False), (300, 4, False)])
def test_tight_bounds(spark, gap, days, linked):
    pair = frames(spark, [("S", "ORD1", 9990, 0, "settlement")], [("B", 9990 + gap, days, "X/ORD1")])
    assert bool(links(matching.exact_id_match(*pair))) is linked


@pytest.mark.parametrize("gap,days,linked", [(1000, 7, True), (1001, 0, False), (0, 8, False), (-1000, -7, True)])
def test_fuzzy_bounds(spark, gap, days, linked):
    pair = frames(spark, [("S", "ORD1", 1999, 0, "settlement")], [("B", 1999 + gap, days, "")])
    assert bool(matching.candidate_edges(*pair).count()) is linked


def test_whole_words_only(spark):
    pair = frames(spark, [("S", "ORD100", 100, 0, "settlement"), ("T", "ORD1_X", 100, 0, "settlement"), ("U", "", 100, 0, "settlement")],
                  [("B", 100, 0, "NEFT/ORD1001"), ("C", 100, 0, "pay ord1_x now")])
    assert links(matching.exact_id_match(*pair)) == {("T", "C")}


def _many(spark, n, amounts, order="'ORD1'"):
    legs = spark.range(n).selectExpr(
        "concat('S', lpad(id, 8, '0')) AS settlement_id", f"{order} AS order_id", "'m' AS merchant_id", "'r' AS payment_rail",
        "'INR' AS currency", "'settlement' AS type", "0L AS gross_c", "0L AS fee_c", "0L AS tax_c",
        f"{amounts} AS net_c", f"{amounts} AS recon_c", "false AS has_expected", "CAST(NULL AS STRING) AS source_amount",
        "CAST(NULL AS STRING) AS exchange_rate", "date'2024-03-01' AS settlement_date")
    lines = spark.range(n).selectExpr(
        "concat('B', lpad(id, 8, '0')) AS bank_txn_id", "'m' AS merchant_id", "'r' AS payment_rail", "'INR' AS currency",
        f"{amounts} AS amount_c", "date'2024-03-01' AS value_date", "'x ORD1' AS narration")
    return legs, lines


@pytest.fixture
def rounds(monkeypatch):
    from ledgerloom.operators import greedy

    seen = []
    monkeypatch.setattr(greedy, "counted", lambda *a, plain=greedy.counted: seen.append(1) or plain(*a))
    return seen


def test_copies_take_few_rounds(spark, rounds):
    found = matching.exact_id_match(*_many(spark, 100_000, "10000 + 50 * (id % 20)"))
    assert found.count() >= 99_000 and found.select("settlement_id").distinct().count() == found.count()
    assert found.selectExpr("bank_ids[0]").distinct().count() == found.count()
    assert len(rounds) <= 10


def test_many_amounts_take_few_rounds(spark, rounds):
    found = matching.exact_id_match(*_many(spark, 2_000, "10000 + id"))
    assert found.count() >= 1_900 and len(rounds) <= 40


def test_blank_orders_are_no_lifecycle_group(spark):
    legs = [("S1", "", 50000, 2, "settlement"), ("S2", " ", 50000, 2, "settlement"), ("S3", "", -5000, 4, "settlement_adjustment")]
    assert not links(matching.lifecycle_match(*frames(spark, legs, [("B1", 45000, 2, "")])))


@pytest.mark.parametrize("order,narration,linked", [
    ("ORD-100", "NEFT/RAIL/ORD-100/SETL", True), ("ORD-100", "NEFT ORD-1001", False), ("ORD-100", "NEFT ORD 100", False),
    ("ord.7/A", "pay ORD.7/a now", True), ("A\\E+1", "x A\\E+1", True), ("a.c", "abc", False), ("--", "--", False), ("#5", "inv #5.", True),
    ("X-1", "X-1-2", True), ("B2", "AB2", False)])
def test_orders_with_punctuation(spark, order, narration, linked):
    pair = frames(spark, [("S", order, 100, 0, "settlement")], [("B", 100, 0, narration)])
    assert bool(links(matching.exact_id_match(*pair))) is linked
    assert evidence.evidence_edges(*pair).first()["has_id"] is linked


def test_a_line_delivered_twice_is_consumed_once(spark):
    from ledgerloom.plans.cascade import reconcile

    legs, lines = frames(spark, [("S1", "ORD1", 100, 0, "settlement"), ("S2", "ORD1", 100, 0, "settlement")], [("B1", 100, 0, "ORD1")] * 2)
    assert reconcile(legs, lines).decisions.count() == 1
    legs, lines = frames(spark, [("S1", "ORD1", 100, 0, "settlement")] * 2, [("B1", 100, 0, "ORD1"), ("B2", 100, 0, "ORD1")])
    assert reconcile(legs, lines).decisions.count() == 1


def test_malformed_amounts_are_rejected(spark):
    from ledgerloom.sources import readers

    raw = spark.createDataFrame(
        [("S1", "1,234.50", "", "2024-03-01"), ("S2", "₹900.00", "x", "01/03/2024"), ("S3", "5.00", " ", "2024-03-01")],
        "settlement_id string, net_amount string, fee string, settlement_date string")
    legs = {r["settlement_id"]: r for r in readers.conform_settlements(raw).collect()}
    assert (legs["S1"]["net_c"], legs["S1"]["recon_c"], legs["S1"]["fee_c"]) == (None, None, 0)
    assert (legs["S2"]["fee_c"], legs["S2"]["settlement_date"]) == (None, None) and legs["S3"]["recon_c"] == 500
    found = readers.rejected_rows(raw, "legs", "settlement_id", ["net_amount", "fee"], ["settlement_date"]).collect()
    assert {(r["row_id"], r["column"]) for r in found} == {
        ("S1", "net_amount"), ("S2", "net_amount"), ("S2", "fee"), ("S2", "settlement_date")}
