"""Mutual best from edges that are listed anyway, and on rows that share an identifier."""

import random

import pytest

from ledgerloom.operators import evidence
from tests.test_matching import data, frames


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [31, 32, 33])
def test_listed_edges_give_the_same_links(spark, seed):
    pair = frames(spark, *data(seed, 60, 60, [10000, 10200, 10500, 10600], 5, orders=20))
    want = rows(evidence.mutual_best(*pair))
    assert want and rows(evidence.mutual_best(*pair, edges=evidence.evidence_edges(*pair))) == want


def test_shared_and_missing_identifiers_do_not_use_listed_edges(spark):
    """An identifier on two different legs, a line without one: as without the edges."""
    draw = random.Random(5)
    legs, lines = data(34, 40, 40, [10000, 10200, 10500], 4, orders=12)
    legs = legs + [(legs[0][0], "ORD1", 10500, 2, "settlement"), (legs[1][0], draw.choice(legs)[1], 10200, 1, "settlement")]
    lines = lines + [(None, 10200, 1, "X/ORD1"), lines[3]]
    pair = frames(spark, legs, lines)
    assert evidence._repeats((pair[0], "settlement_id", "currency"), (pair[1], "bank_txn_id", "currency")) == [True, True]
    assert rows(evidence.mutual_best(*pair, edges=evidence.evidence_edges(*pair))) == rows(evidence.mutual_best(*pair))


def test_only_rows_of_mixed_cells_meet_by_words(spark, monkeypatch):
    """Pairs of cells with one order ID and one narration show their evidence without a search by word."""
    legs = [("S1", "ORD1", 10000, 0, "settlement"), ("S2", "ORD2", 50000, 0, "settlement"), ("S3", "ORD2", 50000, 0, "settlement"),
            ("S4", "ORD4", 90000, 0, "settlement"), ("S5", "ORD5", 90000, 0, "settlement"), ("S6", "", 30000, 0, "settlement")]
    lines = [("B1", 10000, 1, "X/ORD1"), ("B2", 50000, 1, "X/ORD2"), ("B3", 50000, 0, "misc"),
             ("B4", 90000, 0, "X/ORD5"), ("B5", 30000, 0, "ord")]
    searched, search = [], evidence.named_pairs

    def watched(left, right, *bounds):
        searched.append((sorted(r.left for r in left.collect()), sorted(r.right for r in right.collect())))
        return search(left, right, *bounds)

    monkeypatch.setattr(evidence, "named_pairs", watched)
    got = {(r.settlement_id, r.bank_txn_id, r.has_id) for r in evidence.mutual_best(*frames(spark, legs, lines)).collect()}
    assert got == {("S1", "B1", True), ("S2", "B2", True), ("S5", "B4", True), ("S6", "B5", False)}
    assert searched == [(["S4", "S5"], ["B4"])]
