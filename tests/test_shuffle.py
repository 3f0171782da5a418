"""What is shuffled: identifiers instead of rows, members only of cells in use."""

from pyspark.sql import functions as F

from ledgerloom.operators import cells as cell_rows, greedy
from ledgerloom.operators.pools import one_per_id


def test_one_per_id_equals_grouping_whole_rows(spark):
    rows = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, None), ("b", 5, None), ("c", 7, "q"), (None, 1, "n"), (None, 1, "n")]
    frame = spark.createDataFrame(rows, "id string, v int, t string")
    got = one_per_id(frame, "id").select("id", "v", "t").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [("a", 1, "y"), ("b", None, None), ("c", 7, "q"), (None, 1, "n"), (None, 1, "n")], key=repr)
    whole = frame.withColumn("v", F.raise_error(F.lit("grouped")).cast("int")).filter("id = 'c'")
    plan = one_per_id(whole, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def _cells(spark, sizes):
    rows = [(f"{k}{i:03d}", k) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, k string")


def test_members_are_looked_up_only_behind_the_first_row(spark, monkeypatch):
    legs, lines = _cells(spark, {"a": 3, "b": 1}), _cells(spark, {"p": 1, "q": 1})
    pairs = spark.createDataFrame([(0, "a000", 3, "p000", 1, "i"), (0, "b000", 1, "q000", 1, "i")],
                                  "cost bigint, left string, left_n bigint, right string, right_n bigint, info string")
    sides = [(rows, ["k"], "id", name, f"{name}_n") for rows, name in ((legs, "left"), (lines, "right"))]

    def never(*args, **kwargs):
        raise AssertionError("members were looked up")

    monkeypatch.setattr(greedy, "members", never)
    got = sorted((r.left_id, r.right_id) for r in greedy.assign(pairs, *sides).collect())
    assert got == [("a000", "p000"), ("b000", "q000")]


def test_members_of_cells_in_use(spark):
    rows = _cells(spark, {"a": 3, "b": 2, "c": 1}).unionByName(spark.createDataFrame([("n1", None), ("n2", None)], "id string, k string"))
    used = spark.createDataFrame([("a000",), ("c000",), ("n1",)], "cell string")
    got = sorted(map(tuple, cell_rows.members(rows, ["k"], "id", "left", "left_n", used).collect()))
    assert got == [("a000", "a000", 1), ("a000", "a001", 2), ("a000", "a002", 3)]


def test_rounds_with_hot_and_unnamed_ends(spark):
    """One line is first choice of all legs; ends and costs may be null."""
    edges = [(None if i == 3 else 5, None if i == 4 else f"l{i}", 1, "r0" if i % 2 else f"r{i}", 2, "i") for i in range(9)]
    links = greedy.links_of_cells(spark.createDataFrame(edges, "cost bigint, left string, left_n bigint, right string, right_n bigint, info string"))
    got = {(r.left, r.right): r.links for r in links.collect()}
    assert sum(n for (_, right), n in got.items() if right == "r0") == 2
    assert all(got[(None if i == 4 else f"l{i}", f"r{i}")] == 1 for i in (0, 2, 4, 6, 8) if i)
