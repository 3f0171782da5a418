"""Greedy assignment in rounds.

Candidates join cells (see ``cells``) and are walked by cost; candidates of
one cost stand in the order of a hash of their cells. A candidate whose turn
comes hands over as many rows as both cells have left. The same links come
from repeatedly taking every candidate that is first at all of its ends
(locally dominant edges: Preis 1999, Hoepman 2004). Each candidate taken uses
up one of its cells, and because ties stand in a random order their chains are
short: the rounds grow with the logarithm of the candidates (Blelloch, Fineman
and Shun 2012), not with the rows of the cells. A round is one map-side
combined minimum per end and one write; no candidate group is ever sorted or
gathered in one task. Rounds go on until no candidate is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.cells import members
from ledgerloom.runtime import counted, durable

_CHUNK = 4096


def assign(candidates: DataFrame, left_rows, right_rows, pairs: bool = False) -> DataFrame:
    """Links chosen from ``candidates``: (left_id, right_id, right_id2, cost, info).

    ``candidates`` has cost, left, left_n, right, right_n, info and, with
    ``pairs``, right2, right2_n (right2 may equal right: two rows of one
    cell). ``left_rows`` and ``right_rows`` are the arguments of
    ``cells.members`` for their side, or None where every cell is one row.
    """
    return expand(links_of_cells(candidates, pairs), left_rows, right_rows, pairs)


def links_of_cells(candidates: DataFrame, pairs: bool = False) -> DataFrame:
    """Chosen cell candidates with the number of ``links`` and the rows used before them.

    Where ``candidates`` has left_used, right_used (right2_used), so many rows of
    the cell are taken already; each candidate must have rows left at its ends.
    """
    if not pairs:
        candidates = candidates.withColumns({
            "right2": F.lit(None).cast("string"), "right2_n": F.lit(None).cast("bigint")})
    def used(name):
        return (F.col(name) if name in candidates.columns else F.lit(0)).cast("bigint").alias(name)

    state, left_open = counted(candidates.select(
        "cost", turn("left", "right", "right2").alias("turn"),
        "left", "left_n", used("left_used"), "right", "right_n", used("right_used"),
        "right2", "right2_n", used("right2_used"), "info", F.lit(None).cast("bigint").alias("links")))
    taken = state.filter("links IS NOT NULL")
    while left_open:
        spark = state.sparkSession
        won = durable(spark.sql(_WON.format(won=_WON_TRIPLES if pairs else _WON_PAIRS, edges="{edges}"), edges=state))
        taken = taken.unionByName(won)
        text = _MOVED.format(
            used2="coalesce(c.n, 0)" if pairs else "0", join2=_SECOND_END if pairs else "", edges="{edges}", won="{won}")
        state, left_open = counted(spark.sql(text, edges=state, won=won))
    return taken


def turn(left: str, right: str, right2: str):
    """The place of a candidate among those of its cost: 16 bytes, in the order of their hexadecimal digits."""
    return F.unhex(F.md5(tie_key(left, right, right2).cast("binary")))


def tie_key(left: str, right: str, right2: str):
    """Text whose hash orders the candidates of one cost."""
    return F.concat_ws("|", left, F.least(right, right2), F.when(F.col(right2).isNotNull(), F.greatest(right, right2)))


# Open candidates -> first candidate of each end -> candidates that are first at
# all their ends, with their links.
_WON_TRIPLES = """ends AS (
  SELECT struct(cost, turn, `left`, `right`, right2, left_n, left_used, right_n, right_used, right2_n, right2_used, info) AS key,
         explode(array_distinct(array(concat('L', `left`), concat('R', `right`), concat('R', coalesce(right2, `right`))))) AS node
  FROM {edges}),
won AS (
  SELECT key.*, least(key.left_n - key.left_used,
    CASE WHEN key.`right` = key.right2 THEN (key.right_n - key.right_used) div 2
         ELSE least(key.right_n - key.right_used, key.right2_n - key.right2_used) END) AS links
  FROM (SELECT node, min(key) AS key FROM ends GROUP BY node)
  GROUP BY key
  HAVING count(*) = CASE WHEN key.right2 IS NULL OR key.`right` = key.right2 THEN 2 ELSE 3 END)"""

# Without second lines a candidate travels whole to one end; the other end
# answers with the name of its first. The join is by the whole name, so that an
# end that is first choice of very many does not gather them in one task.
_WON_PAIRS = """mine AS (
  SELECT min(struct(cost, turn, `right`, left_n, left_used, right_n, right_used, info)) AS key, `left` FROM {edges} GROUP BY `left`),
theirs AS (
  SELECT min(struct(cost, turn, `left`)) AS key, `right` FROM {edges} GROUP BY `right`),
won AS (
  SELECT m.key.cost, m.key.turn, m.`left`, m.key.`right`, CAST(NULL AS STRING) AS right2, m.key.left_n, m.key.left_used,
         m.key.right_n, m.key.right_used, CAST(NULL AS BIGINT) AS right2_n, CAST(0 AS BIGINT) AS right2_used, m.key.info,
         least(m.key.left_n - m.key.left_used, m.key.right_n - m.key.right_used) AS links
  FROM mine m JOIN theirs t
    ON t.`right` <=> m.key.`right` AND t.key.`left` <=> m.`left` AND t.key.turn = m.key.turn AND t.key.cost <=> m.key.cost)"""

_WON = """
WITH {won}
SELECT cost, turn, `left`, left_n, left_used, `right`, right_n, right_used, right2, right2_n, right2_used, info, links FROM won"""

# Rows used by the candidates taken, by end -> candidates still open.
_MOVED = """
WITH used AS (
  SELECT u.node, u.n FROM {won} LATERAL VIEW inline(array(
    struct(concat('L', `left`) AS node, links AS n),
    struct(concat('R', `right`) AS node, CASE WHEN `right` = right2 THEN links * 2 ELSE links END AS n),
    struct(CASE WHEN `right` <> right2 THEN concat('R', right2) END AS node, links AS n))) u
  WHERE u.node IS NOT NULL),
moved AS (
  SELECT cost, turn, `left`, left_n, left_used + coalesce(a.n, 0) AS left_used,
         `right`, right_n, right_used + coalesce(b.n, 0) AS right_used,
         right2, right2_n, right2_used + {used2} AS right2_used, info
  FROM {edges}
  LEFT JOIN used a ON a.node = concat('L', `left`)
  LEFT JOIN used b ON b.node = concat('R', `right`)
  {join2})
SELECT *, CAST(NULL AS BIGINT) AS links FROM moved
WHERE left_n > left_used AND right_n - right_used >= CASE WHEN `right` = right2 THEN 2 ELSE 1 END
  AND (right2 IS NULL OR right2_n > right2_used)"""

_SECOND_END = "LEFT JOIN used c ON c.node = concat('R', right2)"


def expand(segments: DataFrame, left_rows, right_rows, pairs: bool) -> DataFrame:
    """From cell links back to identifiers, by rank."""
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("links") - 1) / _CHUNK).cast("bigint")))
    step = F.explode(F.sequence(
        F.col("_chunk") * _CHUNK, F.least(F.col("links"), (F.col("_chunk") + 1) * _CHUNK) - 1))
    twin = F.col("right") == F.col("right2")
    stride = F.when(twin, 2).otherwise(F.lit(1))
    out = (
        segments.withColumn("_chunk", chunk).withColumn("_step", step)
        .withColumns({
            "_l": F.col("left_used") + F.col("_step") + 1,
            "_r": F.col("right_used") + F.col("_step") * stride + 1,
            "_r2": F.when(twin, F.col("right_used") + F.col("_step") * 2 + 2).otherwise(
                F.col("right2_used") + F.col("_step") + 1),
        })
    )

    def named(*nodes):
        # the first row of a cell is the one it is named after; only later ones are looked up
        parts = [segments.filter((F.col(f"{n}_n") > 1) & (F.col(f"{n}_used") + F.col("links") * (stride if n == "right" else 1) > 1))
                 .select(F.col(n).alias("cell")) for n in nodes]
        return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).distinct()

    def looked_up(side_rows, *nodes):
        if side_rows is None:
            return None
        used, some = counted(named(*nodes))
        return durable(members(*side_rows, used=used)) if some else None

    def resolve(frame, member_rows, node, rank, name):
        if member_rows is None:
            return frame.withColumn(name, F.col(node))
        picked = member_rows.select(F.col("cell").alias(node), F.col("rank").alias(rank), F.col("id").alias("_id"))
        return (frame.join(picked, [node, rank], "left")
                .withColumn(name, F.coalesce("_id", node)).drop("_id"))

    left = looked_up(left_rows, "left")
    right = looked_up(right_rows, *(("right", "right2") if pairs else ("right",)))
    out = resolve(out, left, "left", "_l", "left_id")
    out = resolve(out, right, "right", "_r", "right_id")
    if pairs:
        out = resolve(out, right, "right2", "_r2", "right_id2")
    else:
        out = out.withColumn("right_id2", F.lit(None).cast("string"))
    return out.select("left_id", "right_id", "right_id2", "cost", "info")


def unit_candidates(edges: DataFrame, left: str, right: str, cost: str) -> DataFrame:
    """An explicit candidate list as candidates between cells of one row."""
    unit = F.lit(1).cast("bigint")
    return edges.select(
        F.col(cost).cast("bigint").alias("cost"), F.col(left).alias("left"), unit.alias("left_n"),
        F.col(right).alias("right"), unit.alias("right_n"), F.struct(F.lit(0).alias("none")).alias("info"))


def greedy_match(edges: DataFrame, left: str, right: str, cost: str) -> DataFrame:
    """Greedy assignment over an explicit candidate list, each end used once."""
    return assign(unit_candidates(edges, left, right, cost), None, None).select(
        F.col("left_id").alias(left), F.col("right_id").alias(right), F.col("cost").alias(cost))
