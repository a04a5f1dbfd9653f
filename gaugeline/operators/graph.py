"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gaugeline.scratch import discard, materialise


#: A round's edges that go on in one task: so few that dealing them out would cost more than the work on them.
SMALL = 1 << 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node at the smallest of them (or itself)."""
    ways = lambda *pairs: F.explode(F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in pairs]))
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    rows = edges.select(ways((a, b), (b, a)) if large else ways((F.greatest("a", "b"), F.least("a", "b")))).select("col.*")
    least = rows.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = rows.join(least, "a")
    if large:
        return moved.where(b > a).select(b.alias("a"), m.alias("b")).where("a <> b")
    return moved.select(ways((b, m), (a, m))).select("col.*").where("a <> b").distinct()  # repeated edges are harmless to the next step


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(a, b) edges to (node, component): the component is its smallest node.

    Nodes without an edge do not appear. Loops and repeated edges are harmless;
    an edge with a null end is ignored; no edges give no rows. Each round is one
    job that writes to the shared folder and tells the driver two numbers on the way.
    Stars keep a hub's edges as rows, so no group is ever collected, and the join
    of a hub's edges is one that adaptive execution splits.
    """
    now = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    before, written = None, []
    for _ in range(max_rounds):
        seen = Observation()
        step = _star(_star(now, True), False)
        step = step.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
        now = materialise(step, "components")
        discard(*written)
        written = [now]
        print_of = (seen.get["n"], seen.get["s"])
        if before == print_of or not print_of[0]:
            break
        if print_of[0] <= SMALL:
            now = now.coalesce(1)
        before = print_of
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
