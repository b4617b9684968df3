"""Maximum matching of two sides with multiplicities, as rounds of joins.

Nothing is gathered: a component of any size is spread over all tasks in every round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.session import written


def _greedy(edges: DataFrame, wanted: DataFrame, offered: DataFrame) -> list[DataFrame]:
    """Flows of a matching that no edge could be added to.

    In each round every row takes its best partner that still has room, and the edges that are best for
    both sides are used up. The first round goes by distance, the later ones by a hash that is new each
    time, so that rounds grow with the logarithm of the rows.
    """
    live = written(
        edges.join(wanted.select("e_id", F.col("n").alias("_e")), "e_id").join(offered.select("a_id", F.col("n").alias("_a")), "a_id")
    )
    flows: list[DataFrame] = []
    while True:
        rank = F.col("distance") if not flows else F.xxhash64("e_id", "a_id", F.lit(len(flows)))
        ranked = live.select("e_id", "a_id", F.struct(rank.alias("rank"), "e_id", "a_id", F.least("_e", "_a").alias("flow")).alias("edge"))
        of_e, of_a = (ranked.groupBy(side).agg(F.min("edge").alias("edge")).select("edge.e_id", "edge.a_id", "edge.flow") for side in ("e_id", "a_id"))
        used = written(of_e.join(of_a.select("e_id", "a_id"), ["e_id", "a_id"]))
        if used.isEmpty():
            return flows
        flows.append(used)
        taken = [used.select(side, F.col("flow").alias(f"_t{side}")) for side in ("e_id", "a_id")]
        left = live.join(taken[0], "e_id", "left").join(taken[1], "a_id", "left")
        rest = {f"_{s}": F.col(f"_{s}") - F.coalesce(f"_t{s}_id", F.lit(0)) for s in ("e", "a")}
        live = written(left.withColumns(rest).filter("_e > 0 AND _a > 0").select("e_id", "a_id", "distance", "_e", "_a"))


def _left(side: DataFrame, name: str, flow: DataFrame) -> DataFrame:
    used = flow.groupBy(name).agg(F.sum("flow").alias("_used"))
    return written(side.join(used, name, "left").select(name, (F.col("n") - F.coalesce("_used", F.lit(0))).alias("room")).filter("room > 0"))


def _augmented(edges: DataFrame, flow: DataFrame, free_e: DataFrame, free_a: DataFrame) -> DataFrame | None:
    """``flow`` after one shortest augmenting path from each row that still wants partners and reaches one.

    A search goes out from all those rows at once, layer by layer; every row it meets belongs to one of
    them, so the paths of different starts share nothing. None if no path is left.
    """
    front = free_e.select("e_id", F.col("e_id").alias("root"))
    seen_e, seen_a, layers = free_e.select("e_id"), None, []
    while True:
        met = front.join(edges.select("e_id", "a_id"), "e_id")
        if seen_a is not None:
            met = met.join(seen_a, "a_id", "left_anti")
        # ``e_id`` is where an offered row was reached from, ``back`` the flow by which the next wanted row is.
        reached = written(met.groupBy("a_id").agg(F.min(F.struct("e_id", "root")).alias("_m")).select("a_id", "_m.e_id", "_m.root"))
        layers.append(reached)
        ends = written(reached.join(free_a, "a_id").groupBy("root").agg(F.min(F.struct("a_id", "room")).alias("_m")).select("root", "_m.a_id", "_m.room"))
        if not ends.isEmpty():
            break
        seen_a = reached.select("a_id") if seen_a is None else seen_a.unionByName(reached.select("a_id"))
        nexts = reached.select("a_id", "root").join(flow, "a_id").join(seen_e, "e_id", "left_anti")
        front = written(nexts.groupBy("e_id").agg(F.min(F.struct("a_id", "root", "flow")).alias("_m")).select("e_id", "_m.root", F.col("_m.a_id").alias("from_a"), F.col("_m.flow").alias("back")))
        if front.isEmpty():
            return None
        layers.append(front)
        seen_e = seen_e.unionByName(front.select("e_id"))
    # Back along the layers: each path is one row, with its edges and what all of them allow.
    paths = ends.join(free_e.select(F.col("e_id").alias("root"), F.col("room").alias("_want")), "root").select(
        "root", "a_id", F.least("room", "_want").alias("flow"), F.array().cast("array<struct<e_id:bigint,a_id:bigint,sign:int>>").alias("steps")
    )
    while layers:
        reached = layers.pop().select("a_id", "e_id")
        step = F.array(F.struct(F.col("e_id").cast("bigint").alias("e_id"), F.col("a_id").cast("bigint").alias("a_id"), F.lit(1).alias("sign")))
        paths = paths.join(reached, "a_id").select("root", "e_id", "flow", F.concat("steps", step).alias("steps"))
        if layers:
            came = layers.pop().select("e_id", "from_a", "back")
            step = F.array(F.struct(F.col("e_id").cast("bigint").alias("e_id"), F.col("from_a").cast("bigint").alias("a_id"), F.lit(-1).alias("sign")))
            paths = written(paths.join(came, "e_id").select("root", F.col("from_a").alias("a_id"), F.least("flow", "back").alias("flow"), F.concat("steps", step).alias("steps")))
    changes = paths.select(F.explode("steps").alias("s"), "flow").select("s.e_id", "s.a_id", (F.col("s.sign") * F.col("flow")).alias("flow"))
    return written(flow.unionByName(changes).groupBy("e_id", "a_id").agg(F.sum("flow").alias("flow")).filter("flow > 0"))


def maximum_matching(edges: DataFrame, wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """How many of each wanted row stay without a partner in a maximum matching: (e_id, room), room > 0.

    ``edges`` (e_id, a_id, distance) are the pairs that may be matched, ``wanted`` (e_id, n) and
    ``offered`` (a_id, n) the copies of each row; ids are whole numbers. Greedy rounds come first;
    then shortest augmenting paths, found from all open rows at once, until there are none.
    """
    edges = written(edges.select("e_id", "a_id", "distance"))
    greedy = _greedy(edges, wanted, offered)
    if not greedy:
        return wanted.select("e_id", F.col("n").alias("room")).filter("room > 0")
    flow = written(reduce(lambda a, b: a.unionByName(b), greedy).groupBy("e_id", "a_id").agg(F.sum("flow").alias("flow")))
    while True:
        open_e = _left(wanted, "e_id", flow)
        # A row without any edge cannot start a path.
        starts = open_e.join(edges, "e_id", "left_semi")
        open_a = _left(offered, "a_id", flow)
        if starts.isEmpty() or open_a.isEmpty():
            return open_e
        better = _augmented(edges, flow, written(starts), open_a)
        if better is None:
            return open_e
        flow = better
