"""Drainage networks with one way down from each cell (src flows to dst): all rounds double the way that is known.

A pointer of round k leads 2^k cells down.  So the number of rounds grows with the
logarithm of the longest way, and each round, written out, is an aggregate by
target and a join with the target's own pointer.  Cells that many others point to
are joined by broadcast.  On a cycle pointers never end: ValueError, as for cells
with more than one way down.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiq.sources.scratch import dropped, saved

from .relational import looked_up


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def _checked(edges: DataFrame) -> DataFrame:
    if not edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a cell has more than one way down")
    return edges


def _rounds(nodes: int) -> range:
    """Doublings of the longest path that a network without cycles can have."""
    return range(nodes.bit_length() + 1)


def flow_accumulation(cells: DataFrame, edges: DataFrame, node: str = "id", mass: Column | None = None) -> DataFrame:
    """node, accumulation: the cells that drain through each cell, itself included, or the sum of their ``mass`` (whole numbers).

    After round k a cell holds the sum over all that reach it within fewer than 2^k
    steps: what those hold that are just 2^k steps away is added.
    """
    own = cells.select(F.col(node).alias("id"), (F.lit(1) if mass is None else mass).cast("long").alias("m"))
    ends = _nodes(edges).withColumn("m", F.lit(0).cast("long"))
    own = own.unionByName(ends).groupBy("id").agg(F.sum("m").alias("m"))
    state = saved(own.join(_checked(edges).select(F.col("src").alias("id"), F.col("dst").alias("to")), "id", "left"), "flow")
    for _ in _rounds(state.count()):
        active = state.filter("to is not null")
        if active.isEmpty():
            return state.select(F.col("id").alias(node), F.col("m").alias("accumulation"))
        more = active.groupBy(F.col("to").alias("id")).agg(F.sum("m").alias("_more"))
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        jump = looked_up(active.select("id", "to"), "to", ahead).select("id", "_next")
        after = saved(state.join(more, "id", "left").join(jump, "id", "left").select("id", F.col("_next").alias("to"), (F.col("m") + F.coalesce("_more", F.lit(0))).alias("m")), "flow")
        dropped(state)
        state = after
    raise ValueError("the network has a cycle")


def distance_downstream(edges: DataFrame, stops: DataFrame, length: Column | None = None, node: str = "id") -> DataFrame:
    """node, distance, stop: the length of the way (edges, or the sum of their ``length``) from each cell down to the first stop on it.

    Cells whose way ends without a stop are left out.
    """
    way = _checked(edges).select(F.col("src").alias("id"), F.col("dst").alias("to"), (F.lit(1.0) if length is None else length).cast("double").alias("d"))
    at = stops.select(F.col(node).alias("id"), F.lit(True).alias("_stop")).distinct()
    rows = _nodes(edges).unionByName(at.select("id")).distinct().join(way, "id", "left").join(at, "id", "left")
    here = F.col("_stop").isNotNull()
    state = saved(rows.select("id", F.when(~here, F.col("to")).alias("to"), F.when(here, 0.0).otherwise(F.coalesce("d", F.lit(0.0))).alias("d"), F.when(here, F.col("id")).alias("stop")), "ways")
    for _ in _rounds(state.count()):
        active = state.filter("to is not null")
        if active.isEmpty():
            return state.filter("stop is not null").select(F.col("id").alias(node), F.col("d").alias("distance"), "stop")
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("_next"), F.col("d").alias("_d"), F.col("stop").alias("_stop"))
        jumped = looked_up(active.drop("stop"), "to", ahead).select("id", F.col("_next").alias("to"), (F.col("d") + F.col("_d")).alias("d"), F.col("_stop").alias("stop"))
        after = saved(state.filter("to is null").unionByName(jumped), "ways")
        dropped(state)
        state = after
    raise ValueError("the network has a cycle")


def outlets(edges: DataFrame) -> DataFrame:
    """id: cells with a way to them and none from them."""
    return edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def basins(edges: DataFrame, node: str = "id") -> DataFrame:
    """node, basin: the outlet that it drains to."""
    ends = outlets(edges).withColumnRenamed("id", node)
    return distance_downstream(edges, ends, node=node).select(node, F.col("stop").alias("basin"))


def steps_downstream(edges: DataFrame, stops: DataFrame, node: str = "id") -> DataFrame:
    """Number of edges from each cell down to the first stop on its way."""
    return distance_downstream(edges, stops, node=node).select(node, F.col("distance").cast("int").alias("steps"))


def channels(edges: DataFrame, accumulation: DataFrame, least: int) -> DataFrame:
    """The edges that leave cells through which at least ``least`` cells drain.  ``accumulation``: id, accumulation."""
    return edges.join(accumulation.filter(F.col("accumulation") >= least).select(F.col("id").alias("src")), "src", "left_semi")


def grid_length(width: int, size: float) -> Column:
    """Length of an edge between neighbouring cells that are numbered row * width + col."""
    across = F.pmod(F.col("src"), F.lit(width)) != F.pmod(F.col("dst"), F.lit(width))
    along = F.floor(F.col("src") / width) != F.floor(F.col("dst") / width)
    return F.when(across & along, size * 2**0.5).otherwise(size)


def overland_distance(edges: DataFrame, accumulation: DataFrame, least: int, width: int, size: float) -> DataFrame:
    """id, distance: metres along the flow to the first channel cell, one through which at least ``least`` cells drain; channel cells have 0."""
    stops = accumulation.filter(F.col("accumulation") >= least).select("id")
    return distance_downstream(edges, stops, grid_length(width, size)).select("id", "distance")


def strahler(edges: DataFrame) -> DataFrame:
    """id, strahler: a source is 1; the highest inflow, plus 1 if two share it.

    In each round, written out, a cell whose inflows are all known becomes known.
    A cell that waits for one inflow alone depends on that one's order x as lo
    (x < t), hi (t <= x < hi) or x; such rules are chained, doubling the way that
    each covers.  So rounds grow with the logarithm of the cells, whatever the
    network's shape, and hold the cells that are not known yet.
    """
    way = _checked(edges).select(F.col("src").alias("id"), F.col("dst").alias("to"))
    sources = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("v", F.lit(1))
    kind = dict(edges.dtypes)["src"]
    none = lambda *names: {n: F.lit(None).cast("int") for n in names}
    state = _nodes(edges).join(way, "id", "left").join(sources, "id", "left")
    state = saved(state.withColumns({"m": F.lit(0), "dup": F.lit(False), "from": F.lit(None).cast(kind), **none("lo", "t", "hi")}), "orders")
    known = []
    while True:
        done, rest = state.filter("v is not null").select("id", "to", "v"), state.filter("v is null").drop("v")
        found, every = state.agg(F.count("v"), F.count(F.lit(1))).first()
        known.append(done.select("id", F.col("v").alias("strahler")))
        if found == every:
            return reduce(DataFrame.unionByName, known)
        if not found:
            raise ValueError("the network has a cycle")
        told = done.filter("to is not null").groupBy("to", "v").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("to").alias("id")).agg(F.max(F.struct("v", "n")).alias("_told"))
        waits = rest.filter("to is not null").groupBy(F.col("to").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_one"))
        near = rest.join(told, "id", "left").join(waits, "id", "left")
        top = F.col("_told.v")
        near = near.withColumn("dup", F.when(top > F.col("m"), F.col("_told.n") > 1).otherwise(F.col("dup") | F.coalesce(top == F.col("m"), F.lit(False)))).withColumn("m", F.greatest("m", top))
        fresh, up = F.col("from").isNull() & (F.col("_n") == 1), F.col("m") + F.col("dup").cast("int")
        rule = {"lo": up, "t": up, "hi": F.col("m") + 1}
        near = near.withColumn("v", F.when(F.col("_n").isNull(), up)).withColumns({"from": F.when(fresh, F.col("_one")).otherwise(F.col("from")), **{n: F.when(fresh, c).otherwise(F.col(n)) for n, c in rule.items()}})
        near = near.select("id", "to", "v", "m", "dup", "from", "lo", "t", "hi")
        waiting = F.col("v").isNull() & F.col("from").isNotNull()
        heard = done.select(F.col("id").alias("from"), F.col("v").alias("_v"))
        sure = near.filter(waiting).select("id", "from", "lo", "t", "hi")
        sure = looked_up(sure, "from", heard).select("id", _ruled(F.col("_v")).alias("_v"))
        near = saved(near.join(sure, "id", "left").withColumn("v", F.coalesce("v", "_v")).drop("_v"), "orders-near")
        ahead = near.select(F.col("id").alias("from"), F.col("v").alias("_v"), F.col("from").alias("_from"), *[F.col(n).alias(f"_{n}") for n in ("lo", "t", "hi")])
        jump = looked_up(near.filter(waiting), "from", ahead.filter("_v is not null or _from is not null"))
        # What this cell's rule makes of the results of the one that it waits for.
        low, over = _ruled(F.col("_lo")), F.col("hi") <= F.col("_hi")
        chained = {"lo": low, "t": F.when(F.col("_hi") < F.col("t"), F.col("t")).otherwise(F.col("_t")), "hi": F.when(over, F.col("_hi")).otherwise(F.col("hi"))}
        chained = [F.when(F.col("_v").isNull(), c).alias(f"_{n}") for n, c in chained.items()]
        jump = jump.select("id", _ruled(F.col("_v")).alias("_v"), F.when(F.col("_v").isNull(), F.col("_from")).alias("_from"), *chained)
        after = near.join(jump, "id", "left")
        after = saved(after.select("id", "to", F.coalesce("v", "_v").alias("v"), "m", "dup", *[F.coalesce(f"_{n}", n).alias(n) for n in ("from", "lo", "t", "hi")]), "orders")
        dropped(near)
        state = after


def _ruled(x: Column) -> Column:
    """A cell's order by its rule (lo, t, hi), if the inflow that it waits for has the order x; null for null."""
    return F.when(x < F.col("t"), F.col("lo")).when(x < F.col("hi"), F.col("hi")).when(x.isNotNull(), x)
