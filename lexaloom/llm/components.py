"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: At most so many nodes count as hubs (16 bytes each); a hub has over LEAST edges and over a HUBS-th of all edge ends.
HUBS, LEAST = 100_000, 1_000
FILE_ROWS = 250_000


def least_neighbours(both: DataFrame, u: str, v: str, ends: int) -> DataFrame:
    """both(u, v) with m, the least v of each u. The rows of hubs meet m by a broadcast of at most HUBS rows, so no task gets a hub's rows."""
    least = both.groupBy(u).agg(F.min(v).alias("m"), F.count(F.lit(1)).alias("_k"))
    most = max(LEAST, ends // HUBS)
    hubs = least.where(F.col("_k") > most).select(u, F.col("m").alias("_m"))
    marked = both.join(F.broadcast(hubs), u, "left")
    rest = marked.where("_m IS NULL").select(u, v).join(least.where(F.col("_k") <= most).select(u, "m"), u)
    return marked.where("_m IS NOT NULL").select(u, v, F.col("_m").alias("m")).union(rest.select(u, v, "m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """node, root (the smallest node of its component) for each node that has an edge to another.

    Every step is an aggregate and equi-joins over edges; nothing of a component is gathered, and hubs are
    split (least_neighbours). Null ends and loops are ignored. Each round is stored in the shared folder,
    the first in at most `files` files.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") > F.col("lo"))).distinct()
    e, before = stored(e, "edges", files=files), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        before, files = now, -(-now[0] // FILE_ROWS)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        met = least_neighbours(both, "u", "v", 2 * now[0])
        m = F.least("u", "m")
        large = stored(met.where((F.col("v") > F.col("u")) & (F.col("v") > m)).select(F.col("v").alias("hi"), m.alias("lo")).distinct(), "large", files=files)
        met = least_neighbours(large, "hi", "lo", 2 * now[0])
        e = stored(met.select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi > lo").distinct(), "edges", files=files)
