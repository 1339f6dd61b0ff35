"""Mixing sources to target weights by a low-discrepancy schedule.

A source's texts, in hash order, form one run of words that is cut into equal blocks: as long as a slot
of the whole schedule, or shorter, so that a source of FINE words has FINE blocks at least. A source
weighs as many slots as its target holds blocks. The schedule's N points are those of the golden-ratio
lattice, point i at i * m modulo N for the m next to N / phi that shares no factor with N: each source has
a span of the cumulative weights, and the points in it are its slots, so it has exactly its weight, and in
any part of the schedule about its share. Its slots are ranked; slot r takes its block r modulo the number
of its blocks, so that a source larger than its target is sampled and a smaller one repeats. What a
document gives is its overlap with the blocks taken. Each source comes within half a block of its target,
whatever the total and the number of sources.

A source of any size is laid out in parallel: buckets of a hash are summed first, and each bucket
starts where those before it end.

Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a target stops at
LIMIT times its source's size, and the excess goes to the others by weight.

Defined results: null or wordless texts have size 0 and give nothing; rows that repeat are separate
texts; null ids are kept; with no words at all every target is 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from math import gcd, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

SLOTS = 1 << 17
FINE = 256
LIMIT = 3
BUCKET_ROWS = 500


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_table(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target, total of each source, in one task: a row a source.

    Sources in order of the factor at which they reach their limit: those below the common factor stay at
    the limit, the rest share what is left by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = Window.orderBy(F.col("source").asc_nulls_last())
    s = by_source.withColumn("weight", (F.row_number().over(w) - 1) % 3 + 1).withColumn("_cap", F.col("source_size") * LIMIT)
    ratio = F.col("_cap") / F.col("weight")
    w = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("_ratio", ratio).withColumn("total", total).withColumn("_factor", (F.col("total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    below = F.col("_ratio") <= F.col("_factor")  # true for the first sources, then false; the factor falls from there on
    level = F.max(F.when(~below, F.col("_factor"))).over(Window.partitionBy())
    target = F.when(below, F.col("_cap").cast("double")).otherwise(level * F.col("weight"))
    return s.withColumn("target", target).select("source", "source_size", "weight", "target", "total")


def slot_table(targets: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """targets with sid, n_blocks (equal blocks of a source), takes (its slots: blocks that come within half a block of its target) and first (the start of its span)."""
    block = F.greatest(F.lit(1), F.ceil(F.col("total") / n_slots))
    n = F.greatest(F.lit(1), F.least("source_size", F.greatest(F.ceil(F.col("source_size") / block), F.lit(FINE)))).cast("long")
    takes = F.when(F.col("source_size") > 0, F.least(LIMIT * n, F.floor(F.col("target") * n / F.col("source_size") + 0.5))).otherwise(0).cast("long")
    w = Window.orderBy(F.col("source").asc_nulls_last())
    s = targets.withColumn("sid", F.row_number().over(w)).withColumn("n_blocks", n).withColumn("takes", takes)
    return s.withColumn("first", F.sum("takes").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("takes"))


def lattice(n: int) -> tuple[int, int]:
    """m next to n / phi that shares no factor with n, and its inverse modulo n."""
    if n < 3:
        return 1, 1
    m = (isqrt(5 * n * n) - n) // 2
    while gcd(m, n) != 1:
        m += 1
    return m % n, pow(m, -1, n)


def schedule(slots: DataFrame, n: int) -> DataFrame:
    """slot, sid, rank for slots(sid, first, takes) of n points in all: the points of a source's span, in the order of the schedule."""
    _, back = lattice(n)
    points = slots.where("takes > 0").select("sid", F.explode(F.sequence("first", F.col("first") + F.col("takes") - 1)).alias("x"))
    at = points.select("sid", (F.col("x").cast("decimal(20,0)") * back % n).cast("long").alias("slot"))
    return at.withColumn("rank", (F.row_number().over(Window.partitionBy("sid").orderBy("slot")) - 1).cast("long"))


def mix(docs: DataFrame, *, n_slots: int = SLOTS, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs(doc_id, text, source)."""
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("doc_id").cast("string")))
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("_h")), "sizes")
    slots = stored(slot_table(target_table(sized), n_slots), "slots")  # a row a source
    n, rows = slots.agg(F.sum("takes")).first()[0] or 0, sized.count()
    digits = max(1, min(12, len(f"{rows // BUCKET_ROWS:x}")))
    bucket = F.conv(F.substring("_h", 1, digits), 16, 10).cast("long")
    placed = sized.join(slots.select(F.col("source").alias("_s"), "sid", "source_size", "target", "n_blocks"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source").withColumn("bucket", bucket)
    per = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("_n"))
    starts = per.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy("sid", "bucket").orderBy("_h", "doc_id", "size")
    run = placed.withColumn("rn", F.row_number().over(w)).withColumn("_before", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = run.join(starts, ["sid", "bucket"]).withColumn("start", F.col("_base") + F.col("_before"))

    first, last = F.expr("((start + 1) * n_blocks - 1) div source_size"), F.expr("((start + size) * n_blocks - 1) div source_size")
    pieces = run.select("sid", "bucket", "rn", "doc_id", "size", "source_size", "target", "n_blocks", "start", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))).alias("block"))
    times = schedule(slots, n).join(slots.select("sid", "n_blocks"), "sid").groupBy("sid", (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))
    overlap = F.least(F.col("start") + F.col("size"), F.expr("(block + 1) * source_size div n_blocks")) - F.greatest(F.col("start"), F.expr("block * source_size div n_blocks"))
    taken = F.coalesce(F.sum(overlap * F.col("times")), F.lit(0)).cast("long")
    return pieces.join(times, ["sid", "block"], "left").groupBy("sid", "bucket", "rn", "doc_id", "size", "source_size", "target").agg(taken.alias("taken")).select("doc_id", "size", "source_size", "target", "taken")
