"""Array, map and packed-list functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

SLOT = "SUB"


def pack(items: Column) -> Column:
    """array<struct<key, value>> as `key,value key,value`."""
    return F.array_join(F.transform(items, lambda x: F.concat(x["key"], F.lit(","), x["value"].cast("string"))), " ")


def unpack(packed: Column) -> Column:
    """The reverse; items without a comma are dropped, the last comma counts, values stay strings."""
    items = F.filter(F.split(F.coalesce(packed, F.lit("")), r"\s+"), lambda x: F.contains(x, F.lit(",")))
    return F.transform(items, lambda x: F.struct(F.regexp_extract(x, r"^(.*),[^,]*$", 1).alias("key"), F.regexp_extract(x, r",([^,]*)$", 1).alias("value")))


def ngrams(tokens: Column, n: int) -> Column:
    """All windows of n tokens, joined by spaces."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def replaced_at(tokens: Column, place: Column, value: Column | str = SLOT) -> Column:
    """tokens with the one at a 0-based place replaced."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.transform(tokens, lambda t, i: F.when(i == place, value).otherwise(t))


def slot_of(tokens: Column, value: str = SLOT) -> Column:
    """0-based place of the slot; -1 where there is none."""
    return F.array_position(tokens, value).cast("int") - 1


def frame(left: Column, middle: Column, right: Column, size: int, fill: str = "") -> Column:
    """The last `size` tokens of left, middle, and the first of right, filled up."""
    pad = F.array_repeat(F.lit(fill), size)
    return F.concat(F.slice(F.concat(pad, left), -size, size), middle, F.slice(F.concat(right, pad), 1, size))


def get_or(m: Column, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def one_hot(values: list[str], value: Column) -> Column:
    return F.array(*[(value == v).cast("int") for v in values])


def pairs(items: Column) -> Column:
    """array<struct<a, b>> of each item with every later one, without a join; for short arrays."""
    return F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def joined_nouns(tagged: Column) -> Column:
    """array<struct<token, tag>> with runs of nouns merged to one item."""
    kind = "array<struct<token: string, tag: string>>"

    def step(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        both = F.coalesce(last["tag"].startswith("NN") & t["tag"].startswith("NN"), F.lit(False))
        merged = F.struct(F.concat_ws(" ", last["token"], t["token"]).alias("token"), F.concat_ws(" ", last["tag"], t["tag"]).alias("tag"))
        return F.when(both, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(F.struct(t["token"].alias("token"), t["tag"].alias("tag"))))).cast(kind)

    return F.aggregate(tagged, F.array().cast(kind), step)


def greedy_spans(spans: Column) -> Column:
    """The spans (start, stop, ...) that a scan from the left takes: each starts where the last has ended or later."""
    ordered = F.array_sort(spans)
    kept = F.aggregate(ordered, F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at")), lambda acc, s: F.when(s["start"] >= acc["end"], F.struct(s["stop"].cast("int").alias("end"), F.concat(acc["at"], F.array(s["start"].cast("int"))).alias("at"))).otherwise(acc))
    return let(kept, lambda k: F.filter(ordered, lambda s: F.array_contains(k["at"], s["start"].cast("int"))))
