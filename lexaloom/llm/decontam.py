"""Benchmark decontamination by spaced-seed hashing.

Fixed masks ignore some token positions, so that a substituted word spoils few seeds. Hashes of the
benchmark's masked windows are joined with those of the documents; around each hit the item is laid
on the document along the hit's diagonal, and a stretch of WINDOW words with at least MATCHES equal
ones confirms the overlap.

Words are runs of letters and digits, lower-cased. A bit table of the benchmark's hashes, sized by their
number up to 48 MB, thins the documents' windows before the shuffle; beyond that it only passes more.

Defined results: null, empty and short texts (below the shortest mask) overlap with nothing; rows
that repeat are judged each and reported once; null ids are reported as null; an item that is shorter
than WINDOW must match in the same share of its own length, one of five words whole; an empty benchmark gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, released, small_batches, stored

#: Positions that count, of weight 5. A stretch of 6 to 13 words keeps a seed under any changes that leave the share that confirms it.
MASKS = ("11111", "101111", "110111", "111011", "111101", "11100011")
WINDOW, MATCHES = 13, 10
REACH = 16
#: A bit table has three parts of 2^LEAST_BITS to 2^MOST_BITS bits (1.5 to 48 MB in all), 12 bits a key while that is enough.
LEAST_BITS, MOST_BITS = 20, 27
PAGE = 4096

_WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")
_K = np.uint64(0x9E3779B97F4A7C15)
REGIONS = pa.schema([("region", pa.int64()), ("row_key", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("words", pa.list_(pa.int32())), ("places", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))])


def word_hashes(text: str | None, memory: WordHashes) -> np.ndarray:
    words = _WORDS.findall(text.lower().encode("utf-8", "replace")) if text else []
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray) -> list[np.ndarray]:
    """For each mask the hashes of the windows, one for each start."""
    out = []
    for k, mask in enumerate(MASKS):
        n = len(words) - len(mask) + 1
        h = np.full(max(n, 0), k + 1, np.uint64)
        if n > 0:
            for at, c in enumerate(mask):
                if c == "1":
                    h = (h ^ words[at : at + n]) * _K
                    h ^= h >> np.uint64(29)
        out.append(h)
    return out


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """item_id, place, hash and, on the row of the first place, the item's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for b in batches:
            rows = []
            for item, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                w = word_hashes(text, memory)
                own = w.astype(np.uint32).view(np.int32).tolist()
                for h in seeds(w):
                    rows += [(item, at, x, own) for at, x in enumerate(h.view(np.int64).tolist())]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int32()))], names=["item_id", "place", "hash", "item_words"])

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(released(run), "item_id long, place long, hash long, item_words array<int>")


class BitTable:
    """Three tables of bits, of sizes a power of two: a key that was put in has its bit in each."""

    def __init__(self, data: bytes):
        self.tables = np.frombuffer(data, np.uint8).reshape(3, -1)
        self.mask = np.uint64(self.tables.shape[1] * 8 - 1)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For each 64-bit key: false if it is none of those put in."""
        keys = keys.view(np.uint64)
        out = self._bit(0, keys)
        some = np.flatnonzero(out)
        out[some] = self._bit(1, keys[some]) & self._bit(2, keys[some])
        return out

    def _bit(self, k: int, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64((0, 19, 37)[k]) & self.mask
        return (self.tables[k][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def table_bits(keys: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (12 * max(1, keys) - 1).bit_length()))


def bit_table(hashes: DataFrame) -> bytes:
    """A BitTable's data of hashes(hash). Tasks send the pages that they fill, which are joined by OR; with more keys than it is meant for it passes more, never less."""
    bits = table_bits(hashes.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            for k, shift in enumerate((0, 19, 37)):
                at = np.unique(((h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) + (k << bits))
                page, first = np.unique(at // (8 * PAGE), return_index=True)
                for p, x in zip(page.tolist(), np.split(at % (8 * PAGE), first[1:]), strict=True):
                    if p not in pages:
                        pages[p] = np.zeros(PAGE, np.uint8)
                    np.bitwise_or.at(pages[p], x >> 3, (1 << (x & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array([x.tobytes() for x in pages.values()], pa.binary())], names=["page", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held = None, None
        for b in batches:
            for p, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(bits, np.uint8)
                if p != page:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["page", "bits"])
                    page, held = p, x
                else:
                    held = held | x
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["page", "bits"])

    out = np.zeros((3 << bits) // 8, np.uint8).reshape(-1, PAGE)
    for r in hashes.select("hash").mapInArrow(released(run), "page long, bits binary").repartition(8, "page").sortWithinPartitions("page").mapInArrow(released(joined), "page long, bits binary").collect():  # the table itself
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart whose ids are null or repeat; equal rows have equal keys."""
    return F.xxhash64(doc_id, text)


def hit_regions(docs: DataFrame, table: bytes) -> DataFrame:
    """Stretches of documents around windows whose hashes may be listed, with the hits in them."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 48 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, memory = BitTable(shared.value), WordHashes()
        for b in batches:
            docs_, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = [word_hashes(x, memory) for x in b.column(2).to_pylist()]
            ends = np.cumsum([len(w) for w in texts])
            every = np.concatenate(texts) if texts else np.empty(0, np.uint64)
            hits = []
            for mask, h in zip(MASKS, seeds(every), strict=True):  # of all texts at once; windows across two of them go
                at = np.flatnonzero(bits.may_hold(h))
                own = np.searchsorted(ends, at, "right")
                ok = at + len(mask) <= ends[own]
                hits.append((own[ok], at[ok], h[at[ok]]))
            own, place, x = (np.concatenate(c) for c in zip(*hits, strict=True))
            o = np.lexsort((place, own))
            own, place, x = own[o], place[o], x[o]
            rows = []
            for of in np.split(np.arange(len(own)), np.flatnonzero(np.diff(own)) + 1) if len(own) else ():
                k = int(own[of[0]])
                at, words, key = place[of] - (int(ends[k]) - len(texts[k])), texts[k].astype(np.uint32).view(np.int32), keys[k]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * REACH) + 1):
                    first, last = max(0, int(at[part[0]]) - REACH), min(len(words), int(at[part[-1]]) + REACH + max(map(len, MASKS)))
                    rows.append({"region": xxhash.xxh3_64_intdigest(words[first:last].tobytes(), key & 0xFFFFFFFFFFFFFFFF) - (1 << 63), "row_key": key, "doc_id": docs_[k], "first": first, "words": words[first:last], "places": at[part], "hashes": x[of][part].view(np.int64)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=REGIONS)

    return docs.select(F.col("doc_id").cast("long"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text").mapInArrow(released(run), "region long, row_key long, doc_id long, first long, words array<int>, places array<bigint>, hashes array<bigint>")


def overlap(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Laying item so that its word 0 stands at words[shift]: the first and end of the confirmed stretch in words and its equal words; zeros if none."""
    a, b = max(0, shift), min(len(words), shift + len(item))
    need = min(WINDOW, len(item))
    if b - a < need:
        return 0, 0, 0
    same = words[a:b] == item[a - shift : b - shift]
    sums = np.convolve(same, np.ones(need, int), "valid")
    good = np.flatnonzero(sums * WINDOW >= MATCHES * need)
    if not len(good):
        return 0, 0, 0
    lo, hi = int(good[0]), int(good[-1]) + need
    return a + lo, a + hi, int(same[lo:hi].sum())


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row_key, item_id, first_word, end_word, equal_words: the best confirmed overlap of each document and item."""
    small_batches(docs.sparkSession)
    listed = stored(item_seeds(benchmark), "seeds")
    regions = stored(hit_regions(docs, bit_table(listed)), "regions")
    hits = regions.select("region", "first", F.explode(F.arrays_zip("places", "hashes")).alias("h")).select("region", F.col("h.hashes").alias("hash"), (F.col("h.places") - F.col("first")).alias("at"))
    laid = hits.join(listed.select("item_id", "place", "hash"), "hash").select("region", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    items = listed.where("place = 0").select(F.col("item_id").alias("_item"), "item_words").dropDuplicates(["_item", "item_words"])
    stretches = regions.select("region", "row_key", "doc_id", "first", "words").dropDuplicates(["region"])
    both = laid.join(stretches, "region").join(items, laid["item_id"].eqNullSafe(items["_item"])).select("row_key", "doc_id", "first", "words", "item_id", "item_words", "shift")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            words, item = b.column(3), b.column(5)
            for k, (key, doc, first, name, shift) in enumerate(zip(*[b.column(c).to_pylist() for c in (0, 1, 2, 4, 6)], strict=True)):
                lo, hi, n = overlap(words[k].values.to_numpy(), item[k].values.to_numpy(), shift)
                if n:
                    rows.append((doc, key, name, first + lo, first + hi, n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "row_key", "item_id", "first_word", "end_word", "equal_words"])

    found = both.mapInArrow(released(run), "doc_id long, row_key long, item_id long, first_word long, end_word long, equal_words long")
    best = F.max(F.struct("equal_words", (-F.col("first_word")).alias("_f"), F.col("end_word"))).alias("b")
    return found.groupBy("doc_id", "row_key", "item_id").agg(best).select("doc_id", "row_key", "item_id", (-F.col("b._f")).alias("first_word"), F.col("b.end_word").alias("end_word"), F.col("b.equal_words").alias("equal_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap with no benchmark item, with all their columns."""
    bad = overlaps(docs, benchmark).select(F.col("row_key").alias("_bad")).distinct()
    return docs.join(bad, row_key(docs["doc_id"], docs["text"]) == bad["_bad"], "left_anti")
