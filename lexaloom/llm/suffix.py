"""Suffix-array deduplication of byte strings by bucket-pointer refinement.

Removes each byte that a string of LENGTH bytes covers which also starts anywhere else.

1. Dealing. Of the places in each LENGTH-byte window, the one with the least identifier of its first
   ANCHOR bytes stands for the window (the last of equal ones). Neighbouring windows share it, so about one
   place in 69 is dealt out, to the bucket of its identifier, with a fingerprint of the stretch that its
   windows cover. Equal windows have equal places in them, so they meet in one bucket.
2. A place alone in its bucket has no repeated window. Places with equal stretches repeat in full.
3. Buckets with company are sorted by bucket-pointer refinement (refined): the suffixes of their stretches
   start in the buckets of their first GRAM bytes; the members of each bucket with company are sorted by the
   bucket pointers of the places at the offset of the depth reached, which doubles the depth; the pointers
   are updated and the next depth reuses them. Suffixes alone in their bucket are done. Windows that have
   company at depth LENGTH repeat.

Buckets that are large within a task are sent on as one row and their members go to step 3 directly. A
bucket of more than HOT bytes of stretches is not sorted in one task: its windows become rows by the
identifier of their LENGTH bytes, which are pre-aggregated.
The identifiers of dealt buckets, the fingerprints within them and the hot windows' identifiers have 64 bits.

Defined results: null and empty texts have no bytes; texts below LENGTH lose nothing; rows that repeat
make each other's strings repeat; null ids are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, stored, utf8
from .decontam import BitTable, bit_table, row_key

LENGTH, ANCHOR, GRAM = 200, 64, 8
PART_BYTES = 32_000_000  # of text, about a third of it in dealt places
PIECE = 1 << 20
BATCH = 200_000
HEAVY = 64
TASK, HOT = 1 << 19, 1 << 20  # bytes of stretches after which a task sorts what it holds, and of a bucket
_K = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)
_FIRST = np.random.default_rng(12).integers(0, 1 << 63, 256, np.uint64)


def _paired(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The identifiers of pairs of strings by theirs."""
    h = ids * _K
    h ^= other
    h ^= h >> _S
    h *= _K2
    h ^= h >> np.uint64(32)
    return h


def identifiers(data: np.ndarray, depth: int) -> np.ndarray:
    """Identifiers of the depth's leading bytes at each place (depth: a power of two)."""
    ids, q = _FIRST[data], 1
    while q < depth:
        ids = _paired(ids[:-q], ids[q:]) if len(ids) > q else ids[:0]
        q *= 2
    return ids


def windows(data: np.ndarray) -> np.ndarray:
    """Identifiers of the LENGTH bytes at each place."""
    b = identifiers(data, 128)
    n = len(data) - LENGTH + 1
    return _paired(b[:n], b[LENGTH - 128 :][:n]) if n > 0 else b[:0]


def sort_buckets(key: np.ndarray, place: np.ndarray, pointer: np.ndarray, base: np.ndarray | int) -> np.ndarray:
    """Sort places by key; each one's pointer becomes the end of its new bucket, on from base. Returns the places that have company, in order."""
    order = np.argsort(key)
    key, place = key[order], place[order]
    starts, sizes = runs_of(key)
    pointer[place] = np.repeat(starts + sizes, sizes) - 1 + (base if np.isscalar(base) else base[order])
    return place[np.repeat(sizes > 1, sizes)]


def repeated_windows(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The part and the place in it of each LENGTH-byte window that also starts elsewhere in the parts, by bucket-pointer refinement.

    pointer[p] is the last rank of p's bucket, so buckets stand in lexicographic order, and refining one
    leaves the pointers of the others as they are.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts) + bytes(GRAM), np.uint8)
    end = np.repeat(np.cumsum(sizes), sizes)
    places = np.arange(len(end))
    grams, k = data.astype(np.uint64), 1
    while k < GRAM:  # the first GRAM bytes as a number, high byte first
        grams = grams[:-k] << np.uint64(8 * k) | grams[k:]
        k *= 2
    pointer = np.empty(len(end), np.int64)
    inside = places[places + GRAM <= end]  # a string of the depth reached fits into its part
    company = sort_buckets(grams[inside], inside, pointer, 0)
    depth = GRAM
    while depth < LENGTH and len(company):
        step = min(depth, LENGTH - depth)
        company = company[company + depth + step <= end[company]]
        own = pointer[company]
        # the members of a bucket stay behind each other: its first rank is its last one less its size, of those that still fit
        starts, counts = runs_of(np.sort(own))
        first = np.zeros(int(own.max(initial=-1)) + 1, np.int64)
        ranked = np.sort(own)[starts] if len(own) else own
        first[ranked] = ranked - (starts + counts - 1)
        company = sort_buckets(own.astype(np.uint64) << np.uint64(32) | pointer[company + step].astype(np.uint64), company, pointer, first[own])
        depth += step
    company = np.sort(company)
    part = np.searchsorted(np.cumsum(sizes), company, "right")
    return part, company - (np.cumsum(sizes) - sizes)[part]


def stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each maximal run of windows with one anchor: the anchor's bucket and place, the first and last window."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e, e
    ids = identifiers(data, ANCHOR)
    low = (ids & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(ids) - 1, -1, -1, dtype=np.uint64)
    width, k, least = LENGTH - ANCHOR + 1, 1, low
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    least = np.minimum(least[:n], least[width - k : width - k + n])
    place = len(ids) - 1 - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    p = place[first]
    return ids[p], p, first, np.r_[first[1:], n] - 1


def text_stretches(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, fingerprint, first, last window) in pieces, so that a long text takes bounded memory."""
    for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
        piece = text[at : at + PIECE + LENGTH - 1]
        a, _, first, last = stretches(np.frombuffer(piece, np.uint8))
        if len(a):
            digest = xxhash.xxh3_64_intdigest
            s = np.fromiter((digest(piece[i : j + LENGTH]) for i, j in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(a))
            yield a, s, first + at, last + at


ROW = np.dtype([("a", "<u8"), ("s", "<u8"), ("key", "<i8"), ("first", "<i8"), ("more", "u1"), ("flag", "u1")])
MULTI, CROWDED = 1, 2


def runs_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts and sizes of runs in a sorted array."""
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(a)])


def split_rows(rows: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sent on, repeated in full, to be refined) of a set of places.

    Places with equal bucket and stretch repeat; one of them goes on. In a task (not final) a bucket of
    over HEAVY stretches sends one; at the end buckets of one place are dropped and others refined.
    """
    rows = rows[np.lexsort((rows["flag"] == 0, rows["s"], rows["a"]))]
    both = np.empty(len(rows), [("a", "<u8"), ("s", "<u8")])
    both["a"], both["s"] = rows["a"], rows["s"]
    starts, sizes = runs_of(both)
    flags = np.bitwise_or.reduceat(rows["flag"], starts) if len(starts) else rows["flag"]
    full = (np.repeat(sizes, sizes) > 1) | (np.repeat(flags, sizes) & MULTI > 0)
    repeated = rows[full]
    one = rows[starts]
    one["flag"] = flags | np.where(sizes > 1, MULTI, 0).astype(np.uint8)
    starts, sizes = runs_of(one["a"])
    crowd = np.bitwise_or.reduceat(one["flag"], starts) & CROWDED > 0 if len(starts) else np.empty(0, bool)
    crowd |= sizes > (1 if final else HEAVY)
    inside = np.repeat(crowd, sizes)
    if final:
        return one[:0], repeated, one[inside]
    heads = one[starts[crowd]].copy()
    heads["flag"] |= CROWDED
    rest = inside.copy()
    rest[starts[crowd]] = False  # a head comes to be refined from the last step
    return np.concatenate([one[~inside], heads]), repeated, one[rest]


def _marks(rows: np.ndarray) -> list[pa.Array]:
    return [pa.array(rows["key"]), pa.array(rows["first"]), pa.array(rows["more"].astype(np.int64) + LENGTH)]


SPLIT = pa.schema([(c, pa.int64()) for c in ("bucket", "row_key", "first", "n")])


def _split_batches(repeated: np.ndarray, refine: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows without a bucket are marks; those with one are stretches to refine."""
    for rows, refined in ((repeated, False), (refine, True)):
        for k in range(0, len(rows), 100_000):
            part = rows[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part["a"].view(np.int64)) if refined else pa.nulls(len(part), pa.int64()), *_marks(part)], schema=SPLIT)


def dealt(docs: DataFrame, parts: int) -> DataFrame:
    """part, data: places of each part's buckets; part -1 - k: results known within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0

        def out() -> pa.RecordBatch:
            nonlocal turn
            turn += 1
            sent, repeated, refine = split_rows(np.concatenate(held), False)
            part = (sent["a"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, 0, pack(sent[order[cut[p] : cut[p + 1]]])) for p in range(parts) if cut[p] < cut[p + 1]]
            rows += [(turn % parts, kind, pack(x)) for kind, x in ((1, repeated), (2, refine)) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "kind", "data"])

        held, n = [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                for a, s, first, last in text_stretches(text or b""):
                    rows = np.zeros(len(a), ROW)
                    rows["a"], rows["s"], rows["key"], rows["first"], rows["more"] = a, s, key, first, last - first
                    held.append(rows)
                    n += len(rows)
                if n >= BATCH:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return docs.select(row_key(F.col("doc_id"), F.col("text")), "text").mapInArrow(released(run), "part int, kind int, data binary")


def pack(rows: np.ndarray) -> bytes:
    """Columns after each other, keys once each: 22 bytes a place and little more."""
    keys, own = np.unique(rows["key"], return_inverse=True)
    wide = rows["first"].max() >= 1 << 32 if len(rows) else False
    own_kind = np.uint16 if len(keys) <= 1 << 16 else np.uint32
    head = np.array([len(rows), len(keys), wide, own_kind().itemsize], np.int64)
    return b"".join(x.tobytes() for x in (head, keys, rows["a"], rows["s"], rows["first"].astype(np.uint64 if wide else np.uint32), own.astype(own_kind), rows["more"], rows["flag"]))


def unpack(data: bytes) -> np.ndarray:
    n, k, wide, own_size = np.frombuffer(data, np.int64, 4).tolist()
    at, rows = 32, np.empty(n, ROW)

    def take(kind, m: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, m, at)
        at += x.nbytes
        return x

    keys = take(np.int64, k)
    rows["a"], rows["s"] = take(np.uint64, n), take(np.uint64, n)
    rows["first"] = take(np.uint64 if wide else np.uint32, n)
    rows["key"] = keys[take(np.uint16 if own_size == 2 else np.uint32, n)]
    rows["more"], rows["flag"] = take(np.uint8, n), take(np.uint8, n)
    return rows


def split_buckets(blocks: DataFrame) -> DataFrame:
    """bucket, row_key, first, n: marks (bucket null) and stretches to refine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None
        for b in batches:
            for p, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if p != part:
                    if held:
                        yield from _split_batches(*split_rows(np.concatenate(held), True)[1:])
                    held, part = [], p
                rows = unpack(data.as_py())
                if kind:
                    yield from _split_batches(*((rows, rows[:0]) if kind == 1 else (rows[:0], rows)))
                else:
                    held.append(rows)
        if held:
            yield from _split_batches(*split_rows(np.concatenate(held), True)[1:])

    return blocks.sortWithinPartitions("part").mapInArrow(released(run), "bucket long, row_key long, first long, n long")


def contexts(docs: DataFrame, refine: DataFrame) -> DataFrame:
    """bucket, row_key, first, bytes of the stretches to refine, which are told apart by (bucket, row_key, first, n)."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(refine.select(F.col("row_key").alias("hash"))))  # 48 MB at most

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = BitTable(table.value)
        for b in batches:
            yield b.filter(pa.array(bits.may_hold(b.column(0).to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buckets, keys, firsts, parts, size = [], [], [], [], 0
            for key, text, places in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2), strict=True):
                v = places.values
                for bucket, first, n in zip(v.field(0).to_pylist(), v.field(1).to_pylist(), v.field(2).to_pylist(), strict=True):
                    buckets.append(bucket)
                    keys.append(key)
                    firsts.append(first)
                    parts.append(text[first : first + n])
                    size += n
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(keys), pa.array(firsts), pa.array(parts, pa.binary())], names=["bucket", "row_key", "first", "bytes"])
                    buckets, keys, firsts, parts, size = [], [], [], [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(keys), pa.array(firsts), pa.array(parts, pa.binary())], names=["bucket", "row_key", "first", "bytes"])

    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text").mapInArrow(released(thinned), "row_key long, text string").dropDuplicates(["row_key"])
    places = refine.groupBy("row_key").agg(F.collect_set(F.struct("bucket", "first", "n")).alias("places"))  # bounded by a text's length
    return texts.join(places, "row_key").select("row_key", "text", "places").mapInArrow(released(cut), "bucket long, row_key long, first long, bytes binary")


def refined_marks(found: DataFrame) -> DataFrame:
    """row_key, first, n of the windows with company in their bucket of depth LENGTH, joined to runs.

    found has all stretches of each bucket; a task sorts whole buckets, of TASK and a bucket (HOT) in bytes at most at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            own, within = repeated_windows(parts)
            if len(own):
                new = np.r_[True, (own[1:] != own[:-1]) | (within[1:] != within[:-1] + 1)]
                lo, hi = np.flatnonzero(new), np.flatnonzero(np.r_[new[1:], True])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys)[own[lo]]), pa.array(np.array(firsts)[own[lo]] + within[lo]), pa.array(hi - lo + LENGTH)], names=["row_key", "first", "n"])

        keys, firsts, parts, bucket, size = [], [], [], None, 0
        for b in batches:
            for g, key, first, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if g != bucket and size > TASK:
                    yield from out()
                    keys, firsts, parts, size = [], [], [], 0
                bucket = g
                keys.append(key)
                firsts.append(first)
                parts.append(data)
                size += len(data)
        if parts:
            yield from out()

    return found.select("bucket", "row_key", "first", "bytes").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(run), "row_key long, first long, n long")


def hot_marks(found: DataFrame) -> DataFrame:
    """As refined_marks, with a row for each window: counts are pre-aggregated, so a bucket may hold any number of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, first, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = windows(np.frombuffer(data, np.uint8)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(np.arange(first, first + len(ids))), pa.array(ids)], names=["row_key", "first", "id"])

    rows = found.select("row_key", "first", "bytes").mapInArrow(released(run), "row_key long, first long, id long")
    twice = rows.groupBy("id").count().where("count > 1").select("id")
    return rows.join(twice, "id").select("row_key", "first", F.lit(LENGTH).cast("long").alias("n"))


def repeated_marks(docs: DataFrame, parts: int, hot: int = HOT) -> DataFrame:
    """row_key, first, n: byte runs that strings of LENGTH bytes cover which also start elsewhere (runs may overlap)."""
    split = stored(split_buckets(dealt(docs, parts).repartitionById(parts, F.col("part"))), "buckets")
    refine = split.where("bucket IS NOT NULL")
    twice = refine.groupBy("bucket", "row_key", "first", "n").count().where("count > 1")  # of rows that repeat
    marks = split.where("bucket IS NULL").select("row_key", "first", "n").union(twice.select("row_key", "first", "n"))
    crowded = refine.groupBy("bucket").agg(F.sum("n").alias("_size")).where(F.col("_size") > hot).select("bucket")
    if crowded.isEmpty():
        return marks.union(refined_marks(contexts(docs, refine)))
    hot_ones, others = refine.join(crowded, "bucket", "left_semi"), refine.join(crowded, "bucket", "left_anti")
    return marks.union(refined_marks(contexts(docs, others))).union(hot_marks(contexts(docs, hot_ones)))


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted (first, n) as maximal (start, end) runs; runs that touch are one."""
    out: list[list[int]] = []
    for first, n in places:
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], first + n)
        else:
            out.append([first, first + n])
    return [(a, b) for a, b in out]


def left_parts(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    ends = [0, *[x for span in spans for x in span], len(text)]
    return [text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]


def deduplicated(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), *, with_text: bool = False, part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """keep, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining text, null for null) and spans, for every row of docs.

    A character that is cut goes whole from `kept`; n_removed and kept_sha256 count bytes.

    Texts that have no marks, by a bit table of their rows, are not shuffled.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // part_bytes))
    marks = stored(repeated_marks(docs, parts, hot).groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("first", "n"))).alias("places")), "marks", files=parts)
    table = docs.sparkSession.sparkContext.broadcast(bit_table(marks.select(F.col("row_key").alias("hash"))))  # 48 MB at most
    kinds = dict(docs.dtypes)
    kept = [f"_k{i}" for i in range(len(keep))]
    own = ", ".join(f"{k} {kinds[c]}" for k, c in zip(kept, keep, strict=True))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = BitTable(table.value)
        for b in batches:
            some = bits.may_hold(b.column(0).to_numpy())
            whole = utf8(b.column(1))
            texts = [x or b"" for x in whole]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x if s or with_text else None for x, s in zip(whole, some, strict=True)], pa.binary()), pa.array([len(x) for x in texts], pa.int64()), pa.array([None if s else hashlib.sha256(x).hexdigest() for x, s in zip(texts, some, strict=True)], pa.string()), *b.columns[2:]], names=["row_key", "data", "n_bytes", "sha", *kept])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, spans, sha, rest, runs = [], [], [], [], []
            for text, digest, places in zip(b.column(0), b.column(2).to_pylist(), b.column(3), strict=True):
                found = merged(list(zip(places.values.field(0).to_pylist(), places.values.field(1).to_pylist(), strict=True))) if places.is_valid else []
                text = text.as_py()
                left = left_parts(text or b"", found)
                removed.append(sum(e - s for s, e in found))
                spans.append(len(found))
                sha.append(digest if digest is not None and not found else hashlib.sha256(b"".join(left)).hexdigest())
                rest.append("".join(x.decode("utf-8", "ignore") for x in left) if with_text and text is not None else None)
                runs.append([{"start": s, "end": e} for s, e in found])
            more = [pa.array(rest, pa.string()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))] if with_text else []
            yield pa.RecordBatch.from_arrays([*b.columns[4:], b.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), *more], names=[*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "spans"] * with_text])

    rows = docs.select(row_key(docs["doc_id"], docs["text"]).alias("_row_key"), docs["text"].alias("_text"), *[docs[c].alias(k) for k, c in zip(kept, keep, strict=True)])
    texts = rows.mapInArrow(released(thinned), f"row_key long, data binary, n_bytes long, sha string, {own}")
    joined = texts.join(marks, "row_key", "left").select("data", "n_bytes", "sha", "places", *kept)
    done = joined.mapInArrow(released(finished), f"{own}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string, spans array<struct<start: bigint, end: bigint>>" * with_text)
    return done.withColumnsRenamed(dict(zip(kept, keep, strict=True)))
