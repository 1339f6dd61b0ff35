"""N-gram Jaccard join: documents whose sets of word shingles are at least 75 % alike, as components.

1. Each set's first shingles by hash (more than a prefix filter needs) go to inverted lists. A linked
   pair shares SPARE of its shingles there, so a set with fewer shared ones has no link.
2. Two of those left that share a list of at most LONG sets are a pair; pairs of unlike sizes, and those
   whose parity bit maps differ in more bits than a link allows, are dropped. Sets with so many shingles in
   longer lists that a link could hide there are joined through those lists, too, by way of each list's least
   sets, whatever these are. This makes families.
3. Within a family a T-occurrence search gives the links, with DivideSkip: short lists are merged by a heap
   that skips what can't reach the required overlap, long ones probed by binary search for the candidates
   left. Lists of the same sets are one list, which counts for as many shingles.
   Sets that link to the family's pivot are one component already, so only the others search.
   A family of over half of GROUP_SHINGLES is searched by several tasks, each for a block of its sets
   among a block of GROUP_SHINGLES; a larger one has several of both.
4. Components of the links, over classes of equal sets.

Nothing is capped or sampled: every linked pair of different sets is found or implied by others. Equal
sets are one node, named by a 64-bit digest.

Defined results: null and wordless texts have 0 shingles and are their own component; texts of fewer
words than a shingle are one shingle; repeated rows count each; a null id is ignored where another
row of its component has one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, released, small_batches, stored, utf8, words_of
from .components import connected_components
from .decontam import BitTable, bit_table, row_key

SHINGLE, PERCENT, SPARE = 5, 75, 10  # a tenth of a set's shingles is asked of shared lists beyond one
PART_BYTES = 20_000_000
GROUP_SHINGLES = 1_000_000  # 8 MB
LONG = 64
PAIR_BYTES = 50_000_000  # of text for a part of the lists' pairs
PAIRS = 4_000_000  # pairs that are sorted at once, 8 bytes each
HEAP_STEP = 10.0  # the cost of a heap step in probes
_K = np.uint64(0x9E3779B97F4A7C15)
DOC = np.dtype([("node", "<i8"), ("doc_id", "<i8"), ("null", "?"), ("key", "<i8"), ("n", "<i8")])


def shingle_set(data: bytes | None, memory: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = words_of(data)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ w[k : k + len(h)]) * _K
        h ^= h >> np.uint64(29)
    return np.unique(h)


def least_shared(n):
    """The shared shingles among first ones that any link of a set of n needs."""
    return (n * PERCENT + 99) // 100 // SPARE + 1


def first_shingles(n: int) -> int:
    return min(n, n - -(-n * PERCENT // 100) + n // SPARE + 1)


def bands(n: np.ndarray) -> np.ndarray:
    """Sizes of a ratio of at most 4/3 lie in the same or in neighbouring bands; a hair wide, for rounding."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / PERCENT + 1e-9)).astype(np.int64)


def required(a, b):
    """The overlap at which sets of a and b shingles link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def parity(s: np.ndarray) -> np.ndarray:
    """Bit k is set if an odd number of hashes end in k; as many bits as the set has shingles, a power of two and at least 64."""
    size = max(64, 1 << (max(1, len(s)) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def may_link(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
    """False if the parity maps of sets of n and m shingles differ in more bits than the sets may in shingles."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= n + m - 2 * required(n, m)


def postings(docs: DataFrame, parts: int, long: int = LONG) -> DataFrame:
    """part, kind, data: packed inverted lists (kind 0), document rows (kind 1) with their parity maps, and edges of lists
    that are long within a batch of documents (kind 2), of which only each band's least set goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, turn = WordHashes(), TaskContext.get().partitionId()
        for whole in batches:
            for start in range(0, whole.num_rows, 5_000):
                b = whole.slice(start, 5_000)
                turn += 1
                ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
                rows, tokens, owners, maps = np.zeros(b.num_rows, DOC), [], [], []
                for k, text in enumerate(utf8(b.column(2))):
                    s = shingle_set(text, memory)
                    rows[k] = (xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), ids[k] or 0, ids[k] is None, keys[k], len(s))
                    maps.append(parity(s).tobytes())
                    p = first_shingles(len(s))
                    tokens.append(s[:p])
                    owners.append(np.full(p, k, np.uint16))
                out = [(turn % parts, 1, np.int64(len(rows)).tobytes() + rows.tobytes() + b"".join(maps))]
                if tokens:
                    t = np.concatenate(tokens) * _K
                    t ^= t >> np.uint64(32)
                    o = np.concatenate(owners)
                    one = np.zeros(len(rows), bool)
                    one[np.unique(rows["node"], return_index=True)[1]] = True  # equal sets once
                    t, o = t[one[o]], o[one[o]]
                    t, o, hot, edges = without_long(t, o, rows["node"], rows["n"], long)
                    if len(edges[0]):
                        out.append((turn % parts, 2, np.concatenate(edges).tobytes()))
                    part = (t % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    cut = np.searchsorted(part[order], np.arange(parts + 1))
                    for p in range(parts):
                        at = order[cut[p] : cut[p + 1]]
                        if len(at):
                            x = t[at] >> np.uint64(24)
                            used, own = np.unique(o[at], return_inverse=True)
                            out.append((p, 0, b"".join((np.array([len(used), len(at)], np.int64).tobytes(), rows["node"][used].tobytes(), rows["n"][used].astype(np.int32).tobytes(), (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (x >> np.uint64(32)).astype(np.uint8).tobytes(), own.astype(np.uint16).tobytes(), hot[at].tobytes()))))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["part", "kind", "data"])

    return docs.select(F.col("doc_id").cast("long"), row_key(F.col("doc_id"), F.col("text")), "text").mapInArrow(released(run), "part int, kind int, data binary")


def without_long(t: np.ndarray, o: np.ndarray, nodes: np.ndarray, n: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """A batch's postings with those of long lists cut to each band's least set, which are marked; and the long lists' edges."""
    order = np.argsort(t, kind="stable")
    t, o = t[order], o[order]
    _, sizes = runs_of(t)
    much = np.repeat(sizes > long, sizes)
    a, b, c, key, head = star_edges(t[much], nodes[o[much]], bands(n[o[much]]))
    at = {x: k for k, x in enumerate(nodes.tolist())}
    heads = np.fromiter((at[x] for x in head.tolist()), np.uint16, len(head))
    hot = np.r_[np.zeros(int((~much).sum()), np.uint8), np.ones(len(key), np.uint8)]
    return np.r_[t[~much], key], np.r_[o[~much], heads], hot, (a, b, c)


def star_edges(key: np.ndarray, node: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a, b, c: in a band of a list, b stands with its least set a; a = b counts b's lists. Then the lists' keys and least sets."""
    own, counts = np.unique(node, return_counts=True)
    key, node, band = np.r_[key, key], np.r_[node, node], np.r_[band, band + 1]
    order = np.lexsort((node, band, key))
    key, node, band = key[order], node[order], band[order]
    if not len(key):
        return node, node, node, key, node
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (band[1:] != band[:-1])])
    a = np.repeat(node[first], np.diff(np.r_[first, len(node)]))
    e = np.unique(np.c_[a, node][a != node], axis=0)
    heads = np.unique(np.array(list(zip(key[first].tolist(), node[first].tolist(), strict=True)), [("k", "<u8"), ("v", "<i8")]))
    return np.r_[own, e[:, 0]], np.r_[own, e[:, 1]], np.r_[counts, np.zeros(len(e), np.int64)], heads["k"], heads["v"]


LISTED = pa.schema([*[(c, pa.int64()) for c in ("list", "node", "n", "doc_id", "row_key", "a", "b", "c")], ("parity", pa.binary())])


def listed_rows(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in LISTED], schema=LISTED)


def split_lists(key: np.ndarray, node: np.ndarray, n: np.ndarray, hot: np.ndarray, long: int) -> Iterator[pa.RecordBatch]:
    """Postings of lists with two different sets or more; those of long ones, or marked as such, as edges."""
    o = np.lexsort((node, key))
    key, node, n, hot = key[o], node[o], n[o], hot[o]
    starts, _ = runs_of(key)
    marked = np.logical_or.reduceat(hot, starts) if len(starts) else hot
    marked = np.repeat(marked, np.diff(np.r_[starts, len(key)]))
    new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.empty(0, bool)
    key, node, n, marked = key[new], node[new], n[new], marked[new]
    _, sizes = runs_of(key)
    sizes = np.repeat(sizes, sizes)
    much = marked | (sizes > long)
    short = ~much & (sizes > 1)
    a, b, c, _, _ = star_edges(key[much], node[much], bands(n[much]))
    c[a != b] = 1  # tells the edges between batches from those within one
    for k in range(0, len(a), 100_000):
        yield listed_rows(**{x: pa.array(y[k : k + 100_000]) for x, y in (("a", a), ("b", b), ("c", c))})
    key, node, n = key[short].astype(np.int64), node[short], n[short].astype(np.int64)
    for k in range(0, len(key), 100_000):
        yield listed_rows(**{x: pa.array(y[k : k + 100_000]) for x, y in (("list", key), ("node", node), ("n", n))})


def listed(blocks: DataFrame, long: int = LONG) -> DataFrame:
    """The shared lists of each part, the edges of long ones, and the document rows, as one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists() -> Iterator[pa.RecordBatch]:
            if held:
                yield from split_lists(*[np.concatenate([x[c] for x in held]) for c in range(4)], long)

        held, part = [], None
        for batch in batches:
            for p, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if p != part:
                    yield from lists()
                    held, part = [], p
                data = data.as_py()
                if kind == 1:
                    yield document_rows(data)
                    continue
                if kind == 2:
                    yield listed_rows(**dict(zip("abc", map(pa.array, np.frombuffer(data, np.int64).reshape(3, -1)), strict=True)))
                    continue
                docs, size = np.frombuffer(data, np.int64, 2).tolist()
                at = 16
                node = np.frombuffer(data, np.int64, docs, at)
                n = np.frombuffer(data, np.int32, docs, at + 8 * docs)
                at += 12 * docs
                low, high = np.frombuffer(data, np.uint32, size, at), np.frombuffer(data, np.uint8, size, at + 4 * size)
                own = np.frombuffer(data, np.uint16, size, at + 5 * size)
                hot = np.frombuffer(data, np.uint8, size, at + 7 * size).astype(bool)
                held.append((high.astype(np.uint64) << np.uint64(32) | low, node[own], n[own], hot))
        yield from lists()

    return blocks.sortWithinPartitions("part").mapInArrow(released(run), "list long, node long, n long, doc_id long, row_key long, a long, b long, c long, parity binary")


def document_rows(data: bytes) -> pa.RecordBatch:
    count = int(np.frombuffer(data, np.int64, 1)[0])
    r = np.frombuffer(data, DOC, count, 8)
    start = 8 + count * DOC.itemsize
    ends = (start + np.cumsum(map_bytes(r["n"]))).tolist()
    maps = [data[a:b] for a, b in zip([start, *ends][:count], ends, strict=True)]
    return listed_rows(node=pa.array(r["node"]), n=pa.array(r["n"]), doc_id=pa.array(r["doc_id"], mask=r["null"]), row_key=pa.array(r["key"]), parity=pa.array(maps, pa.binary()))


def map_bytes(n: np.ndarray) -> np.ndarray:
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)) // 8


def list_pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a, b, n of a, n of b: pairs of sets of like size in the lists, once each."""
    names, first, own = np.unique(node, return_index=True, return_inverse=True)
    size_of, own = n[first], own.astype(np.uint64)
    starts, sizes = runs_of(key)
    pairs, fresh, held = np.empty(0, np.uint64), [], 0
    for size in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(size, 1)
        lists = starts[sizes == size]
        for k in range(0, len(lists), step := max(1, PAIRS // len(i))):
            at = lists[k : k + step, None] + np.arange(size)
            x, y = own[at[:, i].ravel()], own[at[:, j].ravel()]
            p, q = size_of[x], size_of[y]
            ok = (np.minimum(p, q) * 100 >= PERCENT * np.maximum(p, q)) & (x != y)
            fresh.append(np.unique(np.minimum(x, y)[ok] << np.uint64(32) | np.maximum(x, y)[ok]))
            held += len(fresh[-1])
            if held > PAIRS:
                pairs, fresh, held = np.unique(np.concatenate([pairs, *fresh])), [], 0
    pairs = np.unique(np.concatenate([pairs, *fresh]))
    a, b = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return names[a], names[b], size_of[a], size_of[b]


def runs_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(a)])


def candidate_pairs(lists: DataFrame, alive: bytes, parts: int) -> DataFrame:
    """a, b, n, m: pairs of sets in short lists and their sizes. alive: a bit table of the sets left."""
    shared = lists.sparkSession.sparkContext.broadcast(alive)  # 48 MB at most

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = BitTable(shared.value)
        for b in batches:
            yield b.filter(pa.array(bits.may_hold(b.column(1).to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate([r[c] for r in rows]) for c in range(3)]
            pairs = list_pairs(*columns)
            for k in range(0, len(pairs[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 200_000]) for x in pairs], names=["a", "b", "n", "m"])

        held, size = [], 0
        for b in batches:  # lists are whole: a cut falls between two of them
            rows = [c.to_numpy() for c in b.columns]
            if size > 1_000_000:
                last = held[-1][0][-1]
                n = int(np.searchsorted(rows[0], last, "right"))
                if n < len(rows[0]):
                    yield from out([*held, [x[:n] for x in rows]])
                    held, size, rows = [], 0, [x[n:] for x in rows]
            held.append(rows)
            size += len(rows[0])
        if held:
            yield from out(held)

    kept = lists.select("list", "node", "n").mapInArrow(released(left), "list long, node long, n long")
    # as many tasks as the lists' size asks for: each names a pair once, so more tasks would name it more often
    return kept.repartitionById(parts, F.pmod("list", F.lit(parts)).cast("int")).sortWithinPartitions("list").mapInArrow(released(run), "a long, b long, n long, m long")


def likely_pairs(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs(a, b, n, m) whose parity maps(node, parity) allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [may_link(np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8), n, m) for x, y, n, m in zip(batch.column(4), batch.column(5), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    left, right = maps.select(F.col("node").alias("a"), F.col("parity").alias("pa")), maps.select(F.col("node").alias("b"), F.col("parity").alias("pb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "pa", "pb").mapInArrow(released(run), "a long, b long")


def heap_merged(lists: list[list[int]], weights: list[int], least: int) -> tuple[list[int], list[int]]:
    """The members of sorted lists whose lists weigh at least `least`, and that weight; a heap of the lists' next members skips what can't."""
    heap = [(x[0], k) for k, x in enumerate(lists)]
    heapify(heap)
    at, found, counts = [0] * len(lists), [], []
    while heap:
        doc, count, taken = heap[0][0], 0, []
        while heap and heap[0][0] == doc:
            k = heappop(heap)[1]
            count += weights[k]
            taken.append(k)
        if count >= least:
            found.append(doc)
            counts.append(count)
            for k in taken:
                at[k] += 1
                if at[k] < len(lists[k]):
                    heappush(heap, (lists[k][at[k]], k))
            continue
        while heap and count + weights[heap[0][1]] < least:
            k = heappop(heap)[1]
            count += weights[k]
            taken.append(k)
        if not heap:  # what is left in the lists taken can't reach least
            break
        for k in taken:
            at[k] = bisect_left(lists[k], heap[0][0], at[k])
            if at[k] < len(lists[k]):
                heappush(heap, (lists[k][at[k]], k))
    return found, counts


class Inverted:
    """Inverted lists over a family's sets, and T-occurrence searches in them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.n = sets, np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        o = np.argsort(every, kind="stable")
        docs, key = owner[o], every[o]
        starts, sizes = runs_of(key)
        self.keys = key[starts]
        # lists of the same sets are one, told by two sums of random numbers of their sets
        sums = [np.add.reduceat(r[docs], starts) if len(starts) else key for r in np.random.default_rng(5).integers(0, 1 << 63, (2, len(sets)), np.uint64)]
        order = np.lexsort((*sums, sizes))
        new = np.r_[True, (sizes[order][1:] != sizes[order][:-1]) | (sums[0][order][1:] != sums[0][order][:-1]) | (sums[1][order][1:] != sums[1][order][:-1])] if len(order) else np.empty(0, bool)
        self.merged = np.empty(len(order), np.int64)  # the list of each key, by size
        self.merged[order] = np.cumsum(new) - 1
        own = order[new]
        self.docs, self.starts, self.sizes = docs, starts[own], sizes[own]
        self.held: dict[int, list[int]] = {}

    def lists(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of a set's shingles, short ones first, and how many shingles each stands for."""
        at = np.searchsorted(self.keys, s)
        at[at == len(self.keys)] = 0
        return np.unique(self.merged[at[self.keys[at] == s]] if len(self.keys) else at[:0], return_counts=True)

    def members(self, k: int) -> np.ndarray:
        return self.docs[self.starts[k] : self.starts[k] + self.sizes[k]]

    def linked(self, s: np.ndarray, own: int = -1) -> np.ndarray:
        """The sets whose overlap with s makes a link: s itself, too, if it is one of them and its number isn't told as own."""
        lists, weights = self.lists(s)
        sizes = self.sizes[lists]
        others = (sizes > 1) | (self.docs[self.starts[lists]] != own)  # lists of s alone bring it to nobody
        lists, weights, sizes = lists[others], weights[others], sizes[others]
        t, total = -(-len(s) * PERCENT // 100), int(weights.sum())
        if not len(s) or total < t:
            return np.empty(0, np.int64)
        # DivideSkip: the longest lists, of a weight below t, are set aside; as many as make merging (a heap step a member) and probing (candidates times lists) cheapest
        work = np.cumsum(sizes)
        left = total - np.cumsum(weights)
        cost = HEAP_STEP * work + np.minimum(len(self.n), np.cumsum(sizes * weights) / np.maximum(t - left, 1)) * (len(lists) - 1 - np.arange(len(lists)))
        cut = int(np.argmin(np.where(left < t, cost, np.inf))) + 1
        short, aside = lists[:cut].tolist(), int(left[cut - 1])
        for k in short:
            if k not in self.held:
                self.held[k] = self.members(k).tolist()
        found, counts = (np.array(x, np.int64) for x in heap_merged([self.held[k] for k in short], weights[:cut].tolist(), t - aside))
        m = self.n[found]
        ok = (m * 100 >= len(s) * PERCENT) & (m * PERCENT <= len(s) * 100) & (found != own)
        found, counts, need = found[ok], counts[ok], required(len(s), m[ok])
        for k, w in zip(lists[cut:].tolist(), weights[cut:].tolist(), strict=True):
            able = counts + aside >= need
            found, counts, need = found[able], counts[able], need[able]
            if not len(found):
                break
            members = self.members(k)
            p = np.searchsorted(members, found)
            counts = counts + w * (members[np.minimum(p, len(members) - 1)] == found)
            aside -= w
        return found[counts >= need]


def family_links(names: list[int], sets: list[np.ndarray], asks: list[bool], answers: list[bool]) -> list[tuple[int, int]]:
    """(name, root) for the names that the links between asking and answering sets join to another."""
    root = list(range(len(names)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    here = [k for k, x in enumerate(answers) if x]
    index = Inverted([sets[k] for k in here])
    left = len(names)

    place = {k: i for i, k in enumerate(here)}

    def ask(q: int) -> None:
        nonlocal left
        for k in index.linked(sets[q], place.get(q, -1)).tolist():
            a, b = find(q), find(here[k])
            if a != b:
                root[max(a, b)] = min(a, b)
                left -= 1

    todo = [k for k, x in enumerate(asks) if x]
    if len(here) == len(names) == len(todo) and len(names) > 2:  # the set with most company first
        mass = [int((index.sizes[k] * w).sum()) / max(1, len(s)) for s in sets for k, w in (index.lists(s),)]
        pivot = max(todo, key=lambda k: (mass[k], -k))
        ask(pivot)
        todo = sorted((k for k in todo if find(k) != find(pivot)), key=lambda k: (-mass[k], k))
    for q in todo:
        if left == 1:
            break
        ask(q)
    least: dict[int, int] = {}
    for k, name in enumerate(names):
        r = find(k)
        least[r] = min(least.get(r, name), name)
    return [(name, least[find(k)]) for k, name in enumerate(names) if least[find(k)] != name]


def search(members: DataFrame) -> DataFrame:
    """a, b: links that join the classes of members(grp, cls, asks, answers, shingles), group by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            names = sorted(held)
            return family_links(names, [np.frombuffer(held[k][2], np.uint64) for k in names], [held[k][0] for k in names], [held[k][1] for k in names])

        held, group, out = {}, None, []
        for b in batches:
            for g, cls, asks, answers, data in zip(*[c.to_pylist() for c in b.columns[:4]], b.column(4), strict=True):
                if g != group:
                    out += links()
                    held, group = {}, g
                was = held.get(cls, (False, False, None))
                held[cls] = (asks or was[0], answers or was[1], data.as_py())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out := links():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return members.select("grp", "cls", "asks", "answers", "shingles").repartition("grp").sortWithinPartitions("grp").mapInArrow(released(run), "a long, b long")


def family_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """row_key, shingles of the rows whose key may be among keys; a bit table of 48 MB at most thins them in the scan."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(keys.select(F.col("row_key").alias("hash"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, memory = BitTable(table.value), WordHashes()
        for b in batches:
            at = np.flatnonzero(bits.may_hold(b.column(0).to_numpy()))
            for k in range(0, len(at), 500):
                part = b.take(pa.array(at[k : k + 500]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(x, memory).tobytes() for x in utf8(part.column(1))], pa.binary())], names=["row_key", "shingles"])

    return docs.select(row_key(F.col("doc_id").cast("long"), F.col("text")).alias("row_key"), "text").mapInArrow(released(run), "row_key long, shingles binary")


def pivot_links(members: DataFrame) -> DataFrame:
    """fam, cls, pivot, linked for members(fam, cls, shared, shingles): is the class linked with the family's pivot?"""
    pivots = members.groupBy("fam").agg(F.max_by("cls", F.struct("shared", "cls")).alias("pivot"))
    chosen = pivots.join(members.select("fam", F.col("cls").alias("pivot"), F.col("shingles").alias("other")), ["fam", "pivot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(3), b.column(4), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                ok.append(len(np.intersect1d(x, y, assume_unique=True)) >= required(len(x), len(y)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ok, pa.bool_())], names=["fam", "cls", "pivot", "shingles", "linked"])

    return members.join(chosen, "fam").select("fam", "cls", "pivot", "shingles", "other").mapInArrow(released(run), "fam long, cls long, pivot long, shingles binary, linked boolean")


def _pairs(members: DataFrame, ask_blocks, answer_blocks) -> DataFrame:
    """A copy of each asking set for every answering block and the reverse; grp numbers the pairs of blocks."""
    block = F.pmod(F.xxhash64("cls"), answer_blocks)
    own = F.pmod(F.xxhash64("cls", F.lit(1)), ask_blocks)
    asking = members.where("asks").select("fam", "cls", "shingles", own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), answer_blocks - 1)).alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("answers"))
    answering = members.select("fam", "cls", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), ask_blocks - 1)).alias("i"), block.alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    return asking.unionByName(answering).withColumn("grp", F.xxhash64("fam", "i", "j"))


def family_search(docs: DataFrame, members: DataFrame, limit: int = GROUP_SHINGLES) -> DataFrame:
    """a, b: links between the classes of members(fam, cls, n, shared, row_key) of families, exact and whole."""
    size = members.groupBy("fam").agg(F.sum("n").alias("mass"), F.count(F.lit(1)).alias("k")).where("k > 1")
    wanted = members.join(size, "fam").select("fam", "cls", "shared", "row_key", "mass")
    small, big = wanted.where(F.col("mass") <= limit // 2), wanted.where(F.col("mass") > limit // 2)
    sets = family_sets(docs, wanted)
    links = search(small.join(sets, "row_key").select(F.col("fam").alias("grp"), "cls", F.lit(True).alias("asks"), F.lit(True).alias("answers"), "shingles"))
    if big.isEmpty():
        return links
    held = stored(pivot_links(big.join(family_sets(docs, big), "row_key").select("fam", "cls", "shared", "shingles").dropDuplicates(["fam", "cls"])), "families")
    shape = held.groupBy("fam").agg(F.sum(F.octet_length("shingles")).alias("all"), F.sum(F.when(~F.col("linked"), F.octet_length("shingles")).otherwise(0)).alias("rest"))
    asking = F.greatest(F.lit(2 * limit), F.least(F.lit(4 * limit), F.col("all") / 8))  # bytes of a block of asking sets; answering ones have 8 * limit
    rest = held.join(shape, "fam").withColumn("asks", ~F.col("linked")).where("rest > 0").withColumn("ib", F.ceil(F.col("rest") / asking)).withColumn("jb", F.ceil(F.col("all") / (8 * limit)))
    blocks = _pairs(rest.select("fam", "cls", "shingles", "asks", "ib", "jb"), F.col("ib"), F.col("jb"))
    return links.union(held.where("linked AND cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b"))).union(search(blocks))


def long_list_edges(through: DataFrame, deep: DataFrame) -> DataFrame:
    """a, b: edges that join the deep sets of a long list, within and across batches.

    through(a, b, c): b stands in a list with its least set a, of a batch (c = 0) or of all batches (c = 1). The least sets
    needn't be deep, so names of their own stand for them, which no set has.
    """
    through = through.select("a", "b", "c").distinct()
    name = lambda node, c: F.xxhash64(node, F.lit("head"), c)
    heads = through.select(F.col("a").alias("node"), F.col("c").cast("int").alias("c")).distinct()
    joined = through.select(name(F.col("a"), F.col("c").cast("int")).alias("a"), F.col("b").alias("node"), "c")
    batch = heads.where("c = 0").select("node", name(F.col("node"), F.lit(0)).alias("b"))
    own = heads.join(deep, "node").select(name(F.col("node"), F.col("c")).alias("a"), F.col("node").alias("b"))
    up = heads.where("c = 1").join(batch, "node").select(name(F.col("node"), F.lit(1)).alias("a"), "b")
    return joined.join(deep, "node").select("a", F.col("node").alias("b")).union(joined.where("c = 1").join(batch, "node").select("a", "b")).union(own).union(up)


def similar_components(docs: DataFrame, *, part_bytes: int = PART_BYTES, limit: int = GROUP_SHINGLES, long: int = LONG) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id for every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // part_bytes))
    table = stored(listed(postings(docs, parts, long).repartitionById(parts, F.col("part")), long), "lists")
    rows, lists, through = table.where("row_key IS NOT NULL").select("doc_id", "row_key", "n", "node", "parity"), table.where("list IS NOT NULL").select("list", "node", "n"), table.where("a IS NOT NULL").select("a", "b", "c")
    sizes = rows.groupBy("node").agg(F.first("n").alias("n"), F.min("row_key").alias("row_key"), F.first("parity").alias("parity"))
    least = F.floor(F.floor((F.col("n") * PERCENT + 99) / 100) / SPARE) + 1
    inside = through.where("a = b").select(F.col("b").alias("node"), F.col("c").alias("deep"))
    shared = lists.select("node", F.lit(1).alias("k"), F.lit(0).alias("deep")).union(inside.select("node", "deep", "deep")).groupBy("node").agg(F.sum("k").alias("shared"), F.sum("deep").alias("deep"))
    alive = stored(shared.join(sizes, "node").where(F.col("shared") >= least).withColumn("deep", F.col("deep") >= least), "alive", files=parts)
    found = candidate_pairs(lists, bit_table(alive.select(F.col("node").alias("hash"))), max(8, -(-size // PAIR_BYTES))).distinct()
    near = likely_pairs(found, alive.select("node", "parity"))

    star = long_list_edges(through.where("a <> b"), alive.where("deep").select("node"))
    fams = connected_components(near.union(star), files=parts)
    members = fams.join(alive, "node").select(F.col("root").alias("fam"), F.col("node").alias("cls"), "n", "shared", "row_key")
    comps = connected_components(family_search(docs, stored(members, "members", files=parts), limit), files=parts)

    named = rows.drop("parity").join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    ids = named.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return named.join(ids, "comp", "left").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component, with all their columns.

    The first has the component's smallest id. Wordless rows stay, so do rows that repeat the first one, and all rows of a
    component without any id; rows without an id go where another has one.
    """
    found = similar_components(docs)
    drop = found.where("n_shingles > 0 AND component_id IS NOT NULL AND (doc_id IS NULL OR doc_id <> component_id)").select(F.col("row_key").alias("_drop")).distinct()
    return docs.join(drop, row_key(docs["doc_id"].cast("long"), docs["text"]) == drop["_drop"], "left_anti")
