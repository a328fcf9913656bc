"""SimHash near-duplicate groups, by an exact search over parts of the fingerprints.

The parts: if the bits are split into disjoint parts, each with a reach, and the
reaches plus one each add up to the radius plus one, then two fingerprints
within the radius differ by no more than the reach in one part at least. So the
pairs whose parts are within reach of each other hold all that are near; these
are compared as dense tiles, and nothing is left out.

Tables of twin references (:func:`cells`, :func:`cell_edges`) find most pairs
only; no query uses them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.components import components
from quillstone.llm.frames import materialise, pick
from quillstone.llm.textkit import NON_WORD, blocks, buffers, expand, mix, runs, slices, tidy, word_hashes, words

BITS = 256
_LANES = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


@dataclass(frozen=True)
class Config:
    """radius: most bits, of 256, by which near duplicates differ.

    Cells: references come in twins that differ in one bit, so that the nearer
    twin of each of ``key_bits`` pairs (their distances differ by one) makes a
    key; two fingerprints at distance d share a key with the probability that
    none of key_bits different bits is among the d. key_bits is the logarithm of
    the number of fingerprints less ``crowd``, ``least_bits`` at least, so that
    cells hold 2**crowd unrelated fingerprints on average at most, at any size;
    there are as many tables of keys as give pairs at distance ``design`` the
    recall ``recall`` and pairs at the radius itself ``least_recall``; nearer
    pairs have more.
    coordinates: pairs whose distances to any of so many random references
    differ by more than the radius are discarded; by the triangle inequality
    that loses none.
    dense: cells with more members are searched from member to member instead
    of pair by pair; what is connected is the same.
    block: fingerprints that are compared with as many others in one task.
    tasks: parts are searched in tasks of their own while there are fewer.

    The exact search takes ``radius``, ``block`` and ``tasks``; the other fields
    are those of the twin references.
    """

    radius: int = 44
    least_bits: int = 18
    design: int = 33
    recall: float = 0.97
    least_recall: float = 0.9
    coordinates: int = 64
    crowd: int = 6
    dense: int = 512
    seed: int = 11
    block: int = 1 << 20
    tasks: int = 48

    def layout(self, n: int) -> tuple[int, int]:
        """key_bits and tables for n fingerprints."""
        bits = max(self.least_bits, math.ceil(math.log2(max(n, 1))) - self.crowd)
        return bits, max(math.ceil(math.log(1 - recall) / math.log(1 - math.comb(BITS - at, bits) / math.comb(BITS, bits))) for at, recall in ((self.design, self.recall), (self.radius, self.least_recall)))


@lru_cache(maxsize=4)
def pivot_set(config: Config) -> np.ndarray:
    """The references of the coordinate table, as rows of +-1."""
    return np.random.default_rng(config.seed).integers(0, 2, (config.coordinates, BITS)).astype(np.float32) * 2 - 1


@lru_cache(maxsize=4)
def twin_bits(config: Config, layout: tuple[int, int]) -> np.ndarray:
    """(tables, key_bits): the bit in which each pair of twins differs."""
    rng = np.random.default_rng(config.seed + 1)
    return np.array([rng.choice(BITS, layout[0], replace=False) for _ in range(layout[1])])


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 32) fingerprint bytes and distinct words of each text.

    Bit b is the majority, over the distinct lower-case words, of bit b of the
    words' 256-bit hashes; ties give 0.
    """
    n = len(texts)
    out, size = np.zeros((n, BITS // 8), np.uint8), np.zeros(n, np.int64)
    for a, some in slices(texts, 1_000_000):
        b = a + len(some)
        part, at = buffers(pc.utf8_lower(some))
        starts, ends, row = words(part, at, NON_WORD)
        if not len(starts):
            continue
        h = word_hashes(part, starts, ends)
        pick = np.unique(mix(h + (row + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        pick.sort()
        h, row = h[pick], row[pick]
        ones = np.zeros((b - a, BITS), np.int32)
        for s in range(0, len(h), 32768):
            lanes = mix(h[s : s + 32768, None] ^ _LANES).view(np.uint8).reshape(-1, BITS // 8)
            first, _ = runs(row[s : s + 32768])
            ones[row[s + first]] += np.add.reduceat(np.unpackbits(lanes, axis=1), first, axis=0, dtype=np.int32)
        size[a:b] = np.bincount(row, minlength=b - a)
        out[a:b] = np.packbits(ones * 2 > size[a:b, None], axis=1)
    return out, size


def _signs(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps, axis=1).astype(np.float32) * 2 - 1


def cells(fps: np.ndarray, config: Config, layout: tuple[int, int]) -> np.ndarray:
    """(n, tables) keys: which twin is nearer, for the pairs of each table."""
    bits = np.ascontiguousarray(np.unpackbits(fps, axis=1).T).astype(np.uint64)
    out = np.empty((layout[1], len(fps)), np.uint64)
    for t, chosen in enumerate(twin_bits(config, layout)):
        key = np.full(len(fps), t, np.uint64)
        for c in chosen:
            key = key * np.uint64(2) + bits[c]
        out[t] = key
    return mix(np.ascontiguousarray(out.T)).view(np.int64)


def coordinates(fps: np.ndarray, config: Config) -> np.ndarray:
    """The pivot distance table: Hamming distances to the first pivots."""
    return ((BITS - _signs(fps) @ pivot_set(config).T) / 2).astype(np.int16)


def hamming(fps: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    x = fps.view(np.uint64)
    return np.bitwise_count(x[a] ^ x[b]).sum(axis=-1, dtype=np.int64)


def surviving(fps: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray, config: Config) -> np.ndarray:
    """Which pairs are near: pivot filter first, then the whole distance."""
    out = np.zeros(len(a), bool)
    for s in range(0, len(a), 65536):
        x, y = a[s : s + 65536], b[s : s + 65536]
        left = np.arange(len(x))
        for c in range(0, config.coordinates, 16):  # in slices, so that most pairs fail early
            left = left[(np.abs(table[x[left], c : c + 16] - table[y[left], c : c + 16])).max(axis=1) <= config.radius]
        out[s + left[hamming(fps, x[left], y[left]) <= config.radius]] = True
    return out


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the given ones connect, one for each node but the least of its component."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        before = least.copy()
        np.minimum.at(least, x, least[y])
        np.minimum.at(least, y, least[x])
        least = least[least]
        if np.array_equal(before, least):
            break
    rest = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[rest], nodes[least[rest]]


def cell_edges(keys: np.ndarray, fps: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that join the near members of each cell, as few as do; keys are sorted."""
    starts, sizes = runs(keys)
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        e = np.zeros(0, np.int64)
        return e, e
    rows = expand(starts, sizes)  # members of cells that hold several
    # the pivot distance table: a fingerprint comes in many cells of a block, its distances are worked out once
    pick, back = np.unique(np.ascontiguousarray(fps[rows]).view(np.dtype((np.void, BITS // 8))).ravel(), return_inverse=True)
    own = pick.view(np.uint8).reshape(-1, BITS // 8)
    far = np.zeros((len(own), config.coordinates), np.int16)
    for s in range(0, len(own), 4096):
        far[s : s + 4096] = coordinates(own[s : s + 4096], config)
    table = np.zeros((len(fps), config.coordinates), np.int16)
    table[rows] = far[back]
    left, right = [], []
    few = sizes <= config.dense
    fs, fn = starts[few], sizes[few]
    for c, d in blocks(np.r_[0, np.cumsum(fn * fn)], 1_000_000):  # so many pairs at a time
        ps, pn = fs[c:d], fn[c:d]
        a = np.repeat(expand(ps, pn), np.repeat(pn, pn))
        b = expand(np.repeat(ps, pn), np.repeat(pn, pn))
        half = a < b
        a, b = a[half], b[half]
        ok = surviving(fps, a, b, table, config)
        x, y = spanning(a[ok], b[ok])
        left.append(x)
        right.append(y)
    for s, n in zip(starts[~few], sizes[~few], strict=True):
        open_ = np.arange(s, s + n)
        while len(open_):
            queue, open_ = [open_[0]], open_[1:]
            while queue and len(open_):
                x = queue.pop()
                ok = surviving(fps, np.full(len(open_), x), open_, table, config)
                hit = open_[ok]
                left.append(np.full(len(hit), x))
                right.append(hit)
                queue.extend(hit.tolist())
                open_ = open_[~ok]
    return np.concatenate(left), np.concatenate(right)


#: Pairs that are compared at a time, and fingerprint pairs that one more tile costs as much as.
_TILE, _CALL = 32768, 8000


@lru_cache(maxsize=8)
def parts(radius: int, n: int) -> list[tuple[np.ndarray, int]]:
    """(bits, reach) of each part, for comparing about ``n`` fingerprints with each other.

    The reaches plus one add up to radius + 1. Of the numbers of parts the one is
    taken that costs least where bits are even: many short parts let more pairs
    through, few long ones make more and smaller tiles.
    """
    best, least = None, math.inf
    order = np.random.default_rng(5).permutation(BITS)
    for m in range(1, min(radius + 1, 64) + 1):
        reach = [(radius + 1 + i) // m - 1 for i in range(m)]
        length = [1] * m
        share = lambda i: sum(math.comb(length[i], k) for k in range(reach[i] + 1)) / 2 ** length[i]  # noqa: B023, E731
        now = [share(i) for i in range(m)]
        for _ in range(BITS - m):
            i = max((i for i in range(m) if length[i] < 20 and reach[i] < 20), key=now.__getitem__, default=None)
            if i is None:
                break
            length[i] += 1
            now[i] = share(i)
        cost = sum(min(2**x, n) * _CALL + n * n * y / 2 + (n + 2**x) * y * min(2**x, n) for x, y in zip(length, now, strict=True))
        if cost < least:
            least, best = cost, list(zip(np.split(order, np.cumsum(length))[:m], reach, strict=True))
    return best


class Part:
    """Fingerprints in the order of one part's value; ``at`` has where each value begins."""

    def __init__(self, fps: np.ndarray, bits: np.ndarray):
        value = np.zeros(len(fps), np.int32)
        for b in bits.tolist():
            value = value << 1 | fps[:, b >> 3] >> (7 - (b & 7)) & 1
        self.order = np.argsort(value, kind="stable")
        self.lanes = np.ascontiguousarray(fps.view(np.uint64)[self.order].T)
        self.at = np.r_[0, np.cumsum(np.bincount(value, minlength=1 << len(bits)))]


@lru_cache(maxsize=1)
def _room() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays for one tile, which every tile uses again."""
    return np.empty(_TILE, np.uint64), np.empty(_TILE, np.uint8), np.empty(_TILE, np.uint8)


def _walk(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of columns of x and y (lanes, fingerprints) that connect what pairs within the radius connect.

    Each column's neighbours are looked for among those not reached yet only.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    side, rest = (x, y), [np.arange(x.shape[1]), np.arange(y.shape[1])]
    queue: list[tuple[int, int]] = []
    while len(rest[1]) and (queue or len(rest[0])):
        if not queue:
            queue.append((0, int(rest[0][0])))
            rest[0] = rest[0][1:]
        k, a = queue.pop()
        there = rest[1 - k]
        near = np.bitwise_count(side[k][:, a, None] ^ side[1 - k][:, there]).sum(axis=0, dtype=np.int64) <= radius
        hit, rest[1 - k] = there[near], there[~near]
        left.append(np.full(len(hit), a) if k == 0 else hit)
        right.append(hit if k == 0 else np.full(len(hit), a))
        queue += [(1 - k, b) for b in hit.tolist()]
    return np.concatenate(left), np.concatenate(right)


def near_edges(x: np.ndarray, y: np.ndarray | None, chosen: list[tuple[np.ndarray, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect what pairs within the radius, and within reach in one of the chosen parts, connect.

    Rows of ``x`` with rows of ``y``, which count on from those of ``x``; without ``y``, rows of ``x`` with each other.
    """
    none = np.zeros(0, np.int64)
    left, right = [none], [none]
    differ, near, more = _room()
    for bits, reach in chosen:
        here = Part(x, bits)
        there = here if y is None else Part(y, bits)
        shift = 0 if y is None else len(x)
        flips = np.arange(1 << len(bits), dtype=np.int64)
        flips = flips[np.bitwise_count(flips) <= reach]
        some: list[tuple[np.ndarray, np.ndarray]] = []  # pairs that differ little in half of their bits
        held = 0

        def settle() -> None:
            """Those of ``some`` that are near, as rows, as few as connect the same."""
            i, j = (np.concatenate(k) for k in zip(*some, strict=True))
            some.clear()
            apart = sum(np.bitwise_count(u[i] ^ v[j]).astype(np.int16) for u, v in zip(here.lanes, there.lanes, strict=True))  # noqa: B023
            a, b = here.order[i[apart <= radius]], there.order[j[apart <= radius]] + shift  # noqa: B023
            other = a != b
            a, b = spanning(np.r_[left.pop(), a[other]], np.r_[right.pop(), b[other]])
            left.append(a)
            right.append(b)

        for v in np.flatnonzero(np.diff(here.at)).tolist():
            w = flips ^ v
            if y is None:
                w = w[w >= v]  # each pair of values once
            first = there.at[w]
            every = expand(first, there.at[w + 1] - first)
            s, e = int(here.at[v]), int(here.at[v + 1])
            for c in range(0, len(every), _TILE):
                who = every[c : c + _TILE]
                low, high = there.lanes[0][who], there.lanes[1][who]
                step = _TILE // len(who)
                for r in range(s, e, step):
                    own = r - s if y is None and not c else 0  # the value's own rows come first, those before r had their turn
                    n, m = min(step, e - r), len(who) - own
                    if m <= 0:
                        continue
                    size = n * m
                    np.bitwise_xor(here.lanes[0, r : r + n, None], low[own:], out=differ[:size].reshape(n, m))
                    np.bitwise_count(differ[:size], out=near[:size])
                    np.bitwise_xor(here.lanes[1, r : r + n, None], high[own:], out=differ[:size].reshape(n, m))
                    np.bitwise_count(differ[:size], out=more[:size])
                    np.add(near[:size], more[:size], out=near[:size])
                    hit = np.flatnonzero(near[:size] <= radius)
                    if not len(hit):
                        continue
                    if len(hit) > size // 8 + 8 * (n + m):  # most are near: from neighbour to neighbour instead
                        i, j = _walk(here.lanes[:, r:e], there.lanes[:, who[own:]], radius)
                        some.append((i + r, who[own + j]))
                        held += len(i)
                        break
                    some.append((hit // m + r, who[own + hit % m]))
                    held += len(hit)
            if held > 500_000:
                settle()
                held = 0
        if some:
            settle()
    return left[0], right[0]


def node_keys(fps: np.ndarray) -> np.ndarray:
    """(n, 16) bytes that stand for each fingerprint as a node."""
    lanes = np.ascontiguousarray(fps).view(np.uint64)
    out = np.empty((len(fps), 2), np.uint64)
    for k in (0, 1):
        h = np.full(len(fps), _LANES[k])
        for c in range(lanes.shape[1]):
            h = mix(h + lanes[:, c] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
        out[:, k] = h
    return out.view(np.uint8)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:
    """Members of near-duplicate groups: (id, text_key, copies, group_id, group_size, kept).

    Near are texts whose 256-bit SimHash fingerprints differ in at most
    ``radius`` bits; a group is a connected component of that relation. A member
    is a document: an id and a text, told apart by text_key (xxhash64 of the
    text); copies is the number of its rows, which repeat both. group_size
    counts rows. group_id is the group's least id; kept marks one document of
    each group, that of the least id (null ids last), then of the least
    text_key. Every document is a query. Documents in one row that are near to
    no other have no row here.

    Plan: fingerprints (map only); equal fingerprints become one node; nodes are
    dealt into blocks by hash, and each pair of blocks is a group of rows that
    one task, or one for some of the parts, compares (:func:`near_edges`). No
    pair within the radius is left out. Only fingerprints are exchanged, each as
    often as there are blocks and tasks for a pair of them, not texts. The pairs that connect a task's nodes
    are written once, before components are searched.

    Null or empty texts, and those without a letter or digit, are near to
    nothing, even where they repeat. Null ids are ids like others; different
    texts under one id are different documents. Very long texts are
    fingerprinted in whole. An empty table has no groups. Other columns are
    ignored, whatever their names.
    """
    id_type = docs.schema[id_col].dataType
    printed = T.StructType([T.StructField("id", id_type), T.StructField("key", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("fp", T.BinaryType())])
    spread = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("high", T.BooleanType()), T.StructField("fp", T.BinaryType())])
    pairs = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType())])

    def fixed(rows: np.ndarray) -> pa.Array:
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())

    def fp_matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.ascontiguousarray(buffers(col)[0]).reshape(-1, BITS // 8)

    def take_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, size = fingerprints(batch.column(2))
            some = np.flatnonzero(size)
            fps = fps[some]
            yield pa.record_batch([batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), fixed(node_keys(fps)), fixed(fps)], printed.names)

    def spread_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fp_matrix(batch.column("fp"))
            own = (node_keys(fps).view(np.uint64)[:, 0] % np.uint64(n_blocks)).astype(np.int64)
            for other in range(n_blocks):
                low, high = np.minimum(own, other), np.maximum(own, other)
                for share in range(n_shares):
                    group = (high * (high + 1) // 2 + low) * n_shares + share
                    yield pa.record_batch([pa.array(group, pa.int32()), pa.array(own > other), batch.column("fp")], spread.names)

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        for batch in batches:  # a partition is one group
            if batch.num_rows:
                held.append((batch.column("group")[0].as_py(), np.asarray(batch.column("high")), fp_matrix(batch.column("fp"))))
        if not held:
            return
        group = held[0][0]
        high = np.concatenate([h for _, h, _ in held])
        fps = np.concatenate([f for _, _, f in held])
        held.clear()
        pair = group // n_shares
        row = (math.isqrt(8 * pair + 1) - 1) // 2
        if row == pair - row * (row + 1) // 2:  # a block with itself
            a, b = near_edges(fps, None, chosen[group % n_shares :: n_shares], config.radius)
        else:
            fps = np.ascontiguousarray(fps[np.argsort(high, kind="stable")])
            n = len(high) - int(high.sum())
            a, b = near_edges(fps[:n], fps[n:], chosen[group % n_shares :: n_shares], config.radius)
        for s in range(0, len(a), 50_000):
            x, y = fixed(node_keys(fps[a[s : s + 50_000]])), fixed(node_keys(fps[b[s : s + 50_000]]))
            swap = pc.less(x, y)
            yield pa.record_batch([pc.if_else(swap, y, x), pc.if_else(swap, x, y)], pairs.names)

    prints = pick(docs, id_col, text_col).toDF("id", "text").select("id", F.xxhash64("text").alias("key"), "text").mapInArrow(tidy(take_prints), printed)
    prints = materialise(prints, "prints")
    rows = prints.count()
    n_blocks = max(1, -(-rows // config.block))
    chosen = parts(config.radius, min(rows, config.block))
    n_groups = n_blocks * (n_blocks + 1) // 2
    n_shares = min(len(chosen), -(-config.tasks // n_groups))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    nodes = prints.groupBy("node").agg(F.any_value("fp").alias("fp"), F.count("*").alias("n"), F.min(place).alias("least"))
    dealt = nodes.select("fp").mapInArrow(tidy(spread_blocks), spread).repartitionById(n_groups * n_shares, F.col("group"))
    edges = dealt.mapInArrow(tidy(join_blocks), pairs).distinct()
    stars = components(materialise(edges, "pairs"))
    rooted = nodes.select("node", "n", "least").join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.groupBy("root").agg(F.sum("n").alias("group_size"), F.min("least").alias("first")).filter("group_size > 1")
    members = prints.groupBy("node", "id", "key").agg(F.count("*").alias("copies"))
    out = members.join(rooted.select("node", "root").join(groups, "root"), "node")
    return out.select(F.col("id").alias(id_col), F.col("key").alias("text_key"), "copies", F.col("first.id").alias("group_id"), "group_size", F.col("first").eqNullSafe(place).alias("kept"))
