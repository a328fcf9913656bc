"""Arrow and numpy kernels: text columns as byte buffers, words, rolling hashes.

All hashes are polynomials modulo 2**64 over per-byte (or per-word) random
64-bit codes, finished with a mixing step, so that they depend on content only
and are the same on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: ASCII white space separates words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Everything in ASCII but letters and digits separates words.
NON_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


_settled = False


def _settle() -> object:
    """The C library, told once a process to take large arrays from the system and give each back when it is freed."""
    global _settled
    lib = ctypes.CDLL(None)
    if not _settled and hasattr(lib, "mallopt"):
        lib.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD: fixed, or it grows and large arrays fill the heap with holes
        _settled = True
    return lib


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which at its end gives freed memory back: workers outlive their tasks."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = _settle()
        try:
            yield from run(batches)
        finally:
            for k in (0, 1):
                _powers[k] = _powers[k][: 1 << 16].copy()
            pa.default_memory_pool().release_unused()
            trim = getattr(lib, "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, U)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _powers[k] = a
    return _powers[0], _powers[1]


def prefix(codes: np.ndarray) -> np.ndarray:
    """P with P[i] the hash sum of codes[:i]."""
    out = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * powers(len(codes))[0][: len(codes)], out=out[1:])
    return out


def spans_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end], from the prefix sums of :func:`prefix`."""
    return mix((p[ends] - p[starts]) * powers(len(p))[1][starts] + (ends - starts).astype(U))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, offsets); nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    parts = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(parts[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row makes a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(col: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of a string column in parts of ``most`` bytes, as :func:`blocks`; nothing is copied."""
    if not len(col):
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    for a, b in blocks(off, most):
        yield a, col.slice(a, b - a)


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of bytes that ``sep`` doesn't hold."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~sep[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True  # a word never crosses rows
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans_hash(prefix(BYTE_CODES[data]), starts, ends)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """m[i] = min(x[i:i+width]), for the len(x)-width+1 whole windows."""
    if len(x) < width:
        return x[:0]
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return m


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... count of them, for each pair, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by ``key`` into tables that hold whole groups.

    Each table has about ``most`` bytes; a larger single group stays in one.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in (b for whole in batches for b in _parts(whole, most)):
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        t = pa.Table.from_batches(held)
        keys = t[key]
        last = keys[-1].as_py()
        k = t.num_rows - 1
        while k > 0:  # doubling steps back to the beginning of the last group
            step = max(0, k - 4096)
            same = np.asarray(pc.equal(keys.slice(step, k - step), pa.scalar(last, keys.type)).combine_chunks())
            if not same.all():
                k = step + int(np.flatnonzero(~same)[-1]) + 1
                break
            k = step
        if k > 0:
            yield t.slice(0, k)
            held = t.slice(k).to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes."""
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal neighbours."""
    if not len(keys):
        e = np.zeros(0, np.int64)
        return e, e
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])
