"""MPEG transport streams: tables, continuity, elementary packets, timestamps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillstone.llm.frames import pick

PACKET = 188
_SYNC = 0x47


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


def crc32(data: bytes) -> int:
    """CRC of table sections (polynomial 0x04C11DB7, not reflected)."""
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _next_packet(data: np.ndarray, a: int, b: int) -> int:
    """Where packets go on: of the offsets from a before b, or else of a packet's length after them, the first with the most sync bytes a packet apart.

    Two at least, five count; the end of the data is as good as a sync byte.
    Headers with neither adaptation field nor payload, as a run of sync bytes
    would have, are none.
    """
    n = len(data)
    while a + PACKET <= n:
        at = np.arange(a, min(b, n - PACKET + 1))
        alive, count = np.ones(len(at), bool), np.zeros(len(at), np.int64)
        for j in range(5):
            q = at + j * PACKET
            sync = (data[np.minimum(q, n - 1)] == _SYNC) & ((q + 3 >= n) | (data[np.minimum(q + 3, n - 1)] & 0x30 > 0))
            alive &= np.where(q < n, sync, q == n)
            count += alive
        if len(at) and count.max() > 1:
            return int(at[count.argmax()])
        a, b = b, b + PACKET
    return -1


def _packets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The offset of each packet, and whether it may hold bytes that are none of its own.

    Where a sync byte fails, or the header as above, packets go on from the next that are found; that
    may be inside the last packet, which then lost bytes and is left out. If it
    is behind, at another distance than whole packets, bytes were inserted
    before or inside the last packet's end, so that it is in doubt.
    """
    parts, doubt = [], []
    at = _next_packet(data, 0, PACKET)
    while at >= 0:
        whole = (len(data) - at) // PACKET
        n, step = 0, 64
        while n < whole:  # in growing pieces, so that many losses cost no more than one
            part = data[at + n * PACKET : at + min(n + step, whole) * PACKET].reshape(-1, PACKET)
            ok = (part[:, 0] == _SYNC) & (part[:, 3] & 0x30 > 0)
            if not ok.all():
                n += int(ok.argmin())
                break
            n, step = n + len(ok), step * 2
        stop = at + n * PACKET
        follows = -1
        if len(data) - stop and (n < whole or data[stop] != _SYNC):
            follows = _next_packet(data, stop - PACKET + 1, stop + PACKET + 1)
        if 0 <= follows < stop:
            n -= 1
        parts.append(at + PACKET * np.arange(n))
        doubt.append(np.zeros(n, bool))
        if follows > stop and (follows - stop) % PACKET and n:
            doubt[-1][-1] = True
        at = follows
    return (np.concatenate(parts), np.concatenate(doubt)) if parts else (np.zeros(0, np.int64), np.zeros(0, bool))


def _sections(payloads: list[tuple[bool, bool, bytes]]) -> Iterator[bytes]:
    """Whole sections with a good CRC, from a PID's payloads (unit start, whether packets are missing before, bytes)."""
    held = b""
    for start, gap, body in payloads:
        if gap:
            held = b""
        if start:
            skip = body[0] if body else 0
            held += body[1 : 1 + skip]
            yield from _whole(held)
            held = body[1 + skip :]
        elif held:
            held += body
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) < size:
                break
            if crc32(held[:size]) == 0:
                yield held[:size]
            held = held[size:]
        if held[:1] == b"\xff":
            held = b""


def _whole(held: bytes) -> Iterator[bytes]:
    if len(held) >= 3 and held[0] != 0xFF:
        size = 3 + ((held[1] & 0x0F) << 8 | held[2])
        if len(held) == size and crc32(held) == 0:
            yield held


def parse(data: bytes) -> tuple[list[dict], int]:
    """The elementary streams of a transport stream, and bytes that fit no packet.

    Each: program, pid, stream_type, packets, duplicates, continuity_errors,
    units (pts, dts, packet, random_access, size, damaged) and payload.
    """
    raw = np.frombuffer(data, np.uint8)
    begin, doubt = _packets(raw)
    n = len(begin)
    if not n:
        return [], len(raw)
    p = raw[begin[0] : begin[0] + n * PACKET].reshape(n, PACKET) if begin[-1] - begin[0] == (n - 1) * PACKET else raw[begin[:, None] + np.arange(PACKET)]
    lost = len(raw) - n * PACKET
    good = p[:, 1] & 0x80 == 0
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    unit = p[:, 1] & 0x40 > 0
    has_field, has_body = p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0
    counter = (p[:, 3] & 0x0F).astype(np.int32)
    field_size = np.where(has_field, p[:, 4].astype(np.int32) + 1, 0)
    body_at = np.minimum(4 + field_size, PACKET)
    flags = np.where(has_field & (field_size > 1), p[:, 5], 0)
    jump, entry = flags & 0x80 > 0, flags & 0x40 > 0
    blob = p.tobytes()

    def steps(full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one PID's packets with a payload: which are sent again (same counter, same bytes), and which don't follow the one before."""
        again, wrong = np.zeros(len(full), bool), np.zeros(len(full), bool)
        if len(full) > 1:
            step = (counter[full[1:]] - counter[full[:-1]]) & 15
            same = step == 0
            same[same] = (p[full[1:][same], 4:] == p[full[:-1][same], 4:]).all(axis=1)
            same[1:] &= ~same[:-1]  # twice, not three times
            again[1:] = same
            wrong[1:] = ~same & (step != 1) & ~jump[full[1:]]
        return again, wrong

    def bodies(which: np.ndarray) -> list[tuple[bool, bool, bytes]]:
        full = which[has_body[which]]
        again, wrong = steps(full)
        return [(bool(unit[i]), bool(wrong[k]), blob[i * PACKET + int(body_at[i]) : (i + 1) * PACKET]) for k, i in enumerate(full) if not again[k]]

    programs: dict[int, int] = {}
    for s in _sections(bodies(np.flatnonzero(good & (pid == 0)))):
        if s[0] == 0 and s[5] & 1:
            for k in range(8, len(s) - 4, 4):
                number = s[k] << 8 | s[k + 1]
                if number:
                    programs[number] = (s[k + 2] & 0x1F) << 8 | s[k + 3]
    streams: dict[tuple[int, int], int] = {}
    for number, table_pid in sorted(programs.items()):
        for s in _sections(bodies(np.flatnonzero(good & (pid == table_pid)))):
            if s[0] == 2 and s[5] & 1 and (s[3] << 8 | s[4]) == number:
                k = 12 + ((s[10] & 0x0F) << 8 | s[11])
                while k + 5 <= len(s) - 4:
                    streams[number, (s[k + 1] & 0x1F) << 8 | s[k + 2]] = s[k]
                    k += 5 + ((s[k + 3] & 0x0F) << 8 | s[k + 4])
    out = []
    for (number, es), kind in sorted(streams.items()):
        mine = np.flatnonzero(good & (pid == es))
        full = mine[has_body[mine]]
        again, wrong = steps(full)
        use = full[~again]
        gap = wrong[~again]
        first = np.flatnonzero(unit[use])
        units, payload = [], []
        for a, b in zip(first, np.r_[first[1:], len(use)][: len(first)], strict=True):
            body = b"".join(blob[i * PACKET + int(body_at[i]) : (i + 1) * PACKET] for i in use[a:b])
            damaged = bool(gap[a + 1 : b].any() or doubt[use[a:b]].any())
            if body[:3] != b"\0\0\1" or len(body) < 9:
                units.append((None, None, int(use[a]), bool(entry[use[a]]), 0, True))
                continue
            size, stamps, head = body[4] << 8 | body[5], body[7] >> 6, 9 + body[8]
            pts = _stamp(body[9:14]) if stamps & 2 and len(body) >= 14 else None
            dts = _stamp(body[14:19]) if stamps == 3 and len(body) >= 19 else pts
            content = body[head : 6 + size] if size else body[head:]
            damaged |= len(body) < 6 + size if size else b < len(use) and bool(gap[b])  # without a size, the end may be what is missing
            units.append((pts, dts, int(use[a]), bool(entry[use[a]]), len(content), damaged))
            payload.append(content)
        out.append({"program": number, "pid": es, "stream_type": kind, "packets": len(mine), "duplicates": int(again.sum()), "continuity_errors": int(wrong.sum()), "units": units, "payload": b"".join(payload)})
    return out, lost


def transport_streams(media: DataFrame, id_col: str, data_col: str, payload: bool = False) -> DataFrame:
    """One row for each elementary stream of each row's transport stream; map only.

    Returns (id, program, pid, stream_type, packets, duplicates,
    continuity_errors, units ARRAY<STRUCT<pts, dts, packet, random_access,
    size, damaged>>, random_access_points ARRAY<STRUCT<packet, pts>>,
    payload_size, payload_hash, lost_bytes[, payload]). Timestamps are in ticks
    of 90 kHz; packet counts the packets found, from 0. Where bytes were lost
    or inserted, packets go on at the next sync bytes; lost_bytes counts all
    that are in no packet. A unit is damaged where packets of it are missing or
    one may hold inserted bytes. dts is pts where the packet has only that.

    Null or empty bytes, and bytes without packets or program tables, have no
    streams and no rows; nor has an empty table. Repeated rows: rows for each,
    in no order, so there are no ties. Null ids stay null. A row's bytes, of
    any length, are parsed in whole by one task. Tables with a wrong CRC, or
    with a packet missing, are passed over; table packets that are sent twice
    count once. Other columns are ignored, whatever their names.
    """
    unit = T.StructType([T.StructField("pts", T.LongType()), T.StructField("dts", T.LongType()), T.StructField("packet", T.LongType()), T.StructField("random_access", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("damaged", T.BooleanType())])
    point = T.StructType([T.StructField("packet", T.LongType()), T.StructField("pts", T.LongType())])
    fields = [T.StructField(id_col, media.schema[id_col].dataType)] + [T.StructField(c, T.IntegerType()) for c in ("program", "pid", "stream_type", "packets", "duplicates", "continuity_errors")]
    fields += [T.StructField("units", T.ArrayType(unit)), T.StructField("random_access_points", T.ArrayType(point)), T.StructField("payload_size", T.LongType()), T.StructField("payload_hash", T.StringType()), T.StructField("lost_bytes", T.LongType())]
    schema = T.StructType(fields + [T.StructField("payload", T.BinaryType())] * payload)
    unit_t = pa.struct([("pts", pa.int64()), ("dts", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_()), ("size", pa.int64()), ("damaged", pa.bool_())])
    point_t = pa.struct([("packet", pa.int64()), ("pts", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, who, lost_of = [], [], []
                for r, x in enumerate(part.column(1)):
                    if not x.is_valid:
                        continue
                    found, lost = parse(x.as_py())
                    rows += found
                    who += [r] * len(found)
                    lost_of += [lost] * len(found)
                if not rows:
                    continue
                flat = [u for s in rows for u in s["units"]]
                off = pa.array(np.r_[0, np.cumsum([len(s["units"]) for s in rows])], pa.int32())
                cols = list(zip(*flat, strict=True)) if flat else [[]] * 6
                entry = [[(u[2], u[0]) for u in s["units"] if u[3]] for s in rows]
                arrays = [part.column(0).take(pa.array(who))] + [pa.array([s[c] for s in rows], pa.int32()) for c in ("program", "pid", "stream_type", "packets", "duplicates", "continuity_errors")]
                arrays += [
                    pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, unit_t, strict=True)], fields=list(unit_t))),
                    pa.array([[{"packet": a, "pts": b} for a, b in e] for e in entry], pa.list_(point_t)),
                    pa.array([len(s["payload"]) for s in rows], pa.int64()),
                    pa.array([xxhash.xxh3_128_hexdigest(s["payload"]) for s in rows]),
                    pa.array(lost_of, pa.int64()),
                ]
                if payload:
                    arrays.append(pa.array([s["payload"] for s in rows], pa.binary()))
                yield pa.record_batch(arrays, schema.names)

    return pick(media, id_col, data_col).mapInArrow(run, schema)


# Multiplexing: how the query makes media of a table that has none.


def _section(body: bytes) -> bytes:
    return body + crc32(body).to_bytes(4, "big")


def _write_stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


@lru_cache(maxsize=64)
def _tables(streams: tuple[tuple[int, int], ...], program: int, table_pid: int) -> tuple[bytes, bytes]:
    pat = _section(bytes([0, 0xB0, 13, 0, 1, 0xC1, 0, 0, program >> 8, program & 255, 0xE0 | table_pid >> 8, table_pid & 255]))
    items = b"".join(bytes([kind, 0xE0 | es >> 8, es & 255, 0xF0, 0]) for es, kind in streams)
    size = 9 + len(items) + 4
    head = bytes([2, 0xB0 | size >> 8, size & 255, program >> 8, program & 255, 0xC1, 0, 0, 0xE0 | streams[0][0] >> 8, streams[0][0] & 255, 0xF0, 0])
    return pat, _section(head + items)


def _table_packet(es: int, section: bytes, counter: int) -> bytes:
    body = b"\0" + section
    return bytes([_SYNC, 0x40 | es >> 8, es & 255, 0x10 | counter & 15]) + body + b"\xff" * (PACKET - 4 - len(body))


def multiplex(streams: list[tuple[int, int, list[bytes]]], program: int = 1, table_pid: int = 0x1000, tick: int = 3600, key_every: int = 4, drop: frozenset[int] = frozenset(), twice: frozenset[int] = frozenset()) -> bytes:
    """A transport stream of (pid, stream_type, access units) with PTS and DTS.

    Tables come first and before every random-access unit of the first stream.
    drop, twice: numbers of packets to leave out or send twice, for tests.
    """
    pat, pmt = _tables(tuple((es, kind) for es, kind, _ in streams), program, table_pid)
    packets: list[bytes] = []
    counter = dict.fromkeys([0, table_pid, *(s[0] for s in streams)], 0)

    def table() -> None:
        for es, s in ((0, pat), (table_pid, pmt)):
            packets.append(_table_packet(es, s, counter[es]))
            counter[es] += 1

    for k in range(max([len(s[2]) for s in streams], default=0)):
        for which, (es, _, units) in enumerate(streams):
            if k >= len(units):
                continue
            key = k % key_every == 0
            if key and not which:
                table()
            pts, dts = (k + 1) * tick & (1 << 33) - 1, k * tick & (1 << 33) - 1
            head = _write_stamp(3, pts) + _write_stamp(1, dts)
            size = 3 + len(head) + len(units[k])
            pes = b"\0\0\1" + bytes([0xE0 if not which else 0xC0]) + (size if size < 65536 else 0).to_bytes(2, "big") + bytes([0x80, 0xC0, len(head)]) + head + units[k]
            at = 0
            while at < len(pes):
                field = b""
                if not at and key:
                    field = b"\x07\x50" + (dts >> 1).to_bytes(4, "big") + bytes([(dts & 1) << 7 | 0x7E, 0])
                room = PACKET - 4 - len(field)
                left = len(pes) - at
                if left < room:  # stuffing
                    pad = room - left
                    if field:
                        field = bytes([field[0] + pad]) + field[1:] + b"\xff" * pad
                    else:
                        field = bytes([pad - 1]) + (b"\0" + b"\xff" * (pad - 2) if pad > 1 else b"")
                    room = left
                packets.append(bytes([_SYNC, (0 if at else 0x40) | es >> 8, es & 255, (0x30 if field else 0x10) | counter[es] & 15]) + field + pes[at : at + room])
                counter[es] += 1
                at += room
    if not packets:
        table()
    return b"".join(x * (2 if i in twice else 1) for i, x in enumerate(packets) if i not in drop)


def multiplex_table(rows: DataFrame, id_col: str, body_col: str, title_col: str, unit: int = 4096) -> DataFrame:
    """(id, ts BINARY): each row's body as one elementary stream, its title as another.

    A packet is missing where the body's length is a multiple of 97, and one is
    sent twice where it is a multiple of 89, so that continuity has something
    to find. Null columns are empty streams.
    """
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("ts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for b, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    body, title = (b or "").encode(), (t or "").encode()
                    units = [body[i : i + unit] for i in range(0, len(body), unit)]
                    drop = frozenset([len(body) // PACKET // 2 + 3]) if len(body) % 97 == 0 else frozenset()
                    twice = frozenset([4]) if len(body) % 89 == 0 else frozenset()
                    out.append(multiplex([(0x100, 0x1B, units), (0x101, 0x06, [title] if title else [])], drop=drop, twice=twice))
                yield pa.record_batch([part.column(0), pa.array(out, pa.binary())], schema.names)

    return pick(rows, id_col, body_col, title_col).mapInArrow(run, schema)
