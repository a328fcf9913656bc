"""Token-id output: best-fit-decreasing windows, written as packed matrices."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.textkit import runs
from quillstone.llm.token_windows import Config, pack_documents


class CapacityTree:
    """Segment tree over remaining capacities: how many open windows have each."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, need: int) -> int:
        """The smallest capacity >= need that an open window has, or -1."""
        i, count = need + self.size, self.count
        if count[i]:
            return need
        while i > 1:  # up to the first ancestor with something to its right
            if not i & 1 and count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest pieces first, each into the open window that it fills best.

    Ties between pieces go by their order, between windows by which had that
    room first.
    """
    window, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    order = np.argsort(-length, kind="stable")
    full = int((length == capacity).sum())
    window[order[:full]] = np.arange(full)
    opened = full
    tree, rooms = CapacityTree(capacity), [deque() for _ in range(capacity + 1)]
    for i, n in zip(order[full:].tolist(), length[order[full:]].tolist(), strict=True):
        room = tree.least(n)
        if room < 0:
            w, room = opened, capacity
            opened += 1
        else:
            w = rooms[room].popleft()
            tree.add(room, -1)
        window[i], at[i] = w, capacity - room
        if room > n:
            rooms[room - n].append(w)
            tree.add(room - n, 1)
    return window, at


def pack_best_fit(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:
    """Windows of token ids by best-fit decreasing; rows as of :func:`pack_documents`.

    Null and empty texts are in no window; texts over the window are split into
    full pieces and a rest, without loss. Of pieces of one length the earlier
    document goes first, by id, then by content; null ids first. Repeated rows
    are packed each. An empty table has no windows. Other columns are ignored,
    whatever their names.
    """
    return pack_documents(docs, tokenizer_path, best_fit_decreasing, id_col, text_col, config)


def write_matrices(packed: DataFrame, folder: str) -> DataFrame:
    """Write each shard's windows as ``shard-N.ids.bin`` (the id matrix, row by
    row), ``shard-N.pos.bin`` (position resets) and ``shard-N.cu.bin`` (int32:
    for each window the number of pieces, then cumulative lengths).

    ``folder`` must be one that all executors share as a path. Windows are
    written one batch after another, so that a shard of any size fits. An empty
    table writes nothing and has an empty manifest; nulls and ties were settled
    when the windows were packed; other columns are ignored. Files are written under
    another name and moved, so that a repeated task leaves the same files.
    Returns the manifest (shard, windows, pieces), evaluated by the caller.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        kinds, shard, files, windows, pieces = ("ids", "pos", "cu"), None, [], 0, 0

        def close() -> pa.RecordBatch:
            for f, kind in zip(files, kinds, strict=True):
                f.close()
                os.replace(f.name, f"{folder}/shard-{shard}.{kind}.bin")
            return pa.record_batch([pa.array([shard]), pa.array([windows]), pa.array([pieces])], ["shard", "windows", "pieces"])

        for batch in batches:
            for a, n in zip(*runs(np.asarray(batch.column("shard"))), strict=True):
                part = batch.slice(a, n)
                if part.column("shard")[0].as_py() != shard:
                    if files:
                        yield close()
                    shard, windows, pieces = part.column("shard")[0].as_py(), 0, 0
                    tmp = f"{folder}/.{uuid.uuid4().hex}"
                    files = [open(f"{tmp}.{kind}", "wb") for kind in kinds]
                cu = part.column("cu_seqlens").to_pylist()
                for f, body in zip(files, (b"".join(part.column("ids").to_pylist()), b"".join(part.column("positions").to_pylist()), b"".join(np.array([len(c) - 1, *c], "<i4").tobytes() for c in cu)), strict=True):
                    f.write(body)
                windows, pieces = windows + n, pieces + sum(len(c) - 1 for c in cu)
        if files:
            yield close()

    return packed.select("shard", "window", "ids", "positions", "cu_seqlens").repartition("shard").sortWithinPartitions("shard", "window").mapInArrow(write, "shard long, windows long, pieces long")
