"""Packing by minimum bin slack: subset sums over the lengths that remain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quillstone.llm.token_windows import Config, pack_documents


def fullest(lengths: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many of each length (descending) to take for the sum closest to capacity.

    Bit s of ``reach`` says that some of the lengths so far sum to s; a length
    with count c is added by doubling steps. Stops as soon as the capacity
    itself is reached, so that among equal sums longer pieces go first.
    """
    reach, mask, before = 1, (1 << (capacity + 1)) - 1, []
    for length, count in zip(lengths, counts, strict=True):
        before.append(reach)
        left, step = min(count, capacity // length), 1
        while left:
            take = min(step, left)
            reach |= reach << (length * take) & mask
            left -= take
            step *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    taken = [0] * len(before)
    for k in range(len(before) - 1, -1, -1):
        while not before[k] >> total & 1:
            total -= lengths[k]
            taken[k] += 1
    return taken


def minimum_slack(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window by window, the remaining pieces that fill it best.

    Pieces of one length are taken in their order; pieces of full capacity
    have windows of their own.
    """
    window, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    order = np.argsort(-length, kind="stable")
    full = int((length == capacity).sum())
    window[order[:full]] = np.arange(full)
    order = order[full:]
    lengths, first, counts = np.unique(-length[order], return_index=True, return_counts=True)
    lengths, nxt, counts = (-lengths).tolist(), first.tolist(), counts.tolist()
    w = full
    while lengths:
        used, empty = 0, False
        for k, n in enumerate(fullest(lengths, counts, capacity)):
            for i in order[nxt[k] : nxt[k] + n].tolist() if n else ():
                window[i], at[i] = w, used
                used += lengths[k]
            nxt[k] += n
            counts[k] -= n
            empty |= not counts[k]
        if empty:
            keep = [k for k, c in enumerate(counts) if c]
            lengths, nxt, counts = [lengths[k] for k in keep], [nxt[k] for k in keep], [counts[k] for k in keep]
        w += 1
    return window, at


def pack_min_slack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:
    """Windows of token ids by minimum bin slack; rows as of :func:`pack_documents`.

    Null and empty texts are in no window; texts over the window are split into
    full pieces and a rest, without loss. Of sums that fill a window alike the
    one of longer pieces is taken, of pieces of one length the earlier document,
    by id, then by content; null ids first. Repeated rows are packed each. An
    empty table has no windows. Other columns are ignored, whatever their names.
    """
    return pack_documents(docs, tokenizer_path, minimum_slack, id_col, text_col, config)
