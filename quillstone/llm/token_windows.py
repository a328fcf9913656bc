"""Shared part of the packers: tokens by shard, pieces, and windows of token ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.bpe import BLOCK, encoder, release_encoders, tokenizer
from quillstone.llm.frames import pick
from quillstone.llm.textkit import buffers, expand, runs, slices, tidy


@dataclass(frozen=True)
class Config:
    """capacity: tokens a window. eos: id put after each document (None: none).
    pad: id that fills the rest of a window. shard_docs: documents that are
    packed together, half of it at least on average: a document's shard is the
    low bits of its id's hash, as many as the table's row count needs. Where a
    table grows past a power of two, shards split in two and no document
    changes sides. shard_tokens: a shard with more than these, of very long
    documents, is packed in so many parts, in order of its documents."""

    capacity: int = 2048
    eos: int | None = 50256
    pad: int = 50256
    shard_docs: int = 4096
    shard_tokens: int = 8_000_000


#: From piece lengths (at most the capacity) and the capacity: window and offset of each.
Planner = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def assemble(ids: np.ndarray, off: np.ndarray, plan: Planner, config: Config) -> dict[str, np.ndarray]:
    """Windows of one shard from its documents' ids (documents have at least one).

    Documents over the capacity are split into full pieces and a rest; nothing
    is lost or cut. Pieces keep (doc, start in the doc, length).
    """
    size, cap = np.diff(off), config.capacity
    pieces = -(-size // cap)
    doc = np.repeat(np.arange(len(size)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * cap
    length = np.minimum(size[doc] - start, cap)
    window, at = plan(length, cap)
    n = int(window.max()) + 1 if len(window) else 0
    kind = np.uint16 if max(config.pad, int(ids.max(initial=0))) < 65536 else np.uint32
    matrix = np.full(n * cap, config.pad, kind)
    position = np.zeros(n * cap, np.uint16 if cap <= 65536 else np.uint32)
    to = expand(window * cap + at, length)
    matrix[to] = ids[expand(off[doc] + start, length)]
    position[to] = expand(np.zeros(len(length), np.int64), length)
    order = np.lexsort([at, window])
    return {"matrix": matrix.reshape(n, cap), "position": position.reshape(n, cap), "doc": doc[order], "start": start[order], "length": length[order], "count": np.bincount(window, minlength=n), "used": np.bincount(window, weights=length, minlength=n).astype(np.int64)}


def pack_documents(docs: DataFrame, tokenizer_path: str, plan: Planner, id_col: str, text_col: str, config: Config) -> DataFrame:
    """One row a window: (shard, window, ids, positions, cu_seqlens, doc_ids, starts, used, slack).

    ids: the window's row of the token matrix, little-endian, 2 bytes an id (4
    where the vocabulary needs it). positions: 2 bytes each, from 0 again at
    every piece. cu_seqlens: cumulative piece lengths from 0. doc_ids, starts:
    the piece's document and its first token there. One exchange, of token ids.

    Null and empty texts have no tokens and are in no window. Ties go by id,
    then by content. Repeated rows are packed each. Null ids are packed too.
    Other columns are ignored, whatever their names.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    docs = pick(docs, id_col, text_col)
    shards = 1 << max(0, -(-docs.count() // config.shard_docs) - 1).bit_length()  # reads row counts, no text
    sent = T.StructType([T.StructField("shard", T.LongType()), T.StructField("id", id_type), T.StructField("tokens", T.BinaryType())])
    result = T.StructType(
        [T.StructField("shard", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("positions", T.BinaryType())]
        + [T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("used", T.IntegerType()), T.StructField("slack", T.IntegerType())]
    )
    shared = spark.sparkContext.broadcast(tokenizer(tokenizer_path))
    kind = np.dtype("<u2") if max(config.pad, config.eos or 0, len(shared.value.labels)) < 65536 else np.dtype("<u4")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared)
        for batch in batches:
            for a, texts in slices(batch.column(2), BLOCK):
                b = a + len(texts)
                ids, ends = e.encode(*buffers(texts))
                if config.eos is not None:
                    some = np.flatnonzero(np.diff(ends))
                    ids = np.insert(ids, ends[some + 1], config.eos)
                    ends = ends + np.r_[0, np.cumsum(np.diff(ends) > 0)]
                raw = ids.astype(kind)
                body = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(raw)])
                out = pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), body], sent.names)
                yield out.filter(pa.array(np.diff(ends) > 0))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table]]:
        """Each shard's documents, in order, by shard_tokens; and whether they begin a shard."""
        held: list[pa.RecordBatch] = []
        shard = part = None
        seen, fresh = 0, True
        for batch in batches:
            for s, size in zip(*runs(np.asarray(batch.column(0))), strict=True):
                mine = batch.slice(s, size)
                if shard != mine.column(0)[0].as_py():
                    if held:
                        yield fresh, pa.Table.from_batches(held)
                    held, shard, part, seen, fresh = [], mine.column(0)[0].as_py(), 0, 0, True
                count = np.asarray(pc.binary_length(mine.column(2))).astype(np.int64) // kind.itemsize
                which = (seen + np.cumsum(count) - count) // config.shard_tokens
                seen += int(count.sum())
                for a, n in zip(*runs(which), strict=True):
                    if which[a] != part and held:
                        yield fresh, pa.Table.from_batches(held)
                        held, fresh = [], False
                    part = which[a]
                    held.append(mine.slice(a, n))
        if held:
            yield fresh, pa.Table.from_batches(held)

    def rows_of(matrix: np.ndarray, a: int, b: int) -> pa.Array:
        """Rows a to b of a matrix, each as bytes."""
        part = np.ascontiguousarray(matrix[a:b])
        off = np.arange(b - a + 1, dtype=np.int32) * (part.shape[1] * part.itemsize)
        return pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(off), pa.py_buffer(part)])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()  # texts were encoded in an earlier stage, perhaps by this worker
        done = 0
        for fresh, t in parts(batches):
            done = 0 if fresh else done
            raw, off = buffers(t["tokens"])
            w = assemble(np.ascontiguousarray(raw).view(kind), off // kind.itemsize, plan, config)
            n, end = len(w["count"]), np.r_[0, np.cumsum(w["count"])]
            ids = t["id"].combine_chunks()
            for a in range(0, n, 1024):
                b = min(n, a + 1024)
                p = slice(end[a], end[b])
                lists = pa.array(end[a : b + 1] - end[a], pa.int32())
                # lengths of each window with a 0 before them, summed up within the window
                m = w["count"][a:b]
                sums = np.cumsum(np.r_[0, w["length"][p]])
                cu_off = np.r_[0, np.cumsum(m + 1)]
                cu = sums[expand(end[a:b] - end[a], m + 1)] - np.repeat(sums[end[a:b] - end[a]], m + 1)
                yield pa.record_batch(
                    [
                        t["shard"].chunk(0).take(pa.array(np.zeros(b - a, np.int64))),
                        pa.array(np.arange(done + a, done + b), pa.int32()),
                        rows_of(w["matrix"], a, b),
                        rows_of(w["position"], a, b),
                        pa.ListArray.from_arrays(pa.array(cu_off, pa.int32()), pa.array(cu, pa.int32())),
                        pa.ListArray.from_arrays(lists, ids.take(pa.array(w["doc"][p]))),
                        pa.ListArray.from_arrays(lists, pa.array(w["start"][p], pa.int32())),
                        pa.array(w["used"][a:b], pa.int32()),
                        pa.array(config.capacity - w["used"][a:b], pa.int32()),
                    ],
                    result.names,
                )
            done += n

    shard = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000"))), F.lit(shards)).alias("shard")
    sent_rows = docs.select(shard, F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(tokens), sent)
    return sent_rows.repartition("shard").sortWithinPartitions("shard", "id", "tokens").mapInArrow(tidy(windows), result)
