"""Repeated passages by suffix arrays, over a prefix-free parse.

1. Split. Each document's windows of ``words`` consecutive words are cut into
   segments: maximal runs of windows whose least rolling hash of ``gram`` words
   is the same. Equal windows have equal least hashes, so they meet under one
   key; a document's segments hold each of its windows once. Keys that occur
   once can't repeat anything and end here, before any text moves.
2. Order. The segments that share keys (each distinct content once) are
   ordered by prefix-free parsing: a rolling hash of words triggers phrase
   ends, the distinct phrases are the dictionary, each segment is a sequence of
   phrase ranks; the suffix arrays of dictionary and parse combine into the
   order of all text positions. Neighbours in it that agree in ``words`` words
   or more are repeats.
3. Apply. Which windows repeat, and which are a passage's first occurrence,
   goes back to every document that has the segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.frames import edit_texts, materialise, pick, unpack_row, with_rows
from quillstone.llm.textkit import SPACE, buffers, expand, mix, prefix, slices, sliding_min, spans_hash, tidy, whole_groups, word_hashes, words


@dataclass(frozen=True)
class Config:
    """words: least length of a repeated passage. gram: words in the rolling
    hash that splits the corpus. trigger, modulus: words in the rolling hash
    that ends phrases, and of how many values one does. part: bytes of text
    that are ordered together, in whole keys. hot: keys with more distinct
    contents than this, such as those of a passage that very many documents
    share in different surroundings, aren't ordered in one place: their windows
    are compared one by one, by hash, wherever they are; the result is the same."""

    words: int = 50
    gram: int = 6
    trigger: int = 4
    modulus: int = 8
    part: int = 2_500_000
    hot: int = 4_000


def segments(data: np.ndarray, off: np.ndarray, config: Config) -> tuple[np.ndarray, ...]:
    """key, row, first window, windows, content hash and repeated key of all segments of a block of texts."""
    starts, ends, row = words(data, off, SPACE)
    k, g = config.words, config.gram
    empty = np.zeros(0, np.int64)
    if len(starts) < k:
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64), empty.astype(bool)
    p = prefix(word_hashes(data, starts, ends))
    n = len(starts)
    at = np.arange(n - g + 1)
    least = sliding_min(spans_hash(p, at, at + g), k - g + 1)
    whole = row[: n - k + 1] == row[k - 1 :]
    window = np.flatnonzero(whole)
    if not len(window):
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64), empty.astype(bool)
    value, of = least[window], row[window]
    first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])])
    count = np.diff(np.r_[first, len(window)])
    begin = window[first]
    in_row = begin - np.searchsorted(row, of[first], "left")
    grams = count + k - g  # the least gram occurring twice in one segment is what it takes to repeat within it
    here = spans_hash(p, at, at + g)[expand(begin, grams)] == np.repeat(value[first], grams)
    twice = np.add.reduceat(here.astype(np.int32), np.cumsum(grams) - grams) > 1
    return value[first], of[first], in_row, count, spans_hash(p, begin, begin + count + k - 1), twice


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64) + 1


def _double(rank: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of suffixes x[i:stop[i]] by their first ``depth`` symbols (prefix doubling)."""
    n, k = len(rank), 1
    at = np.arange(n)
    longest = int((stop - at).max()) if n else 0
    while k < min(depth, longest):
        nxt = np.zeros(n, np.int64)
        ok = at + k < stop
        nxt[ok] = rank[at[ok] + k]
        rank = _ranks(rank * (n + 2) + nxt)
        k *= 2
    return rank


def corpus_order(symbols: np.ndarray, bounds: np.ndarray, config: Config) -> np.ndarray:
    """Positions of all segments' suffixes in lexicographic order, to ``words`` symbols at least.

    symbols: word ranks, from 2. bounds: where the segments begin, and the end.
    """
    n, w = len(symbols), config.trigger
    p = prefix(mix(symbols.astype(np.uint64)))
    seg_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cut = np.zeros(n + 1, bool)
    if n >= w:
        at = np.arange(n - w + 1)
        cut[:-w] = (spans_hash(p, at, at + w) % np.uint64(config.modulus) == 0) & (seg_of[at] == seg_of[at + w - 1])
    cut[bounds] = True
    # phrases: from each cut to the end of the next trigger, or of the segment
    begin = np.flatnonzero(cut[:-1])
    nxt = np.r_[begin[1:], n]
    seg_end = bounds[1:][seg_of[begin]]
    last = nxt >= seg_end
    end = np.where(last, seg_end, np.minimum(nxt + w, seg_end))
    content = mix(spans_hash(p, begin, end) + last.astype(np.uint64))
    _, pick, phrase = np.unique(content, return_index=True, return_inverse=True)
    # dictionary: distinct phrases, those that end a segment with a symbol 1, each then closed
    size = end[pick] - begin[pick] + last[pick]
    starts = np.cumsum(size) - size
    text = np.ones(int(size.sum()), np.int64)
    inner = end[pick] - begin[pick]
    text[expand(starts, inner)] = symbols[expand(begin[pick], inner)]
    stop = np.repeat(starts + size, size)
    in_dict = _double(_ranks(text), stop, config.words)
    # parse: sequences of phrase ranks
    phrase_rank = in_dict[starts][phrase]
    parse_stop = np.searchsorted(begin, seg_end, "left")
    in_parse = _double(_ranks(phrase_rank), parse_stop, config.words)
    # combined: order by the rest of the phrase, then by what follows it in the parse
    of = np.repeat(np.arange(len(begin)), nxt - begin)
    rest = in_dict[starts[phrase[of]] + np.arange(n) - begin[of]]
    follow = np.r_[in_parse, 0][np.where(last, len(begin), np.arange(1, len(begin) + 1))][of]
    return np.argsort(rest * (int(in_parse.max(initial=0)) + 2) + follow, kind="stable")


def repeats(symbols: np.ndarray, bounds: np.ndarray, windows: np.ndarray, rank: np.ndarray, many: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """For each text position: does a repeated window begin there, and is it the first of its kind?

    windows: how many windows each segment holds. rank: place of each
    segment's first window among all words of the corpus. many: the segment's
    whole content occurs in several places.
    """
    n, k = len(symbols), config.words
    seg_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    offset = np.arange(n) - bounds[seg_of]
    order = corpus_order(symbols, bounds, config)
    order = order[offset[order] < windows[seg_of[order]]]
    left, right = order[:-1], order[1:]
    alive = np.arange(len(left))
    for c in range(k):  # agreement with the neighbour, symbol by symbol
        alive = alive[symbols[left[alive] + c] == symbols[right[alive] + c]]
    same = np.zeros(len(order), bool)
    same[alive + 1] = True
    first = np.flatnonzero(~same)
    repeated, own = np.zeros(n, bool), np.zeros(n, bool)
    if len(first):
        size = np.diff(np.r_[first, len(order)])
        several = (size > 1) | np.logical_or.reduceat(many[seg_of[order]], first)
        place = rank[seg_of[order]] + offset[order]
        least = np.minimum.reduceat(place, first)
        repeated[order] = np.repeat(several, size)
        own[order] = np.repeat(several, size) & (place == np.repeat(least, size))
    return repeated, own


def _flags_to_runs(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open runs of set flags within segments, flattened; offsets of each segment's list."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[bounds] = True
    up = flags & np.r_[True, ~flags[:-1] | edge[1:-1]] if len(flags) else flags
    down = flags & np.r_[~flags[1:] | edge[1:-1], True] if len(flags) else flags
    a, b = np.flatnonzero(up), np.flatnonzero(down) + 1
    seg = np.searchsorted(bounds, a, "right") - 1
    flat = np.stack([a - bounds[seg], b - bounds[seg]], axis=1).ravel()
    return flat, np.r_[0, np.cumsum(np.bincount(seg, minlength=len(bounds) - 1))] * 2


def _union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _split(every: list[list[int]], first: list[list[int]]) -> list[tuple[int, int, bool]]:
    """Parts of ``every`` inside and outside ``first``."""
    out = []
    for a, b in every:
        at = a
        for x, y in first:
            if y <= at or x >= b:
                continue
            if x > at:
                out.append((at, x, False))
            out.append((max(x, at), min(y, b), True))
            at = min(y, b)
        if at < b:
            out.append((at, b, False))
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:
    """Where passages of ``words`` words or more occur that occur elsewhere too.

    Returns (id, text_key, word_start, word_stop, first): words are maximal
    runs of bytes other than ASCII white space, counted from 0; the spans of a
    document are disjoint and together cover exactly the windows of ``words``
    words that occur at least twice in the corpus, in other documents or in the
    same. ``first`` is true where a span is covered by the earliest occurrence
    (by id, then place) of such a window: removing the other spans leaves one
    copy of everything. text_key (xxhash64 of the text) tells apart different
    texts under one id.

    Null and empty texts and those under ``words`` words have no repeats, nor
    has an empty table. Rows equal in id and text are one document. Null ids
    sort before all others and are kept. Ties, equal passages of one id, go by
    text_key, then place. Long texts and single very frequent passages need no
    cap: equal segments are ordered once. Other columns are ignored, whatever
    their names.
    """
    id_type = docs.schema[id_col].dataType
    k = config.words
    seg_t = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", id_type), T.StructField("tid", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("body", T.LongType()), T.StructField("twice", T.BooleanType())])
    text_t = T.StructType([T.StructField("key", T.LongType()), T.StructField("body", T.LongType()), T.StructField("id", id_type), T.StructField("tid", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("many", T.BooleanType()), T.StructField("words", T.BinaryType()), T.StructField("hot", T.BooleanType())])
    window_t = T.StructType([*text_t.fields[:5], T.StructField("j", T.IntegerType()), T.StructField("many", T.BooleanType()), T.StructField("window", T.LongType())])
    flag_t = T.StructType([*text_t.fields[:5], T.StructField("rep", T.ArrayType(T.IntegerType())), T.StructField("own", T.ArrayType(T.IntegerType()))])
    span_t = T.StructType([T.StructField(id_col, id_type), T.StructField("text_key", T.LongType()), T.StructField("word_start", T.IntegerType()), T.StructField("word_stop", T.IntegerType()), T.StructField("first", T.BooleanType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in slices(batch.column(2)):
                key, row, at, n, body, twice = segments(*buffers(texts), config)
                who = pa.array(row + a)
                yield pa.record_batch([pa.array(key.view(np.int64)), batch.column(0).take(who), batch.column(1).take(who), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(body.view(np.int64)), pa.array(twice)], seg_t.names)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part = batch.slice(r, 1)
                segs = part.column(3).flatten()
                data, off = buffers(part.column(2))
                starts, ends, _ = words(data, off, SPACE)
                at, n = np.asarray(segs.field("at")), np.asarray(segs.field("n"))
                raw = data.tobytes()
                who = pa.array(np.zeros(len(segs), np.int64))
                yield pa.record_batch(
                    [segs.field("key"), segs.field("body"), part.column(0).take(who), part.column(1).take(who), segs.field("at"), segs.field("n"), segs.field("many"), pa.array([raw[starts[x] : ends[x + y + k - 2]] for x, y in zip(at.tolist(), n.tolist(), strict=True)], pa.binary()), segs.field("hot")],
                    text_t.names,
                )

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", config.part):
            t = t.combine_chunks()
            data, off = buffers(t["words"])
            starts, ends, row = words(data, off, SPACE)
            bounds = np.r_[0, np.cumsum(np.bincount(row, minlength=len(t)))]
            symbols = _ranks(word_hashes(data, starts, ends)) + 1
            doc = pc.sort_indices(t.select(["id", "tid", "at"]), sort_keys=[("id", "ascending"), ("tid", "ascending"), ("at", "ascending")], null_placement="at_start")
            ids, tids = t["id"].take(doc).combine_chunks(), np.asarray(t["tid"].take(doc))
            new = np.zeros(len(t), np.int64)
            if len(t) > 1:
                differ = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(t) - 1)), True)
                nulls = np.asarray(pc.is_null(ids))
                new[1:] = (np.asarray(differ) & ~(nulls[1:] & nulls[:-1])) | (tids[1:] != tids[:-1])
            rank = np.zeros(len(t), np.int64)
            rank[np.asarray(doc)] = np.cumsum(new) << 32
            rank += np.asarray(t["at"]).astype(np.int64)
            windows = np.asarray(t["n"]).astype(np.int64)
            repeated, own = repeats(symbols, bounds, windows, rank, np.asarray(t["many"]), config)
            flat, rep_off = _flags_to_runs(repeated, bounds)
            own_flat, own_off = _flags_to_runs(own, bounds)
            out = pa.table(
                [*(t[c].combine_chunks() for c in flag_t.names[:5]), pa.ListArray.from_arrays(pa.array(rep_off, pa.int32()), pa.array(flat, pa.int32())), pa.ListArray.from_arrays(pa.array(own_off, pa.int32()), pa.array(own_flat, pa.int32()))],
                flag_t.names,
            )
            yield from out.filter(pa.array(np.diff(rep_off) > 0)).combine_chunks().to_batches()

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of each segment, by the hash of their words."""
        for batch in batches:
            data, off = buffers(batch.column(7))
            starts, ends, row = words(data, off, SPACE)
            p = prefix(word_hashes(data, starts, ends))
            n = np.asarray(batch.column(5)).astype(np.int64)
            first = np.searchsorted(row, np.arange(len(n)), "left")
            at = expand(first, n)
            who = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.record_batch([*(batch.column(c).take(who) for c in range(5)), pa.array(expand(np.zeros(len(n), np.int64), n), pa.int32()), batch.column(6).take(who), pa.array(spans_hash(p, at, at + k).view(np.int64))], window_t.names)

    def join_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Flags from the repeated windows of each content, as runs."""
        for batch in batches:
            rep, own = [], []
            for w in batch.column(5).to_pylist():
                at = sorted((x["j"], x["own"]) for x in w)
                for out, js in ((rep, [j for j, _ in at]), (own, [j for j, o in at if o])):
                    flat: list[int] = []
                    for j in js:
                        if flat and flat[-1] == j:
                            flat[-1] = j + 1
                        else:
                            flat += [j, j + 1]
                    out.append(flat)
            yield pa.record_batch([*(batch.column(c) for c in range(5)), pa.array(rep, pa.list_(pa.int32())), pa.array(own, pa.list_(pa.int32()))], flag_t.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, a, b, first = [], [], [], []
            for r, segs in enumerate(batch.column(2)):
                every, own = [], []
                for s in segs.as_py():
                    at = s["at"]
                    every += [(at + x, at + y + k - 1) for x, y in zip(s["rep"][::2], s["rep"][1::2], strict=True)]
                    if s["lead"]:
                        own += [(at + x, at + y + k - 1) for x, y in zip(s["own"][::2], s["own"][1::2], strict=True)]
                for x, y, f in _split(_union(every), _union(own)):
                    who.append(r)
                    a.append(x)
                    b.append(y)
                    first.append(f)
            rows = pa.array(who, pa.int64())
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(first, pa.bool_())], span_t.names)

    keyed = pick(docs, id_col, text_col).toDF("id", "text").filter("text IS NOT NULL").select("id", F.xxhash64("text").alias("tid"), "text")
    segs = materialise(keyed.mapInArrow(tidy(split), seg_t), "segments")
    # a key may repeat something where it has two places (rows equal in id and text have the same), or a segment that repeats within itself
    differ = lambda c: F.min(c) != F.max(c)
    mixed = differ("tid") | differ("at") | F.coalesce(differ("id"), F.lit(False)) | (F.count("id") != F.count("*")) & (F.count("id") > 0)
    keys = segs.groupBy("key").agg((mixed | F.bool_or("twice")).alias("alive")).filter("alive").select("key")
    live = materialise(segs.join(keys, "key", "left_semi"), "live")
    place = F.struct("id", "tid", "at")
    # each distinct content is ordered once, however many documents have it: collapsed before it is exchanged
    contents = live.groupBy("key", "body").agg(F.min(place).alias("lead"), F.max(place).alias("last"), F.any_value("n").alias("n"))
    contents = contents.select("key", "body", "lead.*", "n", (~F.col("lead").eqNullSafe(F.col("last"))).alias("many"))
    hot = contents.groupBy("key").count().filter(F.col("count") > config.hot).select("key", F.lit(True).alias("hot"))
    contents = contents.join(hot, "key", "left")
    wanted = contents.groupBy("id", "tid").agg(F.collect_list(F.struct("key", "body", "at", "n", "many", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("segs"))
    joined = keyed.alias("d").join(wanted.alias("w"), F.col("d.tid").eqNullSafe(F.col("w.tid")) & F.col("d.id").eqNullSafe(F.col("w.id")))
    texts = materialise(joined.select("d.id", "d.tid", "d.text", "w.segs").mapInArrow(tidy(extract), text_t), "contents")
    flags = texts.filter("NOT hot").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(order), flag_t)
    # hot keys: a window repeats where it has two places, or its content has
    windows = texts.filter("hot").mapInArrow(tidy(apart), window_t).withColumn("place", F.struct("id", "tid", (F.col("at") + F.col("j")).alias("at")))
    met = windows.groupBy("window").agg(F.min("place").alias("lead"), (~F.min("place").eqNullSafe(F.max("place")) | F.bool_or("many")).alias("again")).filter("again").select("window", "lead")
    again = windows.join(met, "window").groupBy(*text_t.names[:5]).agg(F.collect_list(F.struct("j", F.col("place").eqNullSafe(F.col("lead")).alias("own"))).alias("windows"))
    flags = flags.unionByName(again.mapInArrow(tidy(join_windows), flag_t))
    flags = flags.dropDuplicates(["key", "body"])  # rows equal in id and text gave theirs twice
    flags = flags.select("key", "body", F.struct("id", "tid", "at").alias("first"), "rep", "own")
    found = live.join(flags, ["key", "body"]).withColumn("lead", place.eqNullSafe(F.col("first")))
    # many documents may share a content, whose flags are one row: adaptive joins split them
    hits = found.groupBy("id", "tid").agg(F.collect_list(F.struct("at", "lead", "rep", "own")).alias("segs"))
    return hits.mapInArrow(tidy(merge), span_t)


def cut_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages that aren't their first occurrence.

    The cut words go with the white space after them; everything else stays
    byte for byte. Texts without such passages are unchanged. A document of
    which nothing is left goes. Null texts stay, and so do empty ones and an
    empty table; rows that repeat id and text are cut alike, long texts in
    whole. Spans may touch or be given in any order. All columns and their order
    stay, whatever their names.
    """
    cuts = passages.filter("NOT first").groupBy(F.col(id_col).alias("_cut_id"), F.col("text_key").alias("_cut_key")).agg(F.array_sort(F.collect_list(F.struct("word_start", "word_stop"))).alias("_cuts"))
    # the row travels as one struct, so that no column of ``docs`` can clash
    d = with_rows(docs, did=id_col, text=text_col).withColumn("key", F.xxhash64("text"))
    joined = d.join(cuts, F.col("did").eqNullSafe(F.col("_cut_id")) & (F.col("key") == F.col("_cut_key")), "left")
    edited = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(edit_texts(_cut)(F.when(F.col("_cuts").isNotNull(), F.col("text")), F.col("_cuts")))
    out = joined.select("row", "_cuts", edited.alias("new")).filter(F.col("_cuts").isNull() | F.col("new").rlike(r"\S"))
    return unpack_row(docs, out, text_col, F.col("new"))


def _cut(text: str, cuts) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, _, _ = words(raw, np.array([0, len(raw)]), SPACE)
    edge = np.r_[starts, len(raw)]
    keep = np.ones(len(raw), bool)
    for c in cuts:
        keep[edge[c["word_start"]] : edge[c["word_stop"]]] = False
    return raw[keep].tobytes().decode()
