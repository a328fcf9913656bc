"""Language identification: nearest of several TF-IDF centroids for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.frames import flat, materialise, pick
from quillstone.llm.textkit import buffers, slices, tidy

#: Letters of ASCII are folded by the caller; digits, signs and white space all become one blank.
_FOLD = np.array([i if i >= 128 or chr(i).isalpha() else 32 for i in range(256)], np.uint32)
_SIZES = (2**np.arange(0, 14)).tolist()  # letters; classes by length for the thresholds


@dataclass(frozen=True)
class Config:
    """dims: hashed n-gram buckets. clusters: centroids a language.

    per_language: labelled rows a language that the fit looks at, on average.
    most_languages: more labels than these are an error, as every language has
    its centroids on every worker.
    reject_quantile, margin: a text is rejected where its cosine to the nearest
    centroid is below margin times this quantile of the fitted rows' own
    cosines at its length; the shortest texts have thresholds of their own.
    """

    dims: int = 4096
    clusters: int = 4
    per_language: int = 400
    reject_quantile: float = 0.002
    margin: float = 0.6
    most_languages: int = 1000
    seed: int = 7


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # (k, dims), unit length
    langs: list[str]  # of each centroid
    floor: np.ndarray  # least cosine, by length class
    config: Config


def counts(data: np.ndarray, off: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (rows, dims) for 1 to 3 bytes of folded text, and letters a row."""
    rows = len(off) - 1
    x = _FOLD[data]
    keep = np.ones(len(x), bool)
    if len(x):
        first = np.zeros(len(x) + 1, bool)
        first[off] = True
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | first[1:-1]  # runs of blanks count once
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(off))[keep]
    x = x[keep]
    out = np.zeros(rows * dims, np.float32)
    for n in (1, 2, 3):
        if len(x) < n:
            break
        code = np.full(len(x) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            code = (code ^ x[k : len(x) - n + 1 + k]) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        code ^= code >> np.uint32(13)
        same = row[: len(row) - n + 1] == row[n - 1 :]
        key = row[: len(row) - n + 1].astype(np.int64) * dims + (code % np.uint32(dims))
        out += np.bincount(key[same], minlength=rows * dims)
    letters = np.bincount(row[x != 32], minlength=rows)
    return out.reshape(rows, dims), letters


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF, with a logarithm of the counts."""
    x = np.log1p(tf) * idf
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(n, 1e-9)


def _size_class(letters: np.ndarray) -> np.ndarray:
    return np.clip(np.searchsorted(_SIZES, letters, "right") - 1, 0, len(_SIZES) - 1)


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; begins at rows far from one another."""
    c = [x[rng.integers(len(x))]]
    while len(c) < min(k, len(x)):
        c.append(x[np.argmin(np.max(x @ np.array(c).T, axis=1))])
    c = np.array(c)
    for _ in range(20):
        near = np.argmax(x @ c.T, axis=1)
        new = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, c, atol=1e-4):
            break
        c = new
    return c


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> Model:
    """Document frequencies over all documents; centroids from a bounded sample.

    The sample takes rows by a hash of id, at most ``per_language`` expected for
    each language (Config), whatever the size of the table. Everything that
    reaches the driver is of a fixed size: dims frequencies and the sample's
    vectors. An empty table, or one without labels, gives a model that rejects
    all. Null texts count as documents without n-grams and are in no sample; nor
    are rows without a label. Rows with a null id are in the sample or out of it
    together, and so are rows that repeat an id. Very long texts are counted in
    blocks. Other columns are ignored, whatever their names.
    """
    docs = pick(docs, id_col, lang_col, text_col)
    sizes = {r[0]: r[1] for r in docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col)).count().limit(config.most_languages + 1).collect()}
    if len(sizes) > config.most_languages:
        raise ValueError(f"{lang_col} has more than {config.most_languages} languages")
    share = {k: config.per_language / n for k, n in sizes.items()}
    chance = (F.xxhash64(F.col(id_col).cast("string"), F.lit(config.seed)).bitwiseAND((1 << 40) - 1)) / float(1 << 40)
    wanted = F.lit(False)
    if share:
        rate = F.create_map(*[F.lit(v) for kv in share.items() for v in kv])
        wanted = F.coalesce(chance < F.try_element_at(rate, F.col(lang_col).cast("string")), F.lit(False))
    sent = docs.select(F.when(wanted, F.col(lang_col).cast("string")).alias("lang"), F.col(text_col).alias("text"))
    dims = config.dims

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(dims, np.int64), 0
        for batch in batches:
            for a, texts in slices(batch.column(1), 1_000_000):
                lang = batch.column(0).slice(a, len(texts))
                data, off = buffers(pc.utf8_lower(texts))
                for a2 in range(0, len(texts), 256):
                    b2 = min(len(texts), a2 + 256)
                    tf, letters = counts(data[off[a2] : off[b2]], off[a2 : b2 + 1] - off[a2], dims)
                    df += (tf > 0).sum(axis=0)
                    rows += b2 - a2
                    chosen = [i for i in range(b2 - a2) if lang[a2 + i].is_valid and letters[i]]
                    if chosen:
                        yield pa.record_batch([pa.array([-1] * len(chosen), pa.int32()), pa.array(letters[chosen], pa.int64()), lang.take(pa.array([a2 + i for i in chosen])), pa.array([tf[i].astype(np.float32).tobytes() for i in chosen], pa.binary())], names)
        yield pa.record_batch([pa.array(np.arange(dims + 1), pa.int32()), pa.array(np.r_[df, rows], pa.int64()), pa.nulls(dims + 1, pa.string()), pa.nulls(dims + 1, pa.binary())], names)

    schema = "bucket int, n long, lang string, tf binary"
    names = ["bucket", "n", "lang", "tf"]
    seen = materialise(sent.mapInArrow(tidy(gather), schema), "langid")
    freq = np.zeros(dims + 1)
    for r in seen.filter("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        freq[r[0]] = r[1]
    idf = (np.log((1 + freq[dims]) / (1 + freq[:dims])) + 1).astype(np.float32)
    sample = seen.filter("bucket < 0").select("lang", "n", "tf").toArrow()
    langs = np.array(sample["lang"].to_pylist(), object)
    order = np.lexsort([np.array([hash_bytes(b) for b in sample["tf"].to_pylist()], np.uint64)]) if len(langs) else []
    tf = np.array([np.frombuffer(sample["tf"][int(i)].as_py(), np.float32) for i in order]).reshape(-1, dims)
    langs = langs[order] if len(langs) else langs
    rng = np.random.default_rng(config.seed)
    cents, of = [], []
    x = weigh(tf, idf)
    for lang in sorted(set(langs)):
        c = _cluster(x[langs == lang], config.clusters, rng)
        cents.append(c)
        of += [lang] * len(c)
    c = np.concatenate(cents) if cents else np.zeros((0, dims), np.float32)
    floor = np.zeros(len(_SIZES), np.float32)
    if len(c):
        for k, size in enumerate(_SIZES):  # shorter texts of the same kind: counts thinned at random
            total = tf.sum(axis=1)
            rate = np.minimum(1, 2.6 * size / np.maximum(total, 1))
            thin = rng.binomial(tf.astype(np.int64), rate[:, None]).astype(np.float32)
            fits = thin.sum(axis=1) > 0
            best = (weigh(thin[fits], idf) @ c.T).max(axis=1) if fits.any() else np.zeros(1)
            floor[k] = config.margin * np.quantile(best, config.reject_quantile)
    return Model(idf, c.astype(np.float32), of, floor, config)


def hash_bytes(b: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b)


def predict(model: Model, texts: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Language (None where rejected), cosine to the nearest centroid, letters."""
    n = len(texts)
    lang: list[str | None] = [None] * n
    score, size = np.zeros(n), np.zeros(n, np.int64)
    dims = model.config.dims
    for a, some in slices(texts, 1_000_000):
        data, off = buffers(pc.utf8_lower(some))
        for a2 in range(0, len(some), 256):
            b2 = min(len(some), a2 + 256)
            tf, letters = counts(data[off[a2] : off[b2]], off[a2 : b2 + 1] - off[a2], dims)
            size[a + a2 : a + b2] = letters
            if not len(model.centroids):
                continue
            sims = weigh(tf, model.idf) @ model.centroids.T
            best = np.argmax(sims, axis=1)
            top = sims[np.arange(b2 - a2), best]
            score[a + a2 : a + b2] = top
            ok = (letters > 0) & (top >= model.floor[_size_class(letters)])
            for i in np.flatnonzero(ok):
                lang[a + a2 + i] = model.langs[best[i]]
    return lang, score, size


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, cosine, rejected) for every row of ``docs``; map only.

    language is null exactly where rejected: the text is too far from every
    centroid for its length, or has no letter (null, empty, only digits and
    signs). Ties go to the centroid of the language that sorts first. Repeated
    rows get a row each; null ids stay null; texts of any length are judged in
    whole; an empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("language", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, _ = predict(shared.value, batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(np.round(score, 6)), pa.array([x is None for x in lang])], schema.names)

    return pick(docs, id_col, text_col).mapInArrow(tidy(run), schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language isn't rejected; map only.

    Null and empty texts, and those without a letter, are rejected. Repeated
    rows stay or go alike, whatever their ids; ids may be null or absent. Texts
    of any length are judged in whole. An empty table stays empty. Columns of
    any names go with their rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    numbered, at = flat(docs), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _, _ = predict(shared.value, batch.column(at))
            yield batch.filter(pa.array([x is not None for x in lang]))

    return numbered.mapInArrow(tidy(run), numbered.schema).toDF(*docs.columns)
