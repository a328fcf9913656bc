"""Document fingerprints: canonical exact digests and the groups they make."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.frames import pick
from quillstone.llm.textkit import tidy

#: Compressed bytes that a task keeps to compare its own copies with.
HELD = 32_000_000


def canonical(text: str, form: str = "NFC") -> str:
    """Unicode normalisation, full case folding, runs of any white space to one blank, none at the ends."""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize(form, text).casefold()
    return " ".join(unicodedata.normalize(form, folded).split())


def folding_sql(text: str) -> str:
    """The canonical text (NFC) as DuckDB SQL, whose lower() doesn't fold: what differs is replaced first."""
    out = f"nfc_normalize({text})"
    for c in range(0x80, 0x110000):
        a = chr(c)
        if a.casefold() != a.lower() or len(a.lower()) > 1:
            out = f"replace({out}, '{a}', '{a.casefold()}')"
    blanks = "".join(f"\\x{{{c:x}}}" for c in range(0x110000) if chr(c).isspace())
    return f"trim(regexp_replace(nfc_normalize(lower({out})), '[{blanks}]+', ' ', 'g'), ' ')"


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "NFC") -> DataFrame:
    """Exact duplicate groups by canonical text: one row for each row of ``docs``.

    Returns (id, digest BINARY, group_id, group_size): the 128-bit digest of the
    canonical text, the smallest id among rows whose canonical bytes are equal,
    and their number.

    Groups are counted by digest (and a second, independent one), before and
    after the exchange, so that a text that a third of all rows have costs a
    row a task. Its bytes are sent once by each task that has it, compressed,
    not with each copy; where they meet they are compared, and so are copies
    within a task. Texts that differ under one pair of digests (192 bits) end
    the job with an error; they are never joined. Rows then take their group by
    digest, the frequent ones in several tasks, as adaptive joins split them.

    Null text: digest null, a group of its own (group_id = its id, size 1).
    Empty and all-blank texts are equal to one another. Repeated rows count
    each. Null ids keep their row and are passed over for group_id. Texts of
    any length are taken in whole; equal ones need no order, so there are no
    ties. An empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    id_type = docs.schema[id_col].dataType
    keyed = T.StructType([T.StructField("id", id_type), T.StructField("digest", T.BinaryType()), T.StructField("check", T.LongType())])
    sent = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("check", T.LongType()), T.StructField("body", T.BinaryType())])
    met = T.StructType(sent.fields[:2])

    def canons(col: pa.Array) -> Iterator[bytes | None]:
        for s in col:
            yield canonical(s.as_py(), form).encode() if s.is_valid else None

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                digests, checks = [], []
                for raw in canons(part.column(1)):
                    digests.append(None if raw is None else xxhash.xxh3_128_digest(raw))
                    checks.append(None if raw is None else xxhash.xxh64_intdigest(raw, seed=1) - (1 << 63))
                yield pa.record_batch([part.column(0), pa.array(digests, pa.binary()), pa.array(checks, pa.int64())], ["id", "digest", "check"])

    def same(a: bytes, b: bytes) -> bool:
        """Equal frames hold equal bytes; unequal ones are opened."""
        unpack = zstandard.ZstdDecompressor().decompress
        return a == b or unpack(a) == unpack(b)

    def differ(d: bytes) -> ValueError:
        return ValueError(f"two texts have the digest {d.hex()}")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        held: dict[tuple[bytes, int], bytes] = {}
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out: list[tuple[bytes, int, bytes]] = []
                for raw in canons(batch.column(0).slice(at, 512)):
                    if raw is None:
                        continue
                    key, body = (xxhash.xxh3_128_digest(raw), xxhash.xxh64_intdigest(raw, seed=1) - (1 << 63)), pack(raw)
                    if key in held:
                        if not same(held[key], body):
                            raise differ(key[0])
                        continue
                    out.append((*key, body))
                    held[key] = body
                    size += len(body)
                    if size > HELD:  # what comes again is sent again
                        held.clear()
                        size = 0
                cols = list(zip(*out, strict=True)) if out else [(), (), ()]
                yield pa.record_batch([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["digest", "check", "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = body = None
        for batch in batches:
            found: list[tuple[bytes, int]] = []
            for d, c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (d, c) != last:
                    last, body = (d, c), b
                    found.append(last)
                elif not same(body, b):
                    raise differ(d)
            yield pa.record_batch([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int64())], ["digest", "check"])

    docs = pick(docs, id_col, text_col)
    rows = docs.mapInArrow(tidy(digest), keyed)
    texts = docs.select(text_col).mapInArrow(tidy(bodies), sent).repartition("digest", "check").sortWithinPartitions("digest", "check").mapInArrow(tidy(compare), met)
    counted = rows.filter("digest IS NOT NULL").groupBy("digest", "check").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    groups = counted.join(texts, ["digest", "check"])
    out = rows.filter("digest IS NOT NULL").join(groups, ["digest", "check"]).select(F.col("id").alias(id_col), "digest", "group_id", "group_size")
    alone = docs.filter(F.col(text_col).isNull()).select(F.col(id_col), F.lit(None).cast("binary").alias("digest"), F.col(id_col).alias("group_id"), F.lit(1).cast("long").alias("group_size"))
    return out.unionByName(alone)
