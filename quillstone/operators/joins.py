"""Joins that plain equality can't express, as equi-joins, and last-wins dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.schema import Model


def prefixes(text: str, name: str) -> Column:
    """Explodes a text into all its prefixes, '' and itself among them, so that
    "begins with" is an equi-join of hash partitions; as a LIKE condition it
    would compare all with all."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.length(text)), lambda k: F.substring(F.col(text), F.lit(1), k))).alias(name)


def interval_join(probes: DataFrame, pos: str, spans: DataFrame, start: str, stop: str, keys: list[str], width: int = 4096, fan: int = 64, levels: int = 5) -> DataFrame:
    """Probes with the spans that hold their position (start and stop inclusive).

    Positions fall into buckets of ``width`` and, level by level, of ``fan``
    times the width. A span is a row in each of its buckets of the first level
    where these are ``fan`` + 1 at most (at the last level, however many), and
    a probe is a row in its bucket of each level, so that keys, level and bucket
    make an equi-join and no span, however long, makes many rows. A span and a
    position meet in exactly one bucket: no pair comes twice.
    """
    wide = [width * fan**k for k in range(levels)]
    bucket = lambda x, k: F.floor(F.col(x) / wide[k]).cast("long")
    p = probes.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), bucket(pos, k).alias("bucket")) for k in range(levels)]))).select("*", "_at.*").drop("_at")
    size = F.col(stop) - F.col(start)
    level = F.lit(levels - 1)
    for k in reversed(range(levels - 1)):
        level = F.when(size < wide[k] * fan, k).otherwise(level)
    s = spans.filter(F.col(start) <= F.col(stop)).withColumn("level", level)
    ends = [F.element_at(F.array(*[bucket(x, k) for k in range(levels)]), F.col("level") + 1) for x in (start, stop)]
    s = s.withColumn("bucket", F.explode(F.sequence(*ends)))
    return p.join(s, [*keys, "level", "bucket"]).filter(F.col(pos).between(F.col(start), F.col(stop))).drop("level", "bucket")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: what inserting into a map leaves."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_match(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order`` (columns or expressions)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def with_parents(model: Model, table: str) -> DataFrame:
    """A table's rows with the names of what they belong to: package_name and
    module_path, and file_name where they are in a file. Equi-joins by foreign
    key; rows without a parent keep null."""
    rows = model.tables[table]
    if "file_path" in rows.columns and table != "files":
        rows = rows.join(model.files.select("import_path", "file_path", F.col("name").alias("file_name")), ["import_path", "file_path"], "left")
    return rows.join(model.packages.select("import_path", F.col("name").alias("package_name"), "module_path"), "import_path", "left")
