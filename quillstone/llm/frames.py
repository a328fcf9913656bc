"""Spark-side helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.batches import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Where it names none and the master is local, as in tests, a temporary
    folder is made; on a cluster that is an error, as no machine would see
    another's.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            conf = known.get()
        elif spark.sparkContext.master.startswith("local"):
            conf = tempfile.mkdtemp(prefix="quillstone-")
            atexit.register(shutil.rmtree, conf, ignore_errors=True)
        else:
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        spark.conf.set("spark.checkpoint.dir", conf)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it again.

    Unlike executor-held blocks the files outlive any lost executor. They are
    removed when the driver ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/quillstone-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """``df`` with its columns numbered, so that no two names can clash, whatever their case."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def _at(df: DataFrame, name: str) -> str:
    """The number of a column: that of exactly this name, or else the one whose name differs by case only."""
    cols = df.columns
    return f"_c{cols.index(name) if name in cols else [c.lower() for c in cols].index(name.lower())}"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns of ``df``, in this order and under these names, for Python in small batches."""
    small_batches(df.sparkSession)
    return flat(df).select(*[F.col(_at(df, n)).alias(n) for n in names])


def with_rows(df: DataFrame, **names: str) -> DataFrame:
    """(row, ...): all columns of ``df`` as one struct, whatever they are called, and some of them beside it under the given names."""
    small_batches(df.sparkSession)
    return flat(df).select(F.struct(*[F.col(f"_c{i}") for i in range(len(df.columns))]).alias("row"), *[F.col(_at(df, c)).alias(n) for n, c in names.items()])


def unpack_row(df: DataFrame, rows: DataFrame, changed: str | None = None, value: Column | None = None) -> DataFrame:
    """The columns of ``df`` out of the structs of :func:`with_rows`, with ``value`` for one of them."""
    at = None if changed is None else _at(df, changed)
    out = rows.select(*[(value if f"_c{i}" == at else F.col("row").getField(f"_c{i}")).alias(f"_c{i}") for i in range(len(df.columns))])
    return out.toDF(*df.columns)


def edit_texts(edit):
    """A column function of (text, edits) that calls ``edit`` where neither is null.

    Hand in a null text for rows that need no edit: Spark evaluates Python
    functions for every row, and so only the nulls travel.
    """

    @F.pandas_udf("string")
    def run(text: pd.Series, edits: pd.Series) -> pd.Series:
        return pd.Series([edit(t, e) if t is not None and e is not None else t for t, e in zip(text, edits, strict=True)], dtype=object)

    return run
