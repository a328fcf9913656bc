"""Method receivers, common methods and interface candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import is_pointer, normalize_receiver

# In this module methods are rows (receiver_type, name, signature), receiver_type with its '*'.


def receivers_of(functions: DataFrame) -> DataFrame:
    """Methods of a function table, with one spelling of the receiver: '*' where it is a pointer."""
    r = F.col("receiver")
    t = F.when(r["is_pointer"] & ~r["type"].startswith("*"), F.concat(F.lit("*"), r["type"])).otherwise(r["type"])
    return functions.filter(r.isNotNull()).select("import_path", t.alias("receiver_type"), "name", "signature", "func_key")


def group_receivers(methods: DataFrame) -> DataFrame:
    """A row for each receiver type: base type, pointer or not, its methods."""
    g = methods.groupBy("receiver_type").agg(F.count("*").alias("n_methods"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("methods"))
    return g.select("receiver_type", normalize_receiver("receiver_type").alias("base_type"), is_pointer("receiver_type").alias("is_pointer"), "n_methods", "methods")


def receiver_summary(methods: DataFrame) -> DataFrame:
    g = methods.groupBy("receiver_type").agg(F.count("*").alias("n"))
    p = is_pointer("receiver_type")
    return g.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_methods"),
        F.count("*").alias("receiver_types"),
        F.coalesce(F.sum(F.when(p, F.col("n"))), F.lit(0)).alias("pointer_methods"),
        F.coalesce(F.sum(F.when(~p, F.col("n"))), F.lit(0)).alias("value_methods"),
    )


def methods_per_type(methods: DataFrame) -> DataFrame:
    return methods.groupBy("receiver_type").agg(F.count("*").alias("n_methods"))


def base_type_groups(methods: DataFrame) -> DataFrame:
    """Pointer and value receivers of one type together."""
    return methods.groupBy(normalize_receiver("receiver_type").alias("base_type")).agg(F.count("*").alias("n_methods"))


def common_methods(methods: DataFrame) -> DataFrame:
    """(name, signature, receiver_type) of name and signature over more than one receiver type.

    A row for each type, so that a method that every type has is as many rows,
    not one that grows. Which are common is told by the least and the greatest
    type, collapsed before the exchange.
    """
    common = methods.groupBy("name", "signature").agg((F.min("receiver_type") != F.max("receiver_type")).alias("common")).filter("common").select("name", "signature")
    return methods.select("name", "signature", "receiver_type").distinct().join(common, ["name", "signature"], "left_semi")


def common_by_name(methods: DataFrame) -> DataFrame:
    """(name, signature, n_types) of the common methods, one group a name: that of most types, then of the smallest signature."""
    n = methods.select("name", "signature", "receiver_type").distinct().groupBy("name", "signature").agg(F.count("*").alias("n_types")).filter("n_types > 1")
    best = F.min_by(F.struct("signature", "n_types"), F.struct(-F.col("n_types"), "signature"))
    return n.groupBy("name").agg(best.alias("b")).select("name", "b.signature", "b.n_types")


def listed(rows: DataFrame, keys: list[str], of: str, name: str) -> DataFrame:
    """Sorted lists of ``of`` by key: for a report on few rows, as each list is one row."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(of)).alias(name))


def method_signatures(methods: DataFrame, receiver_type: str) -> DataFrame:
    """name and signature of one receiver type; the last by signature where a name repeats."""
    return methods.filter(F.col("receiver_type") == receiver_type).groupBy("name").agg(F.max("signature").alias("signature"))


def both_of(methods: DataFrame, first: str, second: str) -> DataFrame:
    """Receiver types that have both methods, with their signatures: one grouping, no self-join."""
    g = methods.filter(F.col("name").isin(first, second)).groupBy("receiver_type")
    sig = lambda n: F.max(F.when(F.col("name") == n, F.col("signature")))
    return g.agg(sig(first).alias("first_signature"), sig(second).alias("second_signature")).filter("first_signature IS NOT NULL AND second_signature IS NOT NULL")


def extract_interfaces(methods: DataFrame, first: str = "Read", second: str = "Write") -> DataFrame:
    """Candidates (interface_name, methods 'name signature' joined, source_type), a row for each source type.

    Where more than one type has both ``first`` and ``second``, these two make
    one interface, with the signatures of its least type; every other common
    method makes one of its own.
    """
    pair = both_of(methods, first, second)
    joint = pair.agg(F.count("*").alias("n"), F.min_by(F.struct("first_signature", "second_signature"), "receiver_type").alias("s")).filter("n > 1")  # one row
    line = lambda n, s: F.concat(F.lit(n), F.col(s))
    rw = pair.select("receiver_type").join(F.broadcast(joint)).select(F.lit(first + second + ("r" if second.endswith("e") else "er")).alias("interface_name"), F.concat_ws("; ", line(first, "s.first_signature"), line(second, "s.second_signature")).alias("methods"), F.col("receiver_type").alias("source_type"))
    has = joint.agg((F.count("*") > 0).alias("has_pair"))
    best = common_by_name(methods).join(F.broadcast(has)).filter(~(F.col("has_pair") & F.col("name").isin(first, second))).select("name", "signature")
    single = methods.select("name", "signature", "receiver_type").distinct().join(best, ["name", "signature"], "left_semi")
    return rw.unionByName(single.select(F.concat("name", F.lit("er")).alias("interface_name"), F.concat("name", "signature").alias("methods"), F.col("receiver_type").alias("source_type")))


def intersect_keep(first: str, second: str):
    """Elements of the second array that the first has, order and repeats kept."""
    return F.filter(F.col(second), lambda x: F.array_contains(F.col(first), x))
