"""Structure summaries, lookups and walk counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import is_exported


def structure_summary(types: DataFrame) -> DataFrame:
    """Types by package and kind: all, and the exported ones."""
    return types.groupBy("import_path", "kind").agg(F.count("*").alias("total"), F.count_if("is_exported").alias("exported"))


def exported_names(types: DataFrame, include_private: bool = False) -> DataFrame:
    """The listing of a package: exported declarations, or all with a mark."""
    kept = types if include_private else types.filter("is_exported")
    mark = F.when(F.col("is_exported"), "").otherwise(" (unexported)")
    return kept.select("import_path", "name", F.concat_ws(" ", "name", F.concat(F.col("kind"), mark)).alias("line"))


def interfaces(types: DataFrame) -> DataFrame:
    """Interfaces with their implementors, of which none are searched for: an empty list."""
    return types.filter("kind = 'interface'").select("import_path", "name", F.lit("").alias("implementors"))


def find_by_full_name(table: DataFrame, full_name: str) -> DataFrame:
    """The row whose 'import_path.name' is the given one; the first by order where several are."""
    split = full_name.rfind(".")
    path, name = full_name[: max(split, 0)], full_name[split + 1 :]
    # equality on the columns themselves reaches the scan, unlike one on their concatenation
    found = table.filter((F.col("import_path") == path) & (F.col("name") == name))
    order = [c for c in ("file_path", "ord", "type_id") if c in table.columns]
    return found.orderBy(*order).limit(1) if order else found.limit(1)


def find_by_name(table: DataFrame, import_path: str, name: str) -> DataFrame:
    return table.filter((F.col("import_path") == import_path) & (F.col("name") == name))


def associate_methods(functions: DataFrame, types: DataFrame) -> DataFrame:
    """Methods with the type of their package that they belong to; others are dropped."""
    m = functions.filter("is_method").withColumn("type_name", F.regexp_replace("receiver_type", r"^\*", ""))
    t = types.select("import_path", F.col("name").alias("type_name"))
    return m.join(t, ["import_path", "type_name"])


def types_without_methods(types: DataFrame, methods: DataFrame, key: str) -> DataFrame:
    return types.join(methods.select(key).distinct(), key, "left_anti")


def walk_counts(types: DataFrame, fields: DataFrame, methods: DataFrame, functions: DataFrame, variables: DataFrame, constants: DataFrame, imports: DataFrame, include_private: bool = False) -> DataFrame:
    """How many elements of each kind a walk over loose tables visits under its
    default filters; :mod:`quillstone.render.walk` walks whole models."""
    private = F.lit(include_private)
    seen = [
        ("type", types.filter(F.col("is_exported") | private)),
        ("field", fields.filter((F.col("name") == "") | is_exported("name") | private)),
        ("method", methods.filter(~F.col("is_interface_method")).filter(is_exported("name") | private)),
        ("function", functions.filter((F.col("is_exported") | private) & ~F.col("is_method"))),
        ("variable", variables.filter(F.col("is_exported") | private)),
        ("constant", constants.filter(F.col("is_exported") | private)),
        ("import", imports),
    ]
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("visits")).select(F.lit(k).alias("kind"), "visits") for k, df in seen])


def visible(table: DataFrame, include_tests: bool = False, include_generated: bool = False) -> DataFrame:
    """Test and generated files or packages out, unless asked for."""
    for c, keep in (("is_test", include_tests), ("is_generated", include_generated)):
        if c in table.columns and not keep:
            table = table.filter(~F.col(c))
    return table
