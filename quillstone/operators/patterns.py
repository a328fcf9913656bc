"""Method patterns over types, and the interfaces extracted from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import interface_name, signature_name, signature_rest
from quillstone.schema import Model, filled


@dataclass(frozen=True)
class Options:
    """method_threshold is accepted and has no effect: patterns match wholly."""

    minimum_types: int = 2
    minimum_methods: int = 1
    method_threshold: float = 0.8
    exclude_packages: tuple[str, ...] = ()
    exclude_types: tuple[str, ...] = ()
    exclude_methods: tuple[str, ...] = ()
    target_package: str = ""
    create_new_files: bool = False
    naming: object = field(default=interface_name)  # (types, signatures) -> Column


def without(df: DataFrame, options: Options) -> DataFrame:
    """Excluded packages, types and methods out."""
    for c, names in (("import_path", options.exclude_packages), ("type_name", options.exclude_types), ("name", options.exclude_methods)):
        if names:
            df = df.filter(~F.col(c).isin(*names))
    return df


def method_patterns(methods: DataFrame, options: Options = Options()) -> DataFrame:
    """(signatures, types) of types that have the same set of methods.

    methods: (import_path, type_name, name, signature). Two exchanges: by type,
    then by signature list (an array, so no separator can clash).
    """
    by_type = without(methods, options).groupBy("import_path", "type_name").agg(F.array_sort(F.collect_set(F.concat("name", "signature"))).alias("signatures"))
    groups = by_type.groupBy("signatures").agg(F.array_sort(F.collect_list(F.struct("import_path", "type_name"))).alias("owners"))
    return groups.filter((F.size("owners") >= options.minimum_types) & (F.size("signatures") >= options.minimum_methods))


def named_patterns(methods: DataFrame, options: Options = Options(), packages: DataFrame | None = None) -> DataFrame:
    """Patterns with interface name and target package.

    packages: rows with import_path among which the wanted target is looked
    up; those of ``methods`` where none are given.
    """
    p = method_patterns(methods, options).withColumn("types", F.col("owners.type_name"))
    first: Column = F.get("owners", F.lit(0))["import_path"]
    target = first
    if options.target_package:  # only where a package of that path exists
        known = (methods if packages is None else packages).filter(F.col("import_path") == options.target_package).agg((F.count("*") > 0).alias("_known"))
        p = p.crossJoin(F.broadcast(known))
        target = F.when(F.col("_known"), F.lit(options.target_package)).otherwise(first)
    return p.select("signatures", "owners", "types", options.naming(F.col("types"), F.col("signatures")).alias("interface_name"), target.alias("target_package"))


def new_interfaces(methods: DataFrame, types: DataFrame, options: Options = Options(), packages: DataFrame | None = None) -> DataFrame:
    """Named patterns whose package has no interface of that name yet."""
    have = types.filter("kind = 'interface'").select(F.col("import_path").alias("target_package"), F.col("name").alias("interface_name"))
    p = named_patterns(methods, options, packages).join(have, ["target_package", "interface_name"], "left_anti")
    # patterns that come to one name in one package: the widest makes it
    key = F.struct(-F.size("owners"), F.col("signatures"))
    return p.groupBy("target_package", "interface_name").agg(F.min_by(F.struct("signatures", "owners"), key).alias("p")).select("target_package", "interface_name", "p.signatures", "p.owners")


def extract(model: Model, options: Options = Options()) -> Model:
    """The model with the extracted interfaces added as types and interface methods."""
    structs = model.types.filter("kind = 'struct'").select("import_path", F.col("name").alias("type_name"))
    own = model.methods.filter("NOT is_interface_method").join(structs, ["import_path", "type_name"])
    new = new_interfaces(own, model.types, options, model.packages)
    home = model.types.select("import_path", F.col("name").alias("type_name"), "file_path")
    first = new.select("*", F.get("owners", F.lit(0)).alias("o")).join(home.select(F.struct("import_path", "type_name").alias("o"), "file_path"), "o", "left")
    path = F.concat("target_package", F.lit("/"), F.lower("interface_name"), F.lit(".go")) if options.create_new_files else F.coalesce("file_path", F.lit(""))
    doc = F.concat("interface_name", F.lit(" is an interface extracted from "), F.size("owners").cast("string"), F.lit(" implementing types."))
    # behind the last declaration of its file
    last = model.types.groupBy(F.col("import_path").alias("target_package"), F.col("file_path").alias("_path")).agg((F.max("ord") + 1).alias("_next"))
    first = first.withColumn("_path", path).join(last, ["target_package", "_path"], "left")
    added = first.select(F.col("target_package").alias("import_path"), F.col("_path").alias("file_path"), F.coalesce("_next", F.lit(0)).alias("ord"), F.col("interface_name").alias("name"), F.lit("interface").alias("kind"), F.lit("").alias("underlying"), F.lit(True).alias("is_exported"), doc.alias("doc"), F.lit(0).cast("long").alias("start_pos"), F.lit(0).cast("long").alias("end_pos"))
    sigs = new.select(F.col("target_package").alias("import_path"), F.col("interface_name").alias("type_name"), F.posexplode("signatures").alias("ord", "s"))
    lines = sigs.select("import_path", "type_name", "ord", signature_name("s").alias("name"), signature_rest("s").alias("signature"), F.lit(False).alias("is_embedded"), F.lit(True).alias("is_interface_method"), F.lit("").alias("doc"))
    out = model.add("types", added).add("methods", lines)
    changed = added.select("import_path", "file_path").distinct().withColumn("_hit", F.lit(True))
    marked = out.files.join(changed, ["import_path", "file_path"], "left").withColumn("is_modified", F.col("is_modified") | F.coalesce("_hit", F.lit(False)))
    out = out.with_tables(files=filled(marked, "files"))
    if options.create_new_files:
        files = added.select("import_path", "file_path", F.substring_index("file_path", "/", -1).alias("name"), F.lit("").alias("source_code"), F.lit(False).alias("is_test"), F.lit(False).alias("is_generated"), F.lit(True).alias("is_modified"))
        out = out.add("files", files)
    return out
