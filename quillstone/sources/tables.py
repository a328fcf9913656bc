"""Adapters: star-schema and text tables seen as tables of the code model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import upper_first
from quillstone.schema import DDL, Model, filled, rows

SUFFIX = ("Reader", "Writer", "Handler", "Processor", "Service", "Controller", "Impl")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as types; the nation of the customer, in its region, is the package."""
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("o_orderkey")
    return (
        read(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderpriority")
        .join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("/", F.lower("r_name"), F.lower("n_name")).alias("import_path"),
            F.concat(F.when(k % 3 == 0, "svc").otherwise("Svc"), k.cast("string"), _pick(k, SUFFIX)).alias("name"),
            F.when(k % 4 == 0, "interface").when(k % 4 == 1, "type").otherwise("struct").alias("kind"),
            (k % 3 != 0).alias("is_exported"),
            k.alias("type_id"),
            F.col("o_orderpriority").alias("doc"),
        )
    )


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as methods: the order is the receiver, the part's kind the name."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    k = F.col("l_orderkey")
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            k.alias("type_id"),
            F.concat(F.when(k % 3 == 0, "*").otherwise(""), F.lit("T"), k.cast("string")).alias("receiver_type"),
            F.when(F.col("p_type") == "SMALL", "Read").when(F.col("p_type") == "LARGE", "Write").otherwise(F.col("p_type")).alias("name"),
            F.when(F.col("p_size") < 35, "(x int) error").otherwise("(x string) error").alias("signature"),
        )
        .distinct()
    )


def typed_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods with package and type name."""
    t = types(spark, sf_dir).select("type_id", "import_path", F.col("name").alias("type_name"))
    return methods(spark, sf_dir).join(t, "type_id")


def _part_name() -> Column:
    return F.replace(F.col("p_name"), F.lit(" "), F.lit(""))


def _part_package() -> Column:
    return F.concat_ws("/", F.lower("p_type"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))))


def _number(n: Column) -> Column:
    return (n % 7).cast("string")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions; type and brand are the package, one in five is a method."""
    k, size = F.col("p_partkey"), F.col("p_size")
    n = F.concat(_part_name(), _number(size))
    return read(spark, sf_dir, "part").select(
        _part_package().alias("import_path"),
        F.concat(_part_package(), F.lit("/f"), (size % 5).cast("string"), F.lit(".go")).alias("file_path"),
        k.alias("ord"),
        F.when(k % 2 == 0, upper_first(n)).otherwise(n).alias("name"),
        (k % 2 == 0).alias("is_exported"),
        (size % 5 == 0).alias("is_method"),
        F.when(size % 3 == 0, "").otherwise(F.col("p_brand")).alias("doc"),
        "p_size",
    )


BODIES = ("testCases := []struct{ name string }{}", "t.Parallel()", "given := 1 // when then", "x := 1", "cases := map[string]int{}\nt.Parallel()", "assert(x)")


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tests, numbered otherwise than functions, so that some test nothing."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.lit("Test"), upper_first(_part_name()), _number(size * 3 + 1), F.when(size % 4 == 0, "Success").when(size % 4 == 1, "Zzz").otherwise(""))
    name = F.when(size % 13 == 0, F.lit("TestNothing")).otherwise(name)
    rows = read(spark, sf_dir, "part").select(_part_package().alias("import_path"), name.alias("name"), _pick(k, BODIES).alias("body"))
    return rows.groupBy("import_path", "name").agg(F.min("body").alias("body"))


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Benchmark"), upper_first(_part_name()), _number(F.col("p_size") * 5 + 2))
    return read(spark, sf_dir, "part").select(_part_package().alias("import_path"), name.alias("name")).distinct()


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as variables; a market segment is a package, 50 names in each."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.lower("c_mktsegment").alias("import_path"), F.concat(F.lit("f"), (k % 10).cast("string"), F.lit(".go")).alias("file_path"), k.alias("ord"),
        F.concat(F.when(k % 2 == 0, "V").otherwise("v"), (k % 50).cast("string")).alias("name"), F.lower("c_mktsegment").alias("type"), k.cast("string").alias("value"), (k % 2 == 0).alias("is_exported"), F.lit("").alias("doc"),
    )


def elements(spark: SparkSession, sf_dir: str, block: int = 256) -> DataFrame:
    """Documents as elements one after another; a source is a file.

    Positions are running sums in two levels: within blocks of neighbouring
    ids, and over the blocks' sums, so that no task holds a whole source.
    """
    from pyspark.sql import Window

    d = F.col("doc_id")
    kind = _pick(d, ("type", "function", "variable", "constant", "import"))
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars")).withColumn("block", F.floor(d / block))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("source", "block").agg(F.sum("n_chars").alias("n")).select("source", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(blocks, ["source", "block"]).withColumn("before", F.col("base") + F.coalesce(F.sum("n_chars").over(within), F.lit(0)))
    return rows.select(F.col("source").alias("file_path"), d.alias("ord"), kind.alias("kind"), d.cast("string").alias("name"), (F.col("before") + 1).alias("start_pos"), (F.col("before") + F.col("n_chars") + 200).alias("end_pos"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(e.alias("probe"), F.concat(F.lit("src"), (e % 20).cast("string")).alias("file_path"), (e * 37 + 1).alias("pos"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a test log, in order of event."""
    word = upper_first("event_type")
    line = F.concat(F.lit("--- "), F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS"), F.lit(": Test"), word, F.col("event_id").cast("string"), F.lit(" (0.00s)"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", line.alias("line"))))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(rows.alias("r")).select("user_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("output"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    return read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), (p % 10).cast("string")).alias("import_path"), p.alias("ord"), F.regexp_extract("url", "https?://([^/]+)", 1).alias("path"), F.when(p % 4 == 0, "_").when(p % 4 == 1, "alias").otherwise("").alias("name"), (p % 4 == 0).alias("is_blank"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("mod/"), F.col("o_orderpriority")).alias("path"), F.concat(F.lit("v"), (F.col("o_custkey") % 10).cast("string")).alias("version"), (F.col("o_orderstatus") == "P").alias("indirect")).distinct()


def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as constants; a nation is a file of its package."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("nations/n"), (F.col("s_nationkey") % 5).cast("string")).alias("import_path"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".go")).alias("file_path"), k.cast("int").alias("ord"),
        F.concat(F.when(k % 3 == 0, "C").otherwise("c"), k.cast("string")).alias("name"), F.when(k % 2 == 0, "int").otherwise("").alias("type"), (k * 7).cast("string").alias("value"), (k % 3 == 0).alias("is_exported"), F.when(k % 4 == 0, "A constant\nof two lines").otherwise("").alias("doc"),
    )


def model(spark: SparkSession, sf_dir: str) -> Model:
    """The tables as one module of whole source files: types with their place, functions, values."""
    zero = F.lit(0).cast("long")
    place = F.concat(F.lit("t"), (F.col("type_id") % 10).cast("string"), F.lit(".go"))
    t = types(spark, sf_dir).select("import_path", place.alias("file_path"), F.col("type_id").cast("int").alias("ord"), "name", "kind", F.when(F.col("kind") == "type", "string").otherwise("").alias("underlying"), "is_exported", "doc", zero.alias("start_pos"), zero.alias("end_pos"))
    f = functions(spark, sf_dir).filter("NOT is_method")
    f = f.select("import_path", "file_path", F.col("ord").cast("int").alias("ord"), F.col("name").alias("func_key"), "name", F.lit("(x int) error").alias("signature"), F.lit("\treturn nil\n").alias("body"), "doc", "is_exported", "is_method")
    v = variables(spark, sf_dir).select("import_path", "file_path", F.col("ord").cast("int").alias("ord"), "name", "type", "value", "is_exported", "doc")
    c = constants(spark, sf_dir)
    found = {"types": filled(t, "types"), "functions": filled(f, "functions"), "variables": filled(v, "variables"), "constants": filled(c, "constants")}
    files = reduce(DataFrame.unionByName, [df.select("import_path", "file_path") for df in found.values()]).distinct()
    found["files"] = filled(files.withColumn("name", F.substring_index("file_path", "/", -1)), "files")
    last = F.regexp_replace(F.substring_index("import_path", "/", -1), "[^0-9A-Za-z_]", "")
    found["packages"] = filled(files.select("import_path").distinct().select(F.lit("demo").alias("module_path"), "import_path", last.alias("name"), F.concat(F.lit("About "), "import_path").alias("documentation")), "packages")
    d = dependencies(spark, sf_dir).select(F.lit("demo").alias("module_path"), F.lit(0).alias("ord"), F.concat_ws("@", "path", "version", F.col("indirect").cast("string")).alias("path"), "version", "indirect")
    found["dependencies"] = filled(d, "dependencies")
    found["modules"] = rows(spark, "modules", [{"module_path": "demo", "go_version": "1.23"}])
    return Model({k: found[k] if k in found else rows(spark, k) for k in DDL})
