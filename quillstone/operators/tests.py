"""Analysis of test functions: classes, what they test, coverage, patterns, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import is_bdd, is_parallel, is_table_test, log_count, log_tests, lower_first, test_target
from quillstone.operators.joins import prefixes

# Tests are rows (import_path, name, body); functions (import_path, name, is_method, ...).


def classify(tests: DataFrame) -> DataFrame:
    return tests.select("import_path", "name", test_target("name").alias("target"), is_table_test("body").alias("is_table_test"), is_parallel("body").alias("is_parallel"), is_bdd("body").alias("is_bdd"))


def map_tests(tests: DataFrame, functions: DataFrame) -> DataFrame:
    """(import_path, test_name, function_name, tier) for tests that name a function.

    By name (1), then with a small first letter (2), then by the longest
    function name that begins the target whatever the case (3; ties: the
    smallest name). The first two tiers are one equi-join on what the target
    may be called; only tests that it leaves are exploded into prefixes, and
    only to the lengths that the package's function names have.
    """
    t = tests.select("import_path", F.col("name").alias("test_name"), test_target("name").alias("target")).distinct()
    f = functions.select("import_path", F.col("name").alias("function_name")).filter("function_name <> ''").distinct()
    names = F.array(F.struct(F.lit(1).alias("tier"), F.col("target").alias("function_name")), F.struct(F.lit(2).alias("tier"), lower_first("target").alias("function_name")))
    exact = t.select("import_path", "test_name", F.explode(names).alias("c")).select("import_path", "test_name", "c.*").join(f, ["import_path", "function_name"])
    exact = exact.groupBy("import_path", "test_name").agg(F.min(F.struct("tier", "function_name")).alias("c")).select("import_path", "test_name", "c.function_name", "c.tier")
    rest = t.join(exact.select("import_path", "test_name"), ["import_path", "test_name"], "left_anti")
    low = f.withColumn("low", F.lower("function_name"))
    sizes = low.select("import_path", F.length("low").alias("n")).distinct()
    cut = rest.join(sizes, "import_path").filter(F.length(F.lower("target")) >= F.col("n")).select("import_path", "test_name", F.expr("substring(lower(target), 1, n)").alias("low"))
    pairs = cut.join(low, ["import_path", "low"])
    best = pairs.groupBy("import_path", "test_name").agg(F.min(F.struct(-F.length("function_name"), "function_name")).alias("c")).select("import_path", "test_name", "c.function_name", F.lit(3).alias("tier"))
    return exact.unionByName(best).select("import_path", "test_name", "function_name", "tier")


def unmapped(tests: DataFrame, functions: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    m = (map_tests(tests, functions) if mapped is None else mapped).select("import_path", F.col("test_name").alias("name"))
    return tests.select("import_path", "name").join(m, ["import_path", "name"], "left_anti")


def has_benchmark(tests: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Tests for whose target some benchmark's name begins with 'Benchmark' and it."""
    t = tests.select("import_path", "name", test_target("name").alias("target"))
    b = benchmarks.filter(F.col("name").startswith("Benchmark")).select("import_path", F.substr("name", F.lit(10)).alias("_b"))
    # the benchmark is the longer text: its prefixes meet the targets
    cut = b.select("import_path", prefixes("_b", "target")).distinct()
    return t.join(cut.withColumn("has_benchmark", F.lit(True)), ["import_path", "target"], "left").select("import_path", "name", F.coalesce("has_benchmark", F.lit(False)).alias("has_benchmark"))


def testable(functions: DataFrame) -> DataFrame:
    return functions.filter(~F.col("name").rlike("^(Test|Benchmark)") & ~F.col("is_method"))


def missing_tests(tests: DataFrame, functions: DataFrame) -> DataFrame:
    """Testable functions that no test is mapped to."""
    covered = map_tests(tests, functions).select("import_path", F.col("function_name").alias("name")).distinct()
    return testable(functions).select("import_path", "name").distinct().join(covered, ["import_path", "name"], "left_anti")


def test_summary(tests: DataFrame, benchmarks: DataFrame, functions: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """By package: counts, tested functions, and coverage in per cent of the testable ones.

    Tested functions may include methods, as mapping looks at all functions;
    coverage can then pass 100.
    """
    c = classify(tests).groupBy("import_path").agg(F.count("*").alias("total_tests"), F.count_if("is_table_test").alias("table_tests"), F.count_if("is_parallel").alias("parallel_tests"))
    b = benchmarks.groupBy("import_path").agg(F.count("*").alias("benchmarks"))
    m = (map_tests(tests, functions) if mapped is None else mapped).groupBy("import_path").agg(F.countDistinct("function_name").alias("tested"))
    n = testable(functions).groupBy("import_path").agg(F.countDistinct("name").alias("testable"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
    j = c.join(b, "import_path", "full").join(m, "import_path", "full").join(n, "import_path", "full")
    j = j.select("import_path", *[zero(x) for x in ("total_tests", "table_tests", "parallel_tests", "benchmarks", "tested", "testable")])
    cover = F.when(F.col("testable") > 0, F.round(F.col("tested") / F.col("testable") * 100.0, 6)).otherwise(F.lit(0.0))
    return j.withColumn("coverage", cover)


def test_patterns(tests: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Patterns with how many tests have them and the first three by name; none without tests."""
    c = classify(tests).join(has_benchmark(tests, benchmarks), ["import_path", "name"])
    kinds = [("Table-Driven Tests", "is_table_test"), ("Parallel Tests", "is_parallel"), ("Functions with Benchmarks", "has_benchmark"), ("BDD-Style Tests", "is_bdd")]
    one = F.explode(F.array_compact(F.array(*[F.when(F.col(k), F.lit(n)) for n, k in kinds])))
    flat = c.select("name", "import_path", one.alias("pattern"))
    w = Window.partitionBy("pattern").orderBy("name", "import_path")
    top = flat.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").groupBy("pattern").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]), ",").alias("examples"))
    return flat.groupBy("pattern").agg(F.count("*").alias("n_tests")).join(top, "pattern")


def package_report(tests: DataFrame, benchmarks: DataFrame, functions: DataFrame, include_tests: bool = True) -> dict[str, DataFrame]:
    """All of the above for a package, the mapping worked out once; empty results where tests are left out."""
    if not include_tests:
        tests, benchmarks = tests.filter("false"), benchmarks.filter("false")
    m = map_tests(tests, functions).persist()
    return {"tests": classify(tests), "map": m, "unmapped": unmapped(tests, functions, m), "summary": test_summary(tests, benchmarks, functions, m), "patterns": test_patterns(tests, benchmarks)}


def report_lines(tests: DataFrame, benchmarks: DataFrame, functions: DataFrame) -> DataFrame:
    """(import_path, part, name, value): the package reports as one table."""
    r = package_report(tests, benchmarks, functions)
    total = r["summary"].select("import_path", F.explode(F.create_map(*[x for c in ("total_tests", "table_tests", "parallel_tests", "benchmarks", "tested", "testable") for x in (F.lit(c), F.col(c))])).alias("name", "n"))
    mapped = r["map"].select("import_path", F.lit("map").alias("part"), F.col("test_name").alias("name"), F.col("function_name").alias("value"))
    return total.select("import_path", F.lit("summary").alias("part"), "name", F.col("n").cast("string").alias("value")).unionByName(mapped).unionByName(r["unmapped"].select("import_path", F.lit("unmapped").alias("part"), "name", F.lit("").alias("value")))


def parse_logs(logs: DataFrame, output: str = "output") -> DataFrame:
    """Names in order of appearance, passed and failed, for each log."""
    return logs.select(*[c for c in logs.columns if c != output], F.array_join(log_tests(output), ",").alias("tests"), log_count(output, "PASS").cast("long").alias("passed"), log_count(output, "FAIL").cast("long").alias("failed"))
