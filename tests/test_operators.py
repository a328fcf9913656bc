"""Operators on small hand-made models."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillstone import functions as fn
from quillstone.operators import joins, patterns, positions, receivers, structure, transform
from quillstone.operators import tests as testing
from quillstone.render import markup, scaffold
from quillstone.schema import Model, rows

METHODS = [("*User", "Login", "(p string) error"), ("User", "Name", "() string"), ("*Admin", "Login", "(p string) error"), ("Guest", "Name", "() string"), ("Guest", "Login", "(p string) error")]


@pytest.fixture(scope="module")
def methods(spark):
    return spark.createDataFrame(METHODS, "receiver_type string, name string, signature string")


def got(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["import_path", "kind", "total", "exported"]
    assert df.count() > 0


def test_receivers(methods):
    g = got(receivers.group_receivers(methods))
    assert ("*User", "User", True, 1, "Login") in g and ("Guest", "Guest", False, 2, "Login,Name") in g
    assert tuple(receivers.receiver_summary(methods).first()) == (5, 4, 2, 3)
    assert got(receivers.base_type_groups(methods)) == [("Admin", 1), ("Guest", 2), ("User", 2)]
    assert got(receivers.listed(receivers.common_methods(methods), ["name", "signature"], "receiver_type", "types")) == [("Login", "(p string) error", ["*Admin", "*User", "Guest"]), ("Name", "() string", ["Guest", "User"])]
    assert got(receivers.common_by_name(methods)) == [("Login", "(p string) error", 3), ("Name", "() string", 2)]
    assert receivers.common_methods(methods.limit(0)).count() == 0


def test_read_writer(spark):
    both = [(t, n, "(b []byte) (int, error)") for t in ("A", "B", "C") for n in ("Read", "Write")] + [(t, "Close", "() error") for t in ("A", "B")]
    out = got(receivers.extract_interfaces(spark.createDataFrame(both, "receiver_type string, name string, signature string")))
    assert [(x[0], x[2]) for x in out] == [("Closeer", "A"), ("Closeer", "B"), ("ReadWriter", "A"), ("ReadWriter", "B"), ("ReadWriter", "C")]


def test_prefixes_meet_as_begins_with(spark):
    left = spark.createDataFrame([(x,) for x in ("", "a", "ab", "abc", "b", "é")], "t string")
    right = spark.createDataFrame([(x,) for x in ("", "a", "ab", "x", "é")], "f string")
    naive = left.join(right, F.col("t").startswith(F.col("f")))
    assert got(left.select("t", joins.prefixes("t", "f")).join(right, "f"), "t", "f") == got(naive, "t", "f")


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_interval_join_is_naive(spark, width):
    spans = spark.createDataFrame([("f", i, i * 5, i * 5 + (i * 7) % 23) for i in range(40)] + [("f", 99, 9, 3)], "file string, id int, a long, b long")
    probes = spark.createDataFrame([("f", i) for i in range(0, 230, 3)] + [("g", 5)], "file string, pos long")
    spans = spans.union(spark.createDataFrame([("f", 100, -7, 10**12), ("f", 101, 3, 180)], spans.schema))
    naive = probes.join(spans, "file").filter("pos BETWEEN a AND b")
    assert got(joins.interval_join(probes, "pos", spans, "a", "b", ["file"], width, 4, 20), "pos", "id") == got(naive, "pos", "id")


def test_element_priority(spark):
    e = spark.createDataFrame([("f", "function", 1, "g", 1, 50), ("f", "type", 2, "T", 10, 20), ("f", "type", 3, "U", 10, 20), ("f", "type", 4, "none", 0, 90)], "file string, kind string, ord int, name string, start_pos long, end_pos long")
    p = spark.createDataFrame([(1, "f", 15), (2, "f", 5), (3, "f", 99)], "probe int, file string, pos long")
    assert got(positions.element_at(p, "pos", e, ["file"]), "probe", "name") == [(1, "T"), (2, "g")]


def test_line_columns(spark):
    df = spark.createDataFrame([("ab\ncd", 1), ("ab\ncd", 3), ("ab\ncd", 4), ("ab\ncd", 5)], "t string, p long")
    line, col = positions.line_column_in_text("t", "p")
    assert [tuple(r) for r in df.select(line, col).collect()] == [(1, 1), (1, 3), (2, 1), (2, 2)]
    line, col = positions.line_column("p", F.array(F.lit(1), F.lit(4)))
    assert [tuple(r) for r in df.select(line, col).collect()] == [(1, 1), (1, 3), (2, 1), (2, 2)]


def test_mapping_tiers(spark):
    tests = spark.createDataFrame([("p", f"Test{x}", "t.Parallel()") for x in ("Add", "Sub", "AddMany", "Other")], "import_path string, name string, body string")
    funcs = spark.createDataFrame([("p", "Add", False), ("p", "sub", False), ("p", "addM", False), ("p", "Lone", False), ("p", "Meth", True)], "import_path string, name string, is_method boolean")
    assert got(testing.map_tests(tests, funcs), "test_name", "function_name", "tier") == [("TestAdd", "Add", 1), ("TestAddMany", "addM", 3), ("TestSub", "sub", 2)]
    assert got(testing.unmapped(tests, funcs), "name") == [("TestOther",)]
    assert got(testing.missing_tests(tests, funcs), "name") == [("Lone",)]
    bench = spark.createDataFrame([("p", "BenchmarkAddFast")], "import_path string, name string")
    assert got(testing.has_benchmark(tests, bench).filter("has_benchmark"), "name") == [("TestAdd",)]
    assert testing.test_summary(tests, bench, funcs).first().coverage == 75.0


def test_table_regex(spark):
    df = spark.createDataFrame([("tests := []struct{}{}",), ("testCases := []int{}",), ("cases := map[string]int{}",), ("cases émap",), ("x := 1",)], "b string")
    assert [r[0] for r in df.select(fn.is_table_test("b")).collect()] == [False, True, True, True, False]


def _model(spark):
    t = [{"import_path": "m/a", "file_path": "a.go", "ord": i, "name": n, "kind": "struct", "is_exported": True} for i, n in enumerate(("FileReader", "BufferReader", "Lone"))]
    m = [{"import_path": "m/a", "type_name": n, "name": x, "signature": "() error"} for n in ("FileReader", "BufferReader") for x in ("Close", "Read")] + [{"import_path": "m/a", "type_name": "Lone", "name": "Run", "signature": "()"}]
    v = [{"import_path": "m/a", "file_path": "a.go", "ord": 1, "name": "old", "type": "int", "value": "1"}, {"import_path": "m/b", "file_path": "b.go", "ord": 1, "name": "other"}]
    return Model.of(spark, types=t, methods=m, variables=v, files=[{"import_path": "m/a", "file_path": "a.go"}, {"import_path": "m/b", "file_path": "b.go"}], packages=[{"import_path": "m/a"}])


def test_extract(spark):
    model = _model(spark)
    out = patterns.extract(model, patterns.Options(create_new_files=True))
    assert got(out.types.filter("kind = 'interface'"), "name", "file_path", "doc") == [("Reader", "m/a/reader.go", "Reader is an interface extracted from 2 implementing types.")]
    assert got(out.methods.filter("is_interface_method"), "name", "signature") == [("Close", "() error"), ("Read", "() error")]
    assert out.files.count() == model.files.count() + 1
    again = patterns.extract(out)
    assert again.types.filter("kind = 'interface'").count() == 1  # there already
    assert patterns.extract(model, patterns.Options(exclude_types=("FileReader",))).types.count() == 3


def test_rename(spark):
    model = _model(spark)
    out, r = transform.rename_variable("old", "New")(model)
    assert r.success and got(r.files) == [("a.go",)]
    assert got(out.variables, "name", "is_exported") == [("New", True), ("other", False)]
    assert got(out.files.filter("is_modified"), "file_path") == [("a.go",)]
    same, dry = transform.rename_variable("old", "New", dry_run=True)(model)
    assert same is model and dry.changes.count() == 1
    assert not transform.rename_variable("none", "x")(model)[1].success
    out, r = transform.chain(transform.rename_variable("old", "mid"), transform.rename_variable("none", "x"), transform.rename_variable("mid", "end"))(model)
    assert not r.success and got(out.variables, "name") == [("mid",), ("other",)]


def test_lookup_and_walk(spark):
    model = _model(spark)
    assert structure.find_by_full_name(model.types, "m/a.Lone").count() == 1
    assert structure.find_by_full_name(model.types, "Lone").count() == 0
    counts = dict(got(structure.walk_counts(model.types, model.fields, model.methods, model.functions, model.variables, model.constants, model.imports)))
    assert counts == {"type": 3, "field": 0, "method": 5, "function": 0, "variable": 0, "constant": 0, "import": 0}


def test_renderers(spark):
    df = spark.createDataFrame([("m/a", "T", "struct", "A <doc>")], "p string, n string, k string, d string")
    assert df.select(markup.markdown_type("n", "k", "d")).first()[0] == "### Type: T (struct)\n\nA <doc>\n\n```go\ntype T struct\n```\n\n"
    html = df.select(markup.html_type("p", "n", "k", "d")).first()[0]
    assert 'id="m-a-t"' in html and "A &lt;doc&gt;" in html
    for kind in (*scaffold.KINDS, "unknown"):
        text = df.select(scaffold.scaffold("n", F.lit(True), F.lit(True), kind)).first()[0]
        assert text.startswith("func TestT(t *testing.T) {\n") and text.endswith("}\n") and text.count("{") == text.count("}")


SHAPES = [
    ("None", [], [], "()", ""), ("In", [("a", "int", False)], [], "(a int)", ""), ("Out", [], [("", "error", False)], "() error", "error"), ("Both", [("a", "int", False), ("b", "string", False)], [("", "bool", False)], "(a int, b string) bool", "bool"),
    ("Many", [], [("", "int", False), ("", "error", False)], "() (int, error)", "(int, error)"), ("Dots", [("a", "int", True)], [], "(a ...int)", ""), ("Named", [], [("n", "int", False), ("err", "error", False)], "() (n int, err error)", "(n int, err error)"), ("One", [], [("n", "int", False)], "() n int", "int"),
]


def test_signatures_and_scaffolds(spark):
    p = lambda xs: [{"name": a, "type": b, "is_variadic": c} for a, b, c in xs]
    f = rows(spark, "functions", [{"import_path": "p", "name": n, "func_key": n, "parameters": p(i), "results": p(o)} for n, i, o, _, _ in SHAPES])
    got_ = {r.name: (r.s, r.t) for r in f.select("name", fn.signature("parameters", "results").alias("s"), fn.return_type("results").alias("t")).collect()}
    assert got_ == {n: (s, t) for n, _, _, s, t in SHAPES}
    tests = spark.createDataFrame([("p", "TestIn", "")], "import_path string, name string, body string")
    made = {k: {r.name: r.code for r in scaffold.missing_scaffolds(tests, f, k).collect()} for k in ("basic", "table", "parallel", "what")}
    assert made["basic"].keys() == {n for n, *_ in SHAPES} - {"In"} and made["what"] == made["basic"]
    for n, i, o, s, t in SHAPES:
        if n == "In":
            continue
        for k, code in ((k, made[k][n]) for k in ("basic", "table", "parallel")):
            assert code.startswith(f"func Test{n}(t *testing.T) {{\n") and f"\t// func {n}{s}\n" in code and code.count("{") == code.count("}")
            assert ("// got := " in code) == bool(i or o) and (f"{n}(...)" in code) == bool(i)
            assert code.count("t.Parallel()") == (2 if k == "parallel" else 0) and ("t.Run(row.name" in code) == (k != "basic")
        assert (f"; want {t} }}" in made["table"][n]) == (len(o) == 1) and (f"want, a {t}\n" in made["basic"][n]) == bool(o)


def test_reports_of_packages(spark):
    tests = spark.createDataFrame([("p", "TestAdd", "cases := []int{}"), ("p", "TestNone", "x")], "import_path string, name string, body string")
    funcs = spark.createDataFrame([("p", "Add", False), ("p", "Lone", False)], "import_path string, name string, is_method boolean")
    bench = spark.createDataFrame([("p", "BenchmarkAdd")], "import_path string, name string")
    r = testing.package_report(tests, bench, funcs)
    assert got(r["map"], "test_name", "function_name") == [("TestAdd", "Add")] and got(r["unmapped"], "name") == [("TestNone",)]
    assert r["summary"].first().coverage == 50.0 and got(r["patterns"], "pattern", "n_tests") == [("Functions with Benchmarks", 1), ("Table-Driven Tests", 1)]
    off = testing.package_report(tests, bench, funcs, include_tests=False)
    assert off["tests"].count() == 0 and off["map"].count() == 0 and off["patterns"].count() == 0
    assert ("p", "summary", "tested", "1") in got(testing.report_lines(tests, bench, funcs))


def test_members_and_membership(spark):
    df = spark.createDataFrame([(["-v", "x"], {"Read": ["A"]}, ["A"], ["B", "A"], ["C"])], "args array<string>, m map<string,array<string>>, s array<string>, r array<string>, w array<string>")
    row = df.select(fn.has_flag("args", "-v"), fn.has_flag("args", "-"), fn.types_for_method("m", F.lit("Read")), fn.types_for_method("m", F.lit("No")), fn.late_sources("s", "r", "w")).first()
    assert tuple(row) == (True, False, ["A"], [], ["A", "B", "C"])
    r = spark.createDataFrame([(("r", "T", True),), (("", "T", True),), (("r", "T", False),), (None,)], "r struct<name:string,type:string,is_pointer:boolean>")
    assert [x[0] for x in r.select(fn.receiver_text("r")).collect()] == ["r *T", "*T", "r T", ""]


def test_files_that_are_seen(spark):
    model = Model.of(spark, files=[{"file_path": "a.go"}, {"file_path": "t.go", "is_test": True}, {"file_path": "g.go", "is_generated": True}], packages=[{"module_path": "m", "import_path": "", "name": "p"}])
    assert got(structure.visible(model.files), "file_path") == [("a.go",)] and structure.visible(model.files, True, True).count() == 3
    assert got(joins.with_parents(model, "files"), "file_path", "package_name", "module_path") == [(f, "p", "m") for f in ("a.go", "g.go", "t.go")]


def test_new_interfaces_follow_the_file(spark):
    model = _model(spark)
    out = patterns.extract(model)
    assert got(out.types.filter("kind = 'interface'"), "file_path", "ord") == [("a.go", 3)] and got(out.files.filter("is_modified"), "file_path") == [("a.go",)]
    other = model.with_tables(packages=rows(spark, "packages", [{"import_path": "m/a"}, {"import_path": "m/only"}]))
    assert got(patterns.extract(other, patterns.Options(target_package="m/only")).types.filter("kind = 'interface'"), "import_path") == [("m/only",)]
    assert got(patterns.extract(other, patterns.Options(target_package="m/none")).types.filter("kind = 'interface'"), "import_path") == [("m/a",)]
    named = patterns.extract(model, patterns.Options(naming=lambda types, signatures: F.concat(F.lit("Custom"), F.get(types, F.lit(0)))))
    assert got(named.types.filter("kind = 'interface'"), "name") == [("CustomBufferReader",)]


def test_rows_refuses_unknown(spark):
    with pytest.raises(ValueError):
        rows(spark, "types", [{"nope": 1}])
