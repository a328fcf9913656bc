"""Texts that are long beside a worker's memory: files and packages of very many declarations."""

import itertools
import json
import tracemalloc

import pytest

from quillstone.plans.queries import QUERIES
from quillstone.schema import Model
from quillstone.sources import golang, jsonmodel, loader
from tests import sample

PLAIN = "// of {0}\ntype T{0} struct {{\n}}\n\ntype i{0} interface {{\n}}\n\ntype S{0} string\n\nvar V{0} int = {0}\n\nconst c{0} = {0}\n\n// two\n// lines\nfunc F{0}(x int) error {{\n\treturn nil\n}}\n\nfunc g{0}() {{}}\n"
#: Declarations that aren't plain, or seem so only.
ODD = ["type T struct\n", "var go = 1\n", "func f(x map) int {\n}\n", "var a = `p\nq` // c\ntype U int // t\n// d\nfunc a() {}\n", "// lone\n\ntype é int\n", "//go:x y\ntype W int", "const (\n\tA = iota\n\tB\n)\nvar x = 1", "type A int; type B = A\nvar q, r = 1, 2\n", "func (t T) m() {\n}\n", "type X ["]


def _parsed(text):
    try:
        return golang.parse(text)
    except golang.GoSyntaxError:
        return "fault"


@pytest.mark.parametrize("text", [sample.TYPES, sample.FUNCS, "package a\n" + "".join(map(PLAIN.format, range(9))), *["package a\n" + PLAIN.format(0) + x + PLAIN.format(1) for x in ODD], *["package a\n\n" + x for x in ODD]])
def test_plain_declarations_are_those_of_the_whole_parser(text, monkeypatch):
    short = _parsed(text)
    monkeypatch.setattr(golang._Scanner, "plain", lambda self: None)
    assert short == _parsed(text)


def test_declarations_come_one_by_one():
    """Those before a fault are given before it is met, so that no list of tokens is as long as the file."""
    text = "package a\n" + "".join(map(PLAIN.format, range(500))) + "type (\n\tA int\n)\n" * 2000
    some = golang.declarations(text + "?")
    assert [d["name"] for _, d in itertools.islice(some, 3)] == ["T0", "i0", "S0"]
    with pytest.raises(golang.GoSyntaxError):
        list(some)
    tracemalloc.start()
    n = sum(1 for _ in golang.declarations(text))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 500 * 7 + 2000 and most < 2 * len(text)


def test_declarations_are_those_of_the_model(spark):
    texts = {"a/types.go": sample.TYPES, "a/funcs.go": sample.FUNCS, "a/bad.go": sample.TYPES + "\n?", "a/x_windows.go": "package a\ntype W int\n", "a/long.go": "package a\n" + "".join(map(PLAIN.format, range(2000))), "a/empty.go": "package a"}
    sources = spark.createDataFrame([*texts.items(), (None, None)], "path string, text string")
    m = loader.model_of(loader.parse_sources(sources), loader._import_path("m", loader.F.col("file_path")), loader.LoadOptions(placeholders=False))
    found = loader.parse_declarations(sources).collect()
    text = {"types": "kind", "functions": "signature", "variables": "value", "constants": "value", "imports": "path"}
    for table, column in text.items():
        theirs = [(r.file_path, r.path if table == "imports" else r.name, r[column], r.doc) for r in m.tables[table].collect()]
        ours = [(r.file_path, r.name, r.name if table == "imports" else r[column], r.doc) for r in found if r.what == table]
        assert sorted(ours) == sorted(theirs), table
    assert sorted(r.file_path for r in found if r.what == "error") == ["", "a/bad.go"]
    assert not [r for r in found if r.file_path == "a/bad.go" and r.what != "error"]


def test_files_are_parsed_once(spark):
    plan = QUERIES["parse_go_source"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def _model(spark, n):
    """One large package with names that repeat, a small one and one that holds nothing."""
    at = lambda i: {"import_path": "m/small" if i % 50 == 49 else "m/large", "file_path": f"f{i % 3}.go", "ord": i}
    return Model.of(
        spark,
        modules=[{"module_path": "m"}],
        packages=[{"module_path": "m", "import_path": f"m/{x}", "name": x, "documentation": "Says \"x\""} for x in ("large", "small", "none")],
        types=[{**at(i), "name": f"T{i % (n - 7)}", "kind": "struct", "doc": f"d{i}"} for i in range(n)],
        fields=[{**{k: v for k, v in at(i).items() if k != "file_path"}, "type_name": f"T{i}", "name": "x", "type": "int"} for i in range(0, n, 9)],
        functions=[{**at(i), "func_key": f"F{i}", "name": f"F{i}", "signature": "()", "is_exported": True} for i in range(n)],
        variables=[{**at(i), "name": f"v{i % 40}", "value": str(i)} for i in range(n)],
        constants=[{**at(i), "name": f"é{i}", "value": str(i)} for i in range(n)],
        files=[{"import_path": f"m/{x}", "file_path": f"f{k}.go", "name": f"f{k}.go"} for x in ("large", "small") for k in range(3)],
    )


def test_parts_of_packages_are_the_whole(spark):
    m = _model(spark, 300)
    whole = {r.import_path: json.loads(r.json) for r in jsonmodel.package_json(m).collect()}
    assert set(whole) == {"m/large", "m/small", "m/none"} and set(whole["m/none"]) == {"Name", "ImportPath", "Dir", "IsTest", "Documentation"}
    assert whole["m/large"]["Types"]["T0"]["Doc"] == "d293" and whole["m/large"]["Types"]["T9"]["Fields"] == [{"Name": "x", "Type": "int", "Tag": "", "IsEmbedded": False, "Doc": ""}]
    parts = [(r.import_path, json.loads(r.json)) for r in jsonmodel.package_parts(m, 8).select("import_path", jsonmodel.F.to_json("package").alias("json")).collect()]
    assert len(parts) > 10 and max(len(p.get("Types", {})) for _, p in parts) < 80
    again = {}
    for path, part in parts:
        into = again.setdefault(path, {})
        for k, v in part.items():
            if isinstance(v, dict):
                assert not set(v) & set(into.get(k, {}))
                into[k] = {**into.get(k, {}), **v}
            else:
                assert into.setdefault(k, v) == v
    assert again == whole


@pytest.mark.parametrize("parts", [1, 8])
def test_json_is_read_in_one_pass(spark, parts):
    """The rows are those of the model's tables, for whole packages and for parts, whatever the keys' case."""
    F = jsonmodel.F
    packages = jsonmodel.package_parts(_model(spark, 120), parts)
    texts = packages.select(F.replace(F.to_json(F.struct(F.lit("m").alias("path"), F.create_map("import_path", "package").alias("Packages"))), F.lit('"Kind"'), F.lit('"KIND"')).alias("text"))
    again, found = jsonmodel.model_from_json(spark, texts), jsonmodel.declared_in_json(texts).collect()
    for kind, column in {"type": "kind", "function": "signature", "variable": "value", "constant": "value"}.items():
        theirs = [(r.import_path, r.file_path, r.name, r[column], r.is_exported, r.doc) for r in again.tables[kind + "s"].collect()]
        assert sorted(tuple(r)[1:] for r in found if r.kind == kind) == sorted(theirs)
    assert again.packages.count() == 3


def test_large_packages_are_several_documents(spark, monkeypatch):
    """No document grows with its package, and they are read once."""
    monkeypatch.setattr(jsonmodel, "PART", 16)
    m = _model(spark, 120)
    sizes = [len(p.package.Functions or {}) for p in jsonmodel.package_parts(m).collect()]
    assert sum(sizes) == 120 and max(sizes) <= 32
    plan = QUERIES["json_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
