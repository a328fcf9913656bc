"""Loading, saving and walking a module of source files."""

import pytest

from quillstone.operators import mutate, positions
from quillstone.operators.transform import rename_variable
from quillstone.sinks import source as sink
from quillstone.sources import golang, gomod, jsonmodel, loader
from tests import sample


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return sample.write(tmp_path_factory.mktemp("shop module"))


@pytest.fixture(scope="module")
def model(spark, folder):
    return loader.load_module(spark, folder)


@pytest.fixture(scope="module")
def full(spark, folder):
    return loader.load_module(spark, folder, loader.LoadOptions(placeholders=False, include_tests=True))


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_manifest():
    m = gomod.parse(sample.GO_MOD)
    assert (m.path, m.go_version) == ("example.org/shop", "1.22.3")
    assert m.requires == [("golang.org/x/text", "v0.14.0", False), ("example.com/one", "v1.0.0", False), ("example.com/two", "v2.1.0+incompatible", True)]
    assert m.replaces == [("example.com/one", "v1.0.0", "../one", ""), ("example.com/two", "", "example.com/fork", "v2.2.0")]
    for bad in ("go 1.20\n", "module a b\n", "module a\nrequire x\n", "module a\nreplace x y\n", "module a\nfoo bar\n"):
        with pytest.raises(gomod.ManifestError):
            gomod.parse(bad)


def test_packages_and_files(model):
    assert rows(model.modules, "module_path", "go_version") == [("example.org/shop", "1.22.3")]
    assert rows(model.packages, "module_path", "import_path", "name", "is_modified") == [("example.org/shop", "example.org/shop/cart", "cart", False), ("example.org/shop", "example.org/shop/cart/deep", "sub", False)]
    assert rows(model.files, "file_path", "name", "is_test", "is_generated", "size") == [("cart/deep/sub.go", "sub.go", False, True, len(sample.OTHER)), ("cart/funcs.go", "funcs.go", False, False, len(sample.FUNCS)), ("cart/types.go", "types.go", False, False, len(sample.TYPES.encode()))]
    assert rows(model.dependencies, "path", "indirect")[1] == ("example.com/two", True) and model.replaces.count() == 2
    assert rows(model.imports.filter("file_path = 'cart/funcs.go'"), "ord", "path", "name", "is_blank") == [(0, "fmt", "", False), (1, "strings", "str", False), (2, "embed", "_", True), (3, "math", ".", False), (4, "os", "", False)]


def test_types_with_placeholders(model):
    got = rows(model.types, "ord", "name", "kind", "is_exported", "underlying")
    assert got == [(0, "Item", "struct", True, ""), (1, "Base", "struct", True, ""), (2, "state", "type", False, ""), (3, "Names", "type", True, ""), (4, "Check", "type", True, ""), (5, "List", "type", True, ""), (6, "grid", "type", False, ""), (7, "Keeper", "interface", True, "")]
    docs = dict(rows(model.types, "name", "doc"))
    assert docs["Item"] == "Item is one thing in a cart\n" and docs["state"] == docs["List"] == "Grouped types\n" and docs["Base"] == ""
    assert docs["Keeper"] == "Keeper keeps items.\n\n\tindented\n"
    fields = rows(model.fields.filter("type_name = 'Item'"), "ord", "name", "type", "tag", "is_embedded", "doc")
    assert fields == [(0, "ID", "any", '`json:"id"`', False, "ID tells items apart\n"), (1, "Name", "any", '`json:"name,omitempty"`', False, ""), (2, "price", "any", "", False, ""), (3, "", "any", "", True, "Embedded\n"), (4, "", "any", "", True, ""), (5, "", "any", "", True, "")]
    contract = rows(model.methods.filter("is_interface_method"), "ord", "name", "signature", "is_embedded", "embedded")
    assert contract == [(0, "Put", "func(...) ...", False, ""), (1, "Close", "func(...) ...", False, ""), (2, "", "", True, "Closer"), (3, "", "", True, "~int | ~string")]


def test_functions_and_values_with_placeholders(model):
    got = rows(model.functions, "ord", "name", "signature", "is_method", "receiver.name", "receiver.type", "receiver.is_pointer")
    assert got == [
        (0, "New", "func New(...) {...}", False, None, None, None), (1, "Price", "func Price(...) {...}", True, "i", "Item", True), (2, "Close", "func Close(...) {...}", True, "", "Item", False),
        (3, "Len", "func Len(...) {...}", True, "l", "", False), (4, "Map", "func Map(...) {...}", False, None, None, None), (5, "extern", "func extern(...) {...}", False, None, None, None),
    ]
    assert rows(model.methods.filter("NOT is_interface_method"), "type_name", "name") == [("Item", "Close"), ("Item", "Price")]
    assert rows(model.constants, "ord", "name", "type", "value", "is_exported") == [(0, "A", "any", "...", True), (1, "B", "any", "", True), (2, "C", "any", "", True), (3, "é", "any", "...", False), (4, "Ü", "any", "...", True)]
    assert rows(model.variables.filter("file_path = 'cart/types.go'"), "name", "value", "doc") == [("Limit", "...", "Limit is a limit.\n"), ("pair", "", ""), ("single", "...", "")]
    assert model.functions.filter("is_test").count() == 0


def test_what_the_source_says(full):
    f = {r.name: r for r in full.functions.collect()}
    assert f["Price"].signature == "(rate float64, _ ...func(int) string) (float64, error)"
    assert [(p.name, p.type, p.is_variadic) for p in f["Price"].parameters] == [("rate", "float64", False), ("_", "func(int) string", True)]
    assert [(p.name, p.type) for p in f["Map"].parameters] == [("in", "map[K]V"), ("ch", "<-chan struct{ A int }")] and f["Map"].signature.startswith("[K comparable, V any](in")
    assert [(p.name, p.type) for p in f["extern"].parameters] == [("", "int"), ("", "string")]
    assert f["TestNew"].is_test and not f["helper"].is_test and f["Len"].receiver.type == "List[T]"
    t = {r.name: (r.kind, r.underlying) for r in full.types.collect()}
    assert t["Names"] == ("alias", "map[string]*Item") and t["Check"][1] == "func(a, b string) (ok bool, err error)" and t["grid"] == ("type", "[3][4]int")
    assert rows(full.fields.filter("type_name = 'Item'"), "ord", "name", "type") == [(0, "ID", "int"), (0, "Number", "int"), (1, "Name", "string"), (2, "price", "float64"), (3, "", "Base"), (4, "", "*other.Meta"), (5, "", "List[int]")]
    assert rows(full.constants, "name", "type", "value")[:3] == [("A", "state", "0 + 1"), ("B", "state", "1 + 1"), ("C", "state", "2 + 1")]
    assert rows(full.methods.filter("type_name = 'List'"), "name") == [("Len",)]


def test_positions(spark, model):
    files = model.files.select("import_path", "file_path", "line_starts")
    at = model.types.join(files, ["import_path", "file_path"])
    line, col = positions.line_column("start_pos", "line_starts")
    last, _ = positions.line_column("end_pos", "line_starts")
    got = {r.name: (r.l, r.c, r.e) for r in at.select("name", line.alias("l"), col.alias("c"), last.alias("e")).collect()}
    assert got["Item"] == (5, 6, 16) and got["Keeper"] == (36, 6, 42)
    item = model.types.filter("name = 'Item'").first()
    probes = spark.createDataFrame([(1, "cart/types.go", item.start_pos + 10), (2, "cart/types.go", 1)], "probe int, file_path string, pos long")
    found = positions.element_at(probes, "pos", positions.elements_of(model), ["file_path"]).select("probe", "kind", "name").collect()
    assert [tuple(r) for r in found] == [(1, "type", "Item")]
    named = positions.positions_of(model, "functions").filter("name = 'New'").first()
    assert (named.line_start, named.col_start, named.line_end) == (13, 1, 18)


def test_load_errors(spark, tmp_path, folder):
    with pytest.raises(loader.LoadError, match=r"no go\.mod"):
        loader.load_module(spark, str(tmp_path))
    bad = tmp_path / "bad"
    sample.write(bad)
    (bad / "cart/broken.go").write_text("package cart\n\nfunc {\n")
    (bad / "cart/worse.go").write_text("package cart\nvar x = (1]\n")
    with pytest.raises(loader.LoadError, match=r"broken\.go: line 3.*worse\.go: line 2"):
        loader.load_module(spark, str(bad))
    with pytest.raises(loader.LoadError):
        loader.validate_path(f"{folder}-x/file.go", folder)
    with pytest.raises(loader.LoadError):
        loader.safe_read(f"{folder}/../other", folder)
    assert loader.validate_path(f"{folder}/cart/types.go", folder).name == "types.go"


def test_load_options(spark, folder):
    some = loader.load_module(spark, folder, loader.LoadOptions(package_paths=("./cart/deep",), load_docs=False))
    assert rows(some.packages, "name") == [("sub",)]
    assert rows(loader.load_module(spark, folder, loader.LoadOptions(package_paths=("example.org/shop/cart/...",))).packages, "name") == [("cart",), ("sub",)]
    assert loader.load_module(spark, folder, loader.LoadOptions(load_docs=False)).types.filter("doc <> ''").count() == 0


@pytest.mark.parametrize(("line", "holds"), [("linux && !windows", True), ("(darwin || windows) && cgo", False), ("extra", False), ("!extra || go1.21", True), ("ignore", False)])
def test_build_lines(line, holds):
    assert golang.is_built("a.go", f"//go:build {line}\n\npackage a\n") is holds
    assert golang.is_built("a_linux_amd64_test.go", "package a\n") and not golang.is_built("a_arm64.go", "package a\n")


@pytest.mark.parametrize("text", ["", "package", "package a\nx := 1\n", 'package a\nvar s = "open\n', "package a\ntype T struct { a int b int }\n", "package a\nfunc f( {}\n", "package a\nimport fmt\n"])
def test_what_is_not_go(text):
    with pytest.raises(golang.GoSyntaxError):
        golang.parse(text)


def test_save_keeps_what_is_not_modified(spark, full, tmp_path):
    sink.save_to(full, str(tmp_path))
    assert (tmp_path / "cart/types.go").read_text() == sample.TYPES and (tmp_path / "cart/funcs_test.go").read_text() == sample.TEST
    text = (tmp_path / "go.mod").read_text()
    assert text.startswith("module example.org/shop\n\ngo 1.22.3\n\nrequire (\n\tgolang.org/x/text v0.14.0\n")
    assert "\texample.com/two v2.1.0+incompatible // indirect\n)" in text and "replace (\n\texample.com/one v1.0.0 => ../one\n\texample.com/two => example.com/fork v2.2.0\n)" in text


def test_load_save_load(spark, full, tmp_path):
    """Every declaration survives being printed and parsed."""
    from pyspark.sql import functions as F

    sink.save_to(full.with_tables(files=full.files.withColumn("is_modified", F.lit(True))), str(tmp_path))
    again = loader.load_module(spark, str(tmp_path), loader.LoadOptions(placeholders=False, include_tests=True))
    for table, cols in {
        "types": ("import_path", "file_path", "name", "kind", "is_exported", "doc"), "fields": ("type_name", "name", "type", "tag", "is_embedded", "doc"), "methods": ("type_name", "name", "signature", "is_interface_method", "embedded", "doc"),
        "functions": ("file_path", "name", "signature", "doc", "receiver.name", "receiver.type", "receiver.is_pointer", "parameters", "results", "is_test"), "variables": ("name", "type", "value", "doc", "spec"), "constants": ("name", "type", "value", "doc"), "imports": ("file_path", "path", "name", "is_blank"),
    }.items():
        assert rows(again.tables[table], *cols) == rows(full.tables[table], *cols), table
    bodies = lambda m: {r.name: "".join(r.body.split()) for r in m.functions.filter("body <> ''").collect() if r.name != "extern"}
    assert bodies(again).items() >= bodies(full).items()


def test_rename_is_saved(spark, full, tmp_path):
    new, result = rename_variable("Limit", "Most")(full)
    assert result.success
    sink.save_to(new, str(tmp_path), sink.SaveOptions(only_modified=True))
    assert sorted(p.name for p in tmp_path.rglob("*.go")) == ["types.go"]
    assert "var Most int = 5" in (tmp_path / "cart/types.go").read_text()
    sink.save_to(new, str(tmp_path), sink.SaveOptions(create_backups=True))
    assert (tmp_path / "cart/types.go.bak").exists() and not (tmp_path / "cart/funcs.go.bak").exists()


def test_built_model_is_saved(spark, tmp_path):
    from quillstone.schema import Model

    m = Model.of(spark, modules=[{"module_path": "m", "go_version": "1.20", "dir": str(tmp_path)}], packages=[{"module_path": "m", "import_path": "m/p", "name": "p"}], files=[{"import_path": "m/p", "file_path": "p/s.go", "name": "s.go"}])
    m = mutate.append(m, "types", [{"import_path": "m/p", "file_path": "p/s.go", "name": "S", "kind": "struct", "is_exported": True, "doc": "S is\ntwo lines"}])
    m = mutate.add_field(m, "m/p", "S", "Name", "string", "`x`")
    m = mutate.add_field(m, "m/p", "S", "", "Base", is_embedded=True)
    m = mutate.append(m, "functions", [{"import_path": "m/p", "file_path": "p/s.go", "name": "F", "func_key": "F", "signature": "()", "is_exported": True}])
    m = mutate.set_receiver(m, {"import_path": "m/p", "func_key": "F"}, "s", "S", True)
    m = mutate.add_parameter(m, {"func_key": "F"}, "a", "int")
    m = mutate.add_result(m, {"func_key": "F"}, "", "error")
    m = mutate.add_method(m, "m/p", "S", "F", "()")
    m = mutate.add_dependency(mutate.add_replace(m, "m", ("x", ""), ("../x", "")), "m", "x", "v1.0.0", True)
    m = mutate.set_position(m, "functions", {"func_key": "F"}, 5, 9)
    m = mutate.set_position(m, "functions", {"func_key": "F"}, 6, 7, "receiver")
    f = m.functions.first()
    assert (f.is_method, f.start_pos, f.receiver.end_pos, f.parameters[0].type, f.results[0].type) == (True, 5, 7, "int", "error")
    assert m.packages.first().is_modified and m.files.first().is_modified
    m = mutate.upsert(m, "variables", [{"import_path": "m/p", "file_path": "p/s.go", "name": "v", "value": "1"}, {"import_path": "m/p", "file_path": "p/s.go", "name": "v", "value": "2"}])
    m = mutate.upsert(m, "variables", [{"import_path": "m/p", "file_path": "p/s.go", "name": "v", "type": "int", "value": "3"}])
    sink.save(m)
    assert (tmp_path / "p/s.go").read_text() == "package p\n\nvar v int = 3\n\n// S is\n// two lines\ntype S struct {\n\tName string `x`\n\tBase\n}\n\nfunc (s *S) F() {\n\t// Implementation\n}\n\n"
    assert (tmp_path / "go.mod").read_text() == "module m\n\ngo 1.20\n\nrequire (\n\tx v1.0.0 // indirect\n)\n\nreplace (\n\tx => ../x\n)\n"
    with pytest.raises(ValueError, match="leads out"):
        sink.save_to(mutate.upsert(m, "files", [{"import_path": "m/p", "file_path": "q", "name": "../x.go"}]), str(tmp_path))


def test_json_round_trip(spark, full):
    again = jsonmodel.model_from_json(spark, jsonmodel.module_json(full))
    for table, cols in {"modules": ("module_path", "go_version"), "packages": ("import_path", "name"), "types": ("import_path", "name", "kind", "underlying", "doc"), "fields": ("type_name", "name", "type", "tag"), "methods": ("type_name", "name", "signature", "is_interface_method"), "functions": ("name", "signature", "body", "receiver.type", "parameters.name"), "constants": ("name", "value"), "variables": ("name", "value"), "files": ("file_path", "source_code"), "dependencies": ("ord", "path"), "replaces": ("old", "new")}.items():
        assert rows(again.tables[table], *cols) == rows(full.tables[table], *cols), table


def test_json_of_any_case(spark):
    text = '{"path": "m", "PACKAGES": {"m/p": {"name": "p", "Documentation": "Says", "types": {"Person": {"Name": "Person", "kind": "struct", "unknown": 1}, "T": {}}}}}'
    m = jsonmodel.model_from_json(spark, text)
    assert rows(m.packages, "import_path", "name", "documentation") == [("m/p", "p", "Says")]
    assert rows(m.types, "name", "kind", "is_exported") == [("Person", "struct", False), ("T", "", False)]
    for bad in ("", "[1]", "{"):
        with pytest.raises(Exception, match="JSON"):
            jsonmodel.model_from_json(spark, bad).packages.collect()
