"""Documents, reports, walks, the command line and the runner, on small models."""

import json
import stat

import pytest

from quillstone import cli, execute
from quillstone.render import documents, report, walk
from quillstone.schema import Model
from quillstone.sources import loader
from tests import sample


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    return sample.write(tmp_path_factory.mktemp("shop"))


@pytest.fixture(scope="module")
def small(spark):
    p, f = "ex.org/mod/main", "main/a.go"
    at = {"import_path": p, "file_path": f}
    return Model.of(
        spark,
        modules=[{"module_path": "ex.org/mod", "go_version": "1.18", "version": "v1 <x>"}],
        packages=[{"module_path": "ex.org/mod", "import_path": p, "name": "main", "documentation": "Main & more"}, {"module_path": "ex.org/mod", "import_path": "ex.org/mod/t", "name": "t", "is_test": True}],
        files=[{**at, "name": "a.go"}, {**at, "file_path": "main/gen.go", "name": "gen.go", "is_generated": True}, {**at, "file_path": "main/a_test.go", "name": "a_test.go", "is_test": True}],
        imports=[{**at, "ord": 0, "path": "fmt"}, {**at, "ord": 1, "path": "os"}, {**at, "file_path": "main/gen.go", "path": "io"}],
        types=[{**at, "name": "Thing", "kind": "struct", "is_exported": True, "doc": "Thing is\none"}, {**at, "name": "Does", "kind": "interface", "is_exported": True}, {**at, "name": "low", "kind": "struct"}],
        fields=[{"import_path": p, "type_name": "Thing", "name": "Field1"}, {"import_path": p, "type_name": "Thing", "name": "field2", "ord": 1}, {"import_path": p, "type_name": "Thing", "name": "", "is_embedded": True, "ord": 2}, {"import_path": p, "type_name": "low", "name": "Up"}],
        methods=[{"import_path": p, "type_name": "Thing", "name": "Do", "signature": "(x int) error", "doc": "Do does"}, {"import_path": p, "type_name": "Does", "name": "Do", "signature": "()", "is_interface_method": True}],
        functions=[{**at, "name": "Open", "func_key": "Open", "signature": "(a string) *Thing", "is_exported": True, "doc": "Open opens"}, {**at, "name": "shut", "func_key": "shut"}, {**at, "name": "Do", "func_key": "Do", "is_method": True, "is_exported": True}],
        variables=[{**at, "name": "config", "type": "int", "value": "1"}, {**at, "name": "Out", "type": "string", "value": '"<a>"', "is_exported": True}],
        constants=[{**at, "name": "VERSION", "value": '"1.0.0"', "is_exported": True}, {**at, "name": "Max", "type": "int", "value": "9", "is_exported": True}],
    )


def test_visit_counts(small):
    got = {r.kind: r.visits for r in walk.visit_counts(small).collect()}
    assert got == {"package": 1, "file": 1, "import": 2, "type": 2, "field": 2, "method": 1, "function": 1, "variable": 1, "constant": 2}
    got = {r.kind: r.visits for r in walk.visit_counts(small, walk.WalkOptions(True, True, True, True)).collect()}
    assert got == {"package": 2, "file": 3, "import": 3, "type": 3, "field": 4, "method": 1, "function": 3, "variable": 2, "constant": 2}


class Names(walk.Visitor):
    def type_(self, options):
        from pyspark.sql import functions as F

        return F.concat(F.lit("T "), "name", F.lit("\n"))

    def field(self, options):
        from pyspark.sql import functions as F

        return F.concat(F.lit(" f "), "name", F.lit("\n"))

    def imported(self, options):
        from pyspark.sql import functions as F

        return F.concat(F.lit("i "), "path", F.lit("\n"))


class Failing(walk.Visitor):
    def type_(self, options):
        raise RuntimeError("no types")


def test_own_visitors(small):
    assert walk.document(small, Names()) == "i fmt\ni os\nT Does\nT Thing\n f Field1\n f \n"
    assert walk.Formatter(walk.Visitor()).format(small) == ""
    with pytest.raises(RuntimeError, match="no types"):
        walk.document(small, Failing())


def test_markdown(small):
    text = documents.markdown(small)
    assert text.startswith("# Module ex.org/mod\n\n## Package main\n\nMain & more\n\n### Type: Does (interface)\n\n```go\ntype Does interface\n```\n\n### Type: Thing (struct)\n\nThing is\none\n\n")
    assert "### Method: (Thing) Do\n\nDo does\n\n**Signature:** `(x int) error`\n\n```go\nfunc (Thing) Do(x int) error\n```\n\n### Function: Open\n\nOpen opens\n\n**Signature:** `(a string) *Thing`\n\n" in text
    assert '### Variable: Out\n\n**Type:** string\n\n```go\nvar Out string\n```\n\n### Constant: Max\n\n**Type:** int\n\n**Value:** 9\n\n```go\nconst Max int = 9\n```\n\n### Constant: VERSION\n\n**Type:** \n\n**Value:** "1.0.0"\n\n' in text
    assert "```" not in documents.markdown(small, include_code_blocks=False) and "config" not in text and "low" not in text
    assert "### Function: shut" in documents.markdown(small, walk.WalkOptions(include_private=True))


def test_html(small):
    text = documents.html(small)
    assert text.startswith('<!DOCTYPE html>\n<html lang="en">\n<head>\n') and text.endswith("</div>\n</body>\n</html>\n")
    for part in (
        "<title>Go Module Documentation</title>", '<div class="version">v1 &lt;x&gt;</div>', "<p><strong>Path:</strong> ex.org/mod</p>", "<p><strong>Go Version:</strong> 1.18</p>", '<li><a href="#ex-org-mod-main">ex.org/mod/main</a></li>',
        '<h2 class="package-name">Package main</h2>', '<div class="doc-comment">Main &amp; more</div>', '<li><a href="#ex-org-mod-main-thing">Thing</a></li>', '<div id="ex-org-mod-main-thing" class="type type-struct">', '<div class="doc-comment">Thing is<br>one</div>',
        '<div id="ex-org-mod-main-thing-do" class="method">', '<h4 class="method-name">func (Thing) Do</h4>', '<h4 class="function-name">func Open</h4>', '<div class="function-signature">\n      <pre class="code">(a string) *Thing</pre>', '<h4 class="variable-name">var Out</h4>', "&#34;&lt;a&gt;&#34;", '<h4 class="constant-name">const Max</h4>',
    ):
        assert part in text, part
    assert "shut" not in text and "ex-org-mod-t" not in text and ".keyword" in text
    private = documents.html(small, walk.WalkOptions(True, True, title="Mine & yours"), include_css=False, custom_css="b {}\n")
    assert "<title>Mine &amp; yours</title>" in private and "func shut" in private and "<style>\nb {}\n</style>" in private and "ex-org-mod-t" in private
    assert "<title>Documentation for ex.org/mod</title>" in documents.create_html(small)


def test_package_documents(small):
    got = {r.import_path: r.document for r in walk.package_documents(small, documents.MarkdownVisitor()).collect()}
    assert list(got) == ["ex.org/mod/main"] and "# Module ex.org/mod\n\n" + got["ex.org/mod/main"] == documents.markdown(small)


def test_empty_model(spark):
    m = Model.of(spark, modules=[{"module_path": "m"}])
    assert documents.markdown(m) == "# Module m\n\n" and "</html>" in documents.html(m)
    assert report.structure_report(m).endswith("Packages (0):\n") and report.interfaces_report(m) == "Interfaces in m:\n\n"


def test_reports(small):
    text = report.structure_report(small)
    assert text == "Module: ex.org/mod\nVersion: v1 <x>\nGo Version: 1.18\nDirectory: \n\nPackages (2):\n  ex.org/mod/main\n    Types (3):\n      Does interface\n      Thing struct\n    Functions (3):\n      Do\n      Open\n\n  ex.org/mod/t\n\n"
    assert "      low struct (unexported)\n" in report.structure_report(small, include_private=True) and "Functions" not in report.structure_report(small, show_functions=False)
    assert json.loads(report.interfaces_json(small)) == {"ex.org/mod/main.Does": {}}


def test_command_line(spark, shop, tmp_path, capsys):
    assert cli.run(spark, ["analyze", "structure", "-i", shop]) == 0
    out = capsys.readouterr().out
    assert "Module: example.org/shop\nGo Version: 1.22.3\n" in out and "      Item struct\n" in out and "hidden" not in out
    assert cli.run(spark, ["analyze", "structure", "-i", shop, "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["Packages"]["example.org/shop/cart"]["Types"]["Item"]["Kind"] == "struct"
    assert cli.run(spark, ["analyze", "interfaces", "-i", shop, "-o", str(tmp_path / "i.txt")]) == 0
    assert (tmp_path / "i.txt").read_text() == "Interfaces in example.org/shop:\n\nexample.org/shop/cart.Keeper\n"
    assert cli.run(spark, ["visualize", "html", "-i", shop, "-d", str(tmp_path / "site"), "--title", "Shop"]) == 0
    assert "<title>Shop</title>" in (tmp_path / "site/index.html").read_text()
    assert cli.run(spark, ["rename", "variable", "-i", shop, "--old", "Limit", "--new", "Most", "--dry-run"]) == 0
    assert "  - cart/types.go\n" in capsys.readouterr().out
    assert cli.run(spark, ["rename", "variable", "-i", shop, "--old", "Limit", "--new", "Most", "-d", str(tmp_path / "new")]) == 0
    assert "var Most int = 5" in (tmp_path / "new/cart/types.go").read_text()
    assert cli.run(spark, ["rename", "variable", "-i", shop, "--old", "Nope", "--new", "Most"]) == 1
    assert cli.run(spark, ["rename", "variable", "-i", shop]) == 1
    assert cli.run(spark, ["transform", "extract", "-i", shop, "--min-types", "1", "--create-files", "-d", str(tmp_path / "ex")]) == 0
    made = [p for p in (tmp_path / "ex/cart").iterdir() if p.name not in ("types.go", "funcs.go", "funcs_test.go", "deep")]
    assert len(made) == 1 and "interface {\n\tClose() error\n" in made[0].read_text()
    assert cli.run(spark, ["transform", "extract", "-i", shop, "--min-types", "1", "-o", str(tmp_path / "only.go")]) == 0
    assert "interface {" in (tmp_path / "only.go").read_text()
    assert cli.run(spark, ["analyze", "structure", "-i", str(tmp_path / "none")]) == 1


LOG = "--- PASS: TestA (0.00s)\n    --- PASS: TestA/sub (0.00s)\n--- FAIL: TestB (0.00s)\nok\n"


@pytest.fixture
def tool(tmp_path):
    """Stands in for the tool chain: prints a log, its folder and a variable."""
    path = tmp_path / "tool"
    path.write_text(f"#!/bin/sh\nif [ \"$1\" = test ]; then printf '%s' '{LOG}'; exit 1; fi\necho \"$@\" in \"$PWD\" $CGO_ENABLED $X >&2\necho done\n")
    path.chmod(path.stat().st_mode | stat.S_IEXEC)
    return str(path)


def test_runner(spark, shop, tool, capsys, monkeypatch):
    m = loader.load_module(spark, shop)
    e = execute.ToolExecutor(tool, enable_cgo=False, env=["X=7"])
    out = e.execute(m, "version", "-m")
    assert (out.stdout, out.exit_code, out.error) == ("done\n", 0, None) and out.stderr == f"version -m in {shop} 0 7\n"
    t = e.execute_test(m, "", "-v")
    assert (t.package, t.tests, t.passed, t.failed) == ("./...", ["TestA", "TestA", "TestB"], 2, 1) and t.error
    assert execute.ToolExecutor(f"{tool}-none").execute(m).exit_code == -1 and execute.ToolExecutor(f"{tool}-none").execute_test(m).failed == 1
    for run in (e.execute, e.execute_test, execute.TemporaryExecutor(e).execute):
        with pytest.raises(ValueError, match="no module"):
            run(None)
    with pytest.raises(NotImplementedError):
        e.execute_function(m, "x")
    assert execute.contains_flag(["-v"], "-v") and not execute.contains_flag([], "-v")
    monkeypatch.setattr(execute.ToolExecutor, "__init__", lambda self, **kw: self.__dict__.update(tool=tool, folder="", enable_cgo=True, env=kw["env"], timeout=None))
    assert cli.run(spark, ["execute", "test", "-i", shop, "--test-verbose"]) == 1
    assert "  Passed: 2\n  Failed: 1\n" in capsys.readouterr().out
    assert cli.run(spark, ["execute", "run", "-i", shop, "--env", "X=1", "version"]) == 0


def test_temporary_runner(spark, shop, tool, tmp_path):
    m = loader.load_module(spark, shop)
    e = execute.TemporaryExecutor(execute.ToolExecutor(tool), str(tmp_path))
    where = e.execute(m, "version").stderr.split(" in ")[1].split()[0]
    assert where.startswith(str(tmp_path)) and not any(tmp_path.glob("quillstone-*"))
    e.keep = True
    e.execute(m)
    (kept,) = tmp_path.glob("quillstone-*")
    assert (kept / "cart/types.go").read_text() == sample.TYPES and (kept / "go.mod").exists()
