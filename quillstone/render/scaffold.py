"""Skeletons of tests for functions that have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import col, return_type, signature
from quillstone.operators.tests import missing_tests

Template = Callable[[Column, Column, Column, Column, Column], Column]


def _said(name: Column, sig: Column) -> Column:
    return F.when(sig == "", "").otherwise(F.concat(F.lit("// func "), name, sig, F.lit("\n")))


def _lines(tabs: int, *parts: Column) -> Column:
    """Parts that aren't empty, each behind its tabs."""
    return F.concat(*[F.when(p == "", "").otherwise(F.concat(F.lit("\t" * tabs), p)) for p in parts])


def _call(name: Column, params: Column, result: Column) -> Column:
    args = F.when(params, "(...)\n").otherwise("()\n")
    return F.concat(F.when(result, F.lit("// got := ")).when(params, F.lit("// got := ")).otherwise("// "), name, args)


def basic(name: Column, params: Column, result: Column, sig: Column, kind: Column) -> Column:
    check = F.when(result, F.concat(F.lit("// compare got with want"), F.when(kind == "", "").otherwise(F.concat(F.lit(", a "), kind)), F.lit("\n"))).otherwise("")
    note = F.concat(F.lit("// "), name, F.lit(": arrange, act, assert.\n"))
    return F.concat(F.lit("func Test"), name, F.lit("(t *testing.T) {\n"), _lines(1, _said(name, sig), note, _call(name, params, result), check), F.lit('\tt.Fatal("not written yet")\n}\n'))


def _rows(name: Column, params: Column, result: Column, sig: Column, kind: Column, parallel: bool) -> Column:
    """A row for each case, with the wanted result where there is one of a single type."""
    single = result & (kind != "") & ~kind.startswith("(")
    fields = F.concat(F.lit("name string"), F.when(single, F.concat(F.lit("; want "), kind)).otherwise(""))
    check = F.when(single, "// compare got with row.want\n").when(result, "// compare what comes back\n").otherwise("")
    own, inner = ("\tt.Parallel()\n", "\t\t\tt.Parallel()\n") if parallel else ("", "")
    note = F.concat(F.lit("// "), name, F.lit(": arrange, act, assert.\n"))
    loop = F.concat(F.lit("\tfor _, row := range []struct{ "), fields, F.lit(' }{{name: "first"}} {\n\t\tt.Run(row.name, func(t *testing.T) {\n' + inner))
    return F.concat(F.lit("func Test"), name, F.lit("(t *testing.T) {\n" + own), _lines(1, _said(name, sig), note), loop, _lines(3, _call(name, params, result), check), F.lit('\t\t\tt.Fatal("not written yet")\n\t\t})\n\t}\n}\n'))


#: By kind; an unknown kind is a basic one.
TEMPLATES: dict[str, Template] = {"basic": basic, "table": lambda *a: _rows(*a, parallel=False), "parallel": lambda *a: _rows(*a, parallel=True)}
KINDS = tuple(TEMPLATES)


def scaffold(name: Column | str, has_params: Column | str, has_return: Column | str, kind: str = "basic", sig: Column | str | None = None, result_type: Column | str | None = None) -> Column:
    """Source of a failing test to be filled in. sig, result_type: the
    function's signature and what it returns, where they are known."""
    empty = F.lit("")
    return TEMPLATES.get(kind, basic)(col(name), col(has_params), col(has_return), empty if sig is None else col(sig), empty if result_type is None else col(result_type))


def missing_scaffolds(tests: DataFrame, functions: DataFrame, kind: str = "basic") -> DataFrame:
    """(import_path, name, code) for each testable function that no test is mapped to.

    functions: rows of the model, with parameters and results.
    """
    missing = missing_tests(tests, functions)
    one = functions.filter("NOT is_method").join(missing, ["import_path", "name"], "left_semi")
    code = scaffold("name", F.size("parameters") > 0, F.size("results") > 0, kind, signature("parameters", "results"), return_type("results"))
    return one.groupBy("import_path", "name").agg(F.min(F.struct(code.alias("code"))).alias("c")).select("import_path", "name", "c.code")
