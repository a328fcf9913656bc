"""The command line: analyse, transform, rename, visualise and run a module."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quillstone.execute import ToolExecutor
from quillstone.functions import naming_strategy
from quillstone.operators.patterns import Options, extract
from quillstone.operators.transform import rename_variable
from quillstone.render import documents, report
from quillstone.render.walk import WalkOptions
from quillstone.sinks.source import save_to, write_text
from quillstone.sources.jsonmodel import module_json
from quillstone.sources.loader import LoadError, LoadOptions, load_module


def split_csv(text: str) -> list[str]:
    return [x.strip() for x in text.split(",")] if text else []


def parse_env(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _seconds(text: str) -> float:
    """A duration such as 90s, 5m or 1h30m."""
    import re

    parts = re.fullmatch(r"(?:(\d+)h)?(?:(\d+)m)?(?:(\d+(?:\.\d+)?)s)?", text)
    if not text or parts is None:
        raise argparse.ArgumentTypeError(f"no duration: {text!r}")
    h, m, s = parts.groups()
    return int(h or 0) * 3600 + int(m or 0) * 60 + float(s or 0)


def parser() -> argparse.ArgumentParser:
    yes = {"action": argparse.BooleanOptionalAction}
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-i", "--input", default=".", help="folder of the module")
    common.add_argument("-o", "--output", default="", help="file for the output (standard output)")
    common.add_argument("-d", "--out-dir", default="", help="folder for the output")
    common.add_argument("-v", "--verbose", action="store_true")
    top = argparse.ArgumentParser(prog="quillstone", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    analyze = verbs.add_parser("analyze").add_subparsers(dest="what", required=True)
    for name in ("structure", "interfaces"):
        p = analyze.add_parser(name, parents=[common])
        p.add_argument("--format", choices=("text", "json"), default="text")
        p.add_argument("--include-private", **yes, default=False)
        p.add_argument("--include-tests", **yes, default=False)
        # accepted, without effect
        p.add_argument("--sort-by-name", **yes, default=True)
        p.add_argument("--sort-by-size", **yes, default=False)
        p.add_argument("--max-depth", type=int, default=0)
        if name == "structure":
            p.add_argument("--show-types", **yes, default=True)
            p.add_argument("--show-functions", **yes, default=True)
            p.add_argument("--show-deps", **yes, default=False)
        else:
            p.add_argument("--show-interfaces", **yes, default=True)

    p = verbs.add_parser("transform").add_subparsers(dest="what", required=True).add_parser("extract", parents=[common])
    p.add_argument("--min-types", type=int, default=2)
    p.add_argument("--min-methods", type=int, default=1)
    p.add_argument("--method-threshold", type=float, default=0.8)
    p.add_argument("--naming", default="default", help="default, prefix or suffix")
    for name in ("exclude-packages", "exclude-types", "exclude-methods", "target-package"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--create-files", **yes, default=False)

    p = verbs.add_parser("rename").add_subparsers(dest="what", required=True).add_parser("variable", parents=[common])
    p.add_argument("--old", default="")
    p.add_argument("--new", default="")
    p.add_argument("--dry-run", action="store_true")

    p = verbs.add_parser("visualize").add_subparsers(dest="what", required=True).add_parser("html", parents=[common])
    for name in ("include-private", "include-tests", "include-generated"):
        p.add_argument(f"--{name}", **yes, default=False)
    p.add_argument("--title", default="")
    p.add_argument("--syntax-highlight", **yes, default=True)
    p.add_argument("--custom-css", default="")

    execute = verbs.add_parser("execute").add_subparsers(dest="what", required=True)
    for name in ("test", "run"):
        p = execute.add_parser(name, parents=[common])
        p.add_argument("--color", action="store_true")
        p.add_argument("--disable-cgo", action="store_true")
        p.add_argument("--timeout", default="", help="such as 90s")
        p.add_argument("--env", default="", help="KEY=VALUE,...")
        if name == "test":
            p.add_argument("package", nargs="?", default="./...")
            p.add_argument("--test-verbose", action="store_true")
            for flag in ("bench", "short", "race", "cover"):
                p.add_argument(f"--{flag}", action="store_true")
        else:
            p.add_argument("args", nargs=argparse.REMAINDER)
    return top


def _put(args: argparse.Namespace, text: str, name: str) -> None:
    if args.output:
        write_text(args.output, text) if "/" in args.output else write_text(f"./{args.output}", text)
    elif args.out_dir:
        write_text(f"{args.out_dir}/{name}", text)
    else:
        sys.stdout.write(text if text.endswith("\n") else text + "\n")


def run(spark: SparkSession, argv: list[str]) -> int:
    """Does what the arguments say; the exit code. Only results go to standard output."""
    args = parser().parse_args(argv)
    say = lambda text: print(text, file=sys.stderr)
    if args.verb == "rename" and not (args.old and args.new):
        say("rename wants --old and --new")
        return 1
    try:
        placeholders = args.verb in ("analyze", "visualize", "execute")
        model = load_module(spark, args.input, LoadOptions(include_tests=getattr(args, "include_tests", False) or not placeholders, placeholders=placeholders))
    except LoadError as e:
        say(f"the module wasn't loaded: {e}")
        return 1
    if args.verb == "analyze" and args.what == "structure":
        text = module_json(model) if args.format == "json" else report.structure_report(model, args.include_private, args.show_types, args.show_functions)
        _put(args, text, f"structure.{'json' if args.format == 'json' else 'txt'}")
    elif args.verb == "analyze":
        make = report.interfaces_json if args.format == "json" else report.interfaces_report
        _put(args, make(model, args.include_private), f"interfaces.{'json' if args.format == 'json' else 'txt'}")
    elif args.verb == "transform":
        lists = {k: tuple(split_csv(getattr(args, k))) for k in ("exclude_packages", "exclude_types", "exclude_methods")}
        new = extract(model, Options(minimum_types=args.min_types, minimum_methods=args.min_methods, method_threshold=args.method_threshold, target_package=args.target_package, create_new_files=args.create_files, naming=naming_strategy(args.naming), **lists))
        if args.out_dir:
            save_to(new, args.out_dir)
        elif args.output:
            added = new.types.join(model.types.select("import_path", "name"), ["import_path", "name"], "left_anti")
            _put(args, "".join(r.text for r in _interface_texts(new, added)), "interfaces.go")
        else:
            say("done; --output or --out-dir saves the result")
    elif args.verb == "rename":
        return _rename(args, model, say)
    elif args.verb == "visualize":
        options = WalkOptions(args.include_private, args.include_tests, args.include_generated, title=args.title or "Go Module Documentation")
        _put(args, documents.html(model, options, include_css=args.syntax_highlight, custom_css=args.custom_css), "index.html")
    else:
        return _execute(args, model, say)
    return 0


def _interface_texts(model, added):
    """Source of the added interfaces, in order of package and name."""
    from quillstone.sinks.source import declaration_texts

    keys = added.select("import_path", "file_path", "ord", "name")
    texts = declaration_texts(model).filter("section = 4").join(keys, ["import_path", "file_path", "ord"])
    return texts.orderBy("import_path", "name").select("text").toLocalIterator()


def _rename(args, model, say) -> int:
    new, result = rename_variable(args.old, args.new, args.dry_run)(model)
    if not result.success:
        say(f"nothing was renamed: {result.error}")
        return 1
    if args.dry_run:
        files = [r.file_path for r in result.files.orderBy("file_path").collect()]
        lines = ["DRY RUN - nothing is changed", f"Summary: {result.summary}", "", f"Files ({len(files)}):", *[f"  - {f}" for f in files], "", "Changes:"]
        for i, c in enumerate(result.changes.orderBy("import_path", "file_path").collect(), 1):
            lines += [f"  {i}. {c.file_path}" + (f" (line {c.line_number})" if c.line_number else ""), f"     - before: {c.original}", f"     - after:  {c.new}"]
        _put(args, "\n".join(lines) + "\n", "rename.txt")
        return 0
    save_to(new, args.out_dir or model.modules.first().dir)
    say(f"renamed {args.old} to {args.new} in {result.files.count()} file(s)")
    return 0


def _execute(args, model, say) -> int:
    tool = ToolExecutor(enable_cgo=not args.disable_cgo, env=parse_env(args.env), timeout=_seconds(args.timeout) if args.timeout and args.what == "run" else None)
    if args.what == "run":
        rest = args.args[1:] if args.args[:1] == ["--"] else args.args
        out = tool.execute(model, *rest)
        sys.stdout.write(out.stdout)
        sys.stderr.write(out.stderr)
        if out.error:
            say(out.error)
        return 1 if out.error else 0
    flags = [f for on, f in ((args.test_verbose, "-v"), (args.bench, "-bench=."), (args.short, "-short"), (args.race, "-race"), (args.cover, "-cover")) if on]
    flags += [f"-timeout={args.timeout}"] if args.timeout else []
    out = tool.execute_test(model, args.package, *flags)
    text = f"Test Results:\n  Package: {out.package}\n  Tests Run: {len(out.tests)}\n  Passed: {out.passed}\n  Failed: {out.failed}\n"
    if args.verbose or args.test_verbose or out.failed:
        text += f"\nTest Output:\n{out.output}"
    _put(args, text, "tests.txt")
    if out.error:
        say(out.error)
    return 1 if out.failed or out.error else 0


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("quillstone").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, sys.argv[1:] if argv is None else argv)
