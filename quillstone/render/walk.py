"""The walk over a model and what is made of it: visitors, documents, formatters.

A visit is a row. The walk gives the visits their order (package, section,
declaration, member), a visitor gives them their text as Column expressions,
so that a document of any size is rendered by the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import is_exported
from quillstone.render.markup import ordered_text
from quillstone.schema import Model

#: Sections of a package, in their order.
SECTIONS = ("package", "file", "type", "function", "variable", "constant")


@dataclass(frozen=True)
class WalkOptions:
    """What is visited beside exported elements of files that are no tests and weren't generated.

    methods_as_functions: methods are visited among the functions too, as they
    once were, and not only below their types.
    """

    include_private: bool = False
    include_tests: bool = False
    include_generated: bool = False
    methods_as_functions: bool = False
    title: str = ""


class Visitor:
    """Texts of the visits. Each method gets the options and returns a Column
    over the element's row (with its package's name as ``package_name`` and
    module path as ``module_path``), or None for no text. This one has none."""

    def module(self, model: Model, options: WalkOptions) -> DataFrame | None:
        """(module_path, text) of the opening of each module's document."""
        return None

    def package(self, model: Model, options: WalkOptions) -> DataFrame | None:
        """(import_path, text) of each package's own part."""
        return None

    def file(self, options: WalkOptions) -> Column | None:
        return None

    def imported(self, options: WalkOptions) -> Column | None:
        return None

    def type_(self, options: WalkOptions) -> Column | None:
        return None

    def field(self, options: WalkOptions) -> Column | None:
        return None

    def method(self, options: WalkOptions) -> Column | None:
        return None

    def function(self, options: WalkOptions) -> Column | None:
        return None

    def variable(self, options: WalkOptions) -> Column | None:
        return None

    def constant(self, options: WalkOptions) -> Column | None:
        return None

    def closing(self) -> str:
        """What ends a document."""
        return ""


def visited_packages(model: Model, options: WalkOptions) -> DataFrame:
    return model.packages if options.include_tests else model.packages.filter("NOT is_test")


def visits(model: Model, options: WalkOptions = WalkOptions()) -> dict[str, DataFrame]:
    """The elements that a walk visits, by kind.

    Types, functions, variables and constants are visited where they are
    exported, fields also where they are embedded; interface methods are not
    visited. Fields are those of structs.
    """
    private = F.lit(options.include_private)
    packages = visited_packages(model, options)
    inside = packages.select("module_path", "import_path", F.col("name").alias("package_name"))
    at = lambda df: df.join(inside, "import_path")
    files = model.files
    for c, keep in (("is_test", options.include_tests), ("is_generated", options.include_generated)):
        if not keep:
            files = files.filter(~F.col(c))
    types = at(model.types.filter(F.col("is_exported") | private))
    owners = types.select("import_path", F.col("name").alias("type_name"), F.col("kind").alias("owner_kind"))
    below = lambda df: at(df.join(owners, ["import_path", "type_name"]))
    functions = model.functions.filter(F.col("is_exported") | private)
    return {
        "package": packages,
        "file": at(files),
        "import": at(model.imports.join(files.select("import_path", "file_path"), ["import_path", "file_path"])),
        "type": types,
        "field": below(model.fields.filter((F.col("name") == "") | is_exported("name") | private)).filter("owner_kind = 'struct'"),
        "method": below(model.methods.filter(~F.col("is_interface_method")).filter(is_exported("name") | private)),
        "function": at(functions if options.methods_as_functions else functions.filter("NOT is_method")),
        "variable": at(model.variables.filter(F.col("is_exported") | private)),
        "constant": at(model.constants.filter(F.col("is_exported") | private)),
    }


def visit_counts(model: Model, options: WalkOptions = WalkOptions()) -> DataFrame:
    """(kind, visits) of a walk."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("visits")).select(F.lit(k).alias("kind"), "visits") for k, df in visits(model, options).items()])


ORDER = ("import_path", "section", "name", "member", "ord")


def render(model: Model, visitor: Visitor, options: WalkOptions = WalkOptions()) -> DataFrame:
    """(module_path, import_path, section, name, member, ord, text): every visit
    with a text, to be read in the order of these columns. The module's own
    opening has import_path '' and section 0."""
    seen = visits(model, options)
    parts: list[DataFrame] = []

    def put(df: DataFrame, section: str, text: Column | None, name: Column, member: int = 0, order: Column | None = None) -> None:
        if text is not None:
            parts.append(df.select("module_path", "import_path", F.lit(SECTIONS.index(section) + 1).alias("section"), name.alias("name"), F.lit(member).alias("member"), (order if order is not None else F.lit(0)).cast("int").alias("ord"), text.alias("text")))

    head = visitor.module(model, options)
    if head is not None:
        parts.append(head.select("module_path", F.lit("").alias("import_path"), F.lit(0).alias("section"), F.lit("").alias("name"), F.lit(0).alias("member"), F.lit(0).alias("ord"), "text"))
    own = visitor.package(model, options)
    if own is not None:
        put(own.join(visited_packages(model, options).select("import_path", "module_path"), "import_path"), "package", F.col("text"), F.lit(""))
    name, of = F.col("name"), F.col("type_name")
    put(seen["file"], "file", visitor.file(options), F.col("file_path"))
    put(seen["import"], "file", visitor.imported(options), F.col("file_path"), 1, F.col("ord"))
    put(seen["type"], "type", visitor.type_(options), name)
    put(seen["field"], "type", visitor.field(options), of, 1, F.col("ord"))
    put(seen["method"], "type", visitor.method(options), of, 2, F.col("ord"))
    put(seen["function"], "function", visitor.function(options), name)
    put(seen["variable"], "variable", visitor.variable(options), name)
    put(seen["constant"], "constant", visitor.constant(options), name)
    if not parts:
        return model.modules.filter("false").select("module_path", *[F.lit(None).cast("string" if c in ("import_path", "name") else "int").alias(c) for c in ORDER], F.lit("").alias("text"))
    return reduce(DataFrame.unionByName, parts)


def package_documents(model: Model, visitor: Visitor, options: WalkOptions = WalkOptions()) -> DataFrame:
    """(import_path, document): each package's part of the whole, for any number of packages."""
    parts = render(model, visitor, options).filter("import_path <> ''")
    return parts.groupBy("import_path").agg(ordered_text(["section", "name", "member", "ord"], "text").alias("document"))


def document(model: Model, visitor: Visitor, options: WalkOptions = WalkOptions()) -> str:
    """The whole document of a model's one module, as one text on the driver.

    The rows arrive in order, partition by partition.
    """
    rows = render(model, visitor, options).orderBy(*ORDER).select("text").toLocalIterator()
    return "".join(r.text for r in rows) + visitor.closing()


class Visualizer(Protocol):
    """What makes a document of a model."""

    name: str
    description: str

    def visualize(self, model: Model) -> str: ...


@dataclass
class Formatter:
    """A visitor as a formatter: the walk with its defaults, then the result."""

    visitor: Visitor
    name: str = "formatter"
    description: str = ""
    options: WalkOptions = WalkOptions()

    def visualize(self, model: Model) -> str:
        return document(model, self.visitor, self.options)

    format = visualize
