"""Markdown and HTML documents of a model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import doc_comment, html_escape, sanitize_anchor
from quillstone.render import markup
from quillstone.render.walk import Formatter, Visitor, WalkOptions, visited_packages
from quillstone.schema import Model


@dataclass(frozen=True)
class MarkdownVisitor(Visitor):
    """include_links and include_toc are accepted and have no effect."""

    include_code_blocks: bool = True
    include_links: bool = True
    include_toc: bool = True

    def module(self, model: Model, options: WalkOptions) -> DataFrame:
        return model.modules.select("module_path", markup.markdown_module("module_path").alias("text"))

    def package(self, model: Model, options: WalkOptions) -> DataFrame:
        return visited_packages(model, options).select("import_path", markup.markdown_package("name", F.coalesce("documentation", F.lit(""))).alias("text"))

    def type_(self, options: WalkOptions) -> Column:
        return markup.markdown_type("name", "kind", "doc", self.include_code_blocks)

    def method(self, options: WalkOptions) -> Column:
        return markup.markdown_function("name", "signature", "doc", F.when(F.col("type_name") != "", F.col("type_name")), self.include_code_blocks)

    def function(self, options: WalkOptions) -> Column:
        return markup.markdown_function("name", "signature", "doc", None, self.include_code_blocks)

    def variable(self, options: WalkOptions) -> Column:
        return markup.markdown_value("var", "name", "type", "value", "doc", self.include_code_blocks)

    def constant(self, options: WalkOptions) -> Column:
        return markup.markdown_value("const", "name", "type", "value", "doc", self.include_code_blocks)


#: Our own look: a column of text, a coloured edge for each kind of element.
CSS = """
:root { --ink: #222; --paper: #fff; --soft: #f4f5f7; --edge: #c9ced6; --link: #1450a0; }
body { margin: 0 auto; max-width: 68rem; padding: 1.5rem; color: var(--ink); background: var(--paper); font: 1rem/1.55 system-ui, sans-serif; }
.header { border-bottom: 2px solid var(--edge); }
.version { opacity: 0.7; }
a { color: var(--link); }
.package { margin: 2rem 0 1rem; padding: 1rem; border: 1px solid var(--edge); }
.type, .function, .method, .variable, .constant { margin: 1rem 0; padding: 0.75rem 1rem; background: var(--soft); border-left: 0.3rem solid var(--edge); }
.type-struct { border-color: #3b8f4a; }
.type-interface { border-color: #2b6fc2; }
.type-alias { border-color: #c27a1a; }
.method { margin-left: 2rem; }
.doc-comment { font-style: italic; }
pre.code { overflow-x: auto; padding: 0.5rem; background: var(--paper); }
.keyword { font-weight: 600; color: #7a2a8f; }
.string { color: #5a6b00; }
"""


def _indent(text: Column, level: int) -> Column:
    """Every line of a text moved by ``level`` steps of two blanks."""
    step = "  " * level
    return F.concat(F.lit(step), F.replace(F.regexp_replace(text, "\n$", ""), F.lit("\n"), F.lit("\n" + step)), F.lit("\n"))


@dataclass(frozen=True)
class HtmlVisitor(Visitor):
    """A page with an index of packages, then each package with its members below
    it. include_css False leaves the style out; custom_css is put after it."""

    include_css: bool = True
    custom_css: str = ""

    def module(self, model: Model, options: WalkOptions) -> DataFrame:
        title = html_escape(F.lit(options.title)) if options.title else F.concat(F.lit("Documentation for "), html_escape("module_path"))
        style = f"  <style>\n{(CSS if self.include_css else '') + self.custom_css}</style>\n" if self.include_css or self.custom_css else ""
        link = F.concat(F.lit('        <li><a href="#'), sanitize_anchor("import_path"), F.lit('">'), html_escape("import_path"), F.lit("</a></li>\n"))
        index = visited_packages(model, options).withColumn("link", link).groupBy("module_path").agg(markup.ordered_text(["import_path"], "link").alias("links"))
        when = lambda c, text: F.when(F.coalesce(F.col(c), F.lit("")) != "", text).otherwise("")
        text = F.concat(
            F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n  <meta charset="UTF-8">\n  <meta name="viewport" content="width=device-width">\n  <title>'), title, F.lit(f"</title>\n{style}</head>\n<body>\n"),
            F.lit('  <div class="header">\n    <h1>'), title, F.lit("</h1>\n"), when("version", F.concat(F.lit('    <div class="version">'), html_escape("version"), F.lit("</div>\n"))), F.lit("  </div>\n"),
            F.lit('  <div class="module-info">\n    <p><strong>Path:</strong> '), html_escape("module_path"), F.lit("</p>\n"), when("go_version", F.concat(F.lit("    <p><strong>Go Version:</strong> "), html_escape("go_version"), F.lit("</p>\n"))), F.lit("  </div>\n"),
            F.lit('  <div class="package-index">\n    <h2>Packages</h2>\n      <ul>\n'), F.coalesce("links", F.lit("")), F.lit("      </ul>\n  </div>\n"),
        )
        return model.modules.join(index, "module_path", "left").select("module_path", text.alias("text"))

    def package(self, model: Model, options: WalkOptions) -> DataFrame:
        """Name, documentation, and links to its types and functions; methods are linked where functions list them."""
        private = F.lit(options.include_private)

        def listed(df: DataFrame, kind: str, title: str) -> DataFrame:
            link = F.concat(F.lit('        <li><a href="#'), sanitize_anchor(F.concat_ws(".", "import_path", "name")), F.lit('">'), html_escape("name"), F.lit("</a></li>\n"))
            link = F.when(F.col("is_exported") | private, link).otherwise("")  # a section is there even where all of its elements are private
            opening = F.lit(f'    <div class="{kind}s-section">\n      <h3>{title}</h3>\n      <ul class="{kind}-list">\n')
            return df.withColumn("link", link).groupBy("import_path").agg(F.concat(opening, markup.ordered_text(["name"], "link"), F.lit("      </ul>\n    </div>\n")).alias(f"{kind}s"))

        functions = model.functions if options.methods_as_functions else model.functions.filter("NOT is_method")
        p = visited_packages(model, options).join(listed(model.types, "type", "Types"), "import_path", "left").join(listed(functions, "function", "Functions"), "import_path", "left")
        note = F.when(F.coalesce("documentation", F.lit("")) != "", F.concat(F.lit('    <div class="doc-comment">'), doc_comment("documentation"), F.lit("</div>\n"))).otherwise("")
        empty = F.lit("")
        text = F.concat(F.lit('  <div id="'), sanitize_anchor("import_path"), F.lit('" class="package">\n    <h2 class="package-name">Package '), html_escape("name"), F.lit("</h2>\n"), note, F.coalesce("types", empty), F.coalesce("functions", empty), F.lit("  </div>\n"))
        return p.select("import_path", text.alias("text"))

    def type_(self, options: WalkOptions) -> Column:
        return _indent(markup.html_type("import_path", "name", "kind", "doc"), 1)

    def method(self, options: WalkOptions) -> Column:
        return _indent(markup.html_method("import_path", "type_name", "name", "signature", "doc"), 1)

    def function(self, options: WalkOptions) -> Column:
        return _indent(markup.html_function("import_path", "name", "signature", "doc"), 1)

    def variable(self, options: WalkOptions) -> Column:
        return _indent(markup.html_value("var", "import_path", "name", "type", "value", "doc"), 1)

    def constant(self, options: WalkOptions) -> Column:
        return _indent(markup.html_value("const", "import_path", "name", "type", "value", "doc"), 1)

    def closing(self) -> str:
        return "</body>\n</html>\n"


def markdown(model: Model, options: WalkOptions = WalkOptions(include_private=False), **choices) -> str:
    return Formatter(MarkdownVisitor(**choices), "markdown", "A module as Markdown", options).visualize(model)


def html(model: Model, options: WalkOptions = WalkOptions(title="Go Module Documentation"), **choices) -> str:
    return Formatter(HtmlVisitor(**choices), "html", "A module as an HTML page", options).visualize(model)


def create_html(model: Model) -> str:
    """The page with all defaults, titled by the module's path."""
    return html(model, WalkOptions())
