"""Markdown, HTML and source text of model rows, as Column expressions.

A document is an ordered join of its rows' texts within a package or file:
no group is larger than the document that is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import col, doc_comment, format_code, html_escape, kind_class, receiver_text, sanitize_anchor


def ordered_text(order: list[str], text: str) -> Column:
    """Aggregate: the rows' texts one after another, by ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text")))), lambda x: x["_text"]), "")


def _block(code: Column, fenced: bool) -> Column:
    return F.concat(F.lit("```go\n"), code, F.lit("\n```\n\n")) if fenced else F.lit("")


def _paragraph(text: Column) -> Column:
    return F.when(text != "", F.concat(text, F.lit("\n\n"))).otherwise("")


def markdown_module(path: Column | str) -> Column:
    return F.concat(F.lit("# Module "), col(path), F.lit("\n\n"))


def markdown_package(name: Column | str, documentation: Column | None = None) -> Column:
    return F.concat(F.lit("## Package "), col(name), F.lit("\n\n"), _paragraph(documentation) if documentation is not None else F.lit(""))


def markdown_type(name: Column | str, kind: Column | str, doc: Column | str, fenced: bool = True) -> Column:
    n, k = col(name), col(kind)
    return F.concat(F.lit("### Type: "), n, F.lit(" ("), k, F.lit(")\n\n"), _paragraph(col(doc)), _block(F.concat(F.lit("type "), n, F.lit(" "), k), fenced))


def markdown_function(name: Column | str, signature: Column | str, doc: Column | str, receiver: Column | str | None = None, fenced: bool = True) -> Column:
    """A function, or a method where ``receiver`` is given (null: without its type)."""
    n, s = col(name), col(signature)
    owner = F.lit("") if receiver is None else F.coalesce(F.concat(F.lit("("), col(receiver), F.lit(") ")), F.lit(""))
    title = F.concat(F.lit("### Function: " if receiver is None else "### Method: "), owner, n)
    code = F.concat(F.lit("**Signature:** `"), s, F.lit("`\n\n"), _block(F.concat(F.lit("func "), owner, n, s), fenced))
    return F.concat(title, F.lit("\n\n"), _paragraph(col(doc)), F.when(s != "", code).otherwise(""))


def markdown_value(word: str, name: Column | str, type_: Column | str, value: Column | str, doc: Column | str, fenced: bool = True) -> Column:
    """A variable (word 'var', shown without its value) or constant ('const')."""
    n, t, v = col(name), col(type_), col(value)
    title = {"var": "### Variable: ", "const": "### Constant: "}[word]
    facts = F.concat(F.lit("**Type:** "), t, F.lit("\n\n"))
    code = F.concat(F.lit(f"{word} "), n, F.lit(" "), t)
    if word == "const":
        facts, code = F.concat(facts, F.lit("**Value:** "), v, F.lit("\n\n")), F.concat(code, F.lit(" = "), v)
    return F.concat(F.lit(title), n, F.lit("\n\n"), _paragraph(col(doc)), facts, _block(code, fenced))


def value_line(word: str, name: Column | str, type_: Column | str, value: Column | str) -> Column:
    t, v = col(type_), col(value)
    return F.concat(F.lit(word + " "), col(name), F.when(t != "", F.concat(F.lit(" "), t)).otherwise(""), F.when(v != "", F.concat(F.lit(" = "), v)).otherwise(""))


def _html(anchor: Column, css: Column, title: Column, doc: Column, code: Column, word: str, part: str, nested_quotes: bool = True) -> Column:
    note = F.when(doc != "", F.concat(F.lit('  <div class="doc-comment">'), doc_comment(doc), F.lit("</div>\n"))).otherwise("")
    return F.concat(
        F.lit('<div id="'), sanitize_anchor(anchor), F.lit('" class="'), css, F.lit(f'">\n  <h4 class="{word}-name">'), html_escape(title), F.lit("</h4>\n"), note,
        F.lit(f'  <div class="{word}-{part}">\n    <pre class="code">'), format_code(code, nested_quotes), F.lit("</pre>\n  </div>\n</div>\n"),
    )


def html_type(import_path: Column | str, name: Column | str, kind: Column | str, doc: Column | str) -> Column:
    n = col(name)
    return _html(F.concat_ws(".", col(import_path), n), F.concat(F.lit("type "), kind_class(kind)), F.concat(F.lit("type "), n), col(doc), F.concat(F.lit("type "), n, F.lit(" "), col(kind)), "type", "def")


def html_function(import_path: Column | str, name: Column | str, signature: Column | str, doc: Column | str) -> Column:
    n = col(name)
    return _html(F.concat_ws(".", col(import_path), n), F.lit("function"), F.concat(F.lit("func "), n), col(doc), col(signature), "function", "signature")


def html_method(import_path: Column | str, type_name: Column | str, name: Column | str, signature: Column | str, doc: Column | str) -> Column:
    """A method below its type; 'receiver' stands for a type without a name."""
    t, n = col(type_name), col(name)
    owner = F.when(t == "", "receiver").otherwise(t)
    return _html(F.concat_ws(".", col(import_path), t, n), F.lit("method"), F.concat(F.lit("func ("), owner, F.lit(") "), n), col(doc), col(signature), "method", "signature")


def html_value(word: str, import_path: Column | str, name: Column | str, type_: Column | str, value: Column | str, doc: Column | str) -> Column:
    n, kind = col(name), {"var": "variable", "const": "constant"}[word]
    return _html(F.concat_ws(".", col(import_path), n), F.lit(kind), F.concat(F.lit(word + " "), n), col(doc), value_line(word, name, type_, value), kind, "def")


def commented(doc: Column | str) -> Column:
    """A doc text as line comments, every line of it; '' for none."""
    d = F.regexp_replace(col(doc), "\n$", "")
    return F.when(d != "", F.concat(F.lit("// "), F.replace(d, F.lit("\n"), F.lit("\n// ")), F.lit("\n"))).otherwise("")


def source_value(word: str, name: Column | str, type_: Column | str, value: Column | str, doc: Column | str) -> Column:
    return F.concat(commented(doc), value_line(word, name, type_, value), F.lit("\n\n"))


def source_function(name: Column | str, signature: Column | str, body: Column | str, receiver: Column | str, doc: Column | str) -> Column:
    r = receiver_text(receiver)
    owner = F.when(r != "", F.concat(F.lit("("), r, F.lit(") "))).otherwise("")
    return F.concat(commented(doc), F.lit("func "), owner, col(name), col(signature), F.lit(" {\n"), col(body), F.lit("}\n\n"))


def require_line(path: Column | str, version: Column | str, indirect: Column | str) -> Column:
    return F.concat(F.lit("\t"), col(path), F.lit(" "), col(version), F.when(col(indirect), " // indirect").otherwise(""), F.lit("\n"))
