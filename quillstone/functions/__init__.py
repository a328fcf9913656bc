"""Scalar functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIXES = ("Reader", "Writer", "Handler", "Processor", "Service", "Controller")
KEYWORDS = ("func", "type", "struct", "interface", "package", "import", "const", "var", "return")

TABLE_TEST = r"(?i)(table|test(case|data)s?|cases|fixtures|scenarios|inputs|examples).*(\[\]|(?<![0-9A-Za-z_])map(?![0-9A-Za-z_]))"
PARALLEL = r"t\.Parallel\(\)"
BDD = r"(?i)(given|when|then|should|expect|assert)"
LOG_TEST = r"--- (PASS|FAIL): (Test[0-9A-Za-z_]+)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def is_exported(name: Column | str) -> Column:
    """ASCII capital first."""
    return col(name).rlike("^[A-Z]")


def is_exported_unicode(name: Column | str) -> Column:
    """Any capital letter first, as the language itself says."""
    return col(name).rlike(r"^\p{Lu}")


def normalize_receiver(t: Column | str) -> Column:
    """Without one leading '*', one '(' and one trailing ')'."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(t), r"^\*", ""), r"^\(", ""), r"\)$", "")


def is_pointer(t: Column | str) -> Column:
    return col(t).startswith("*")


def html_escape(x: Column | str) -> Column:
    out = lit_replace(col(x), "\0", "�")
    for old, new in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        out = lit_replace(out, old, new)
    return out


def doc_comment(x: Column | str) -> Column:
    return lit_replace(html_escape(x), "\n", "<br>")


def kind_class(kind: Column | str) -> Column:
    k = col(kind)
    return F.when(k.isin("struct", "interface", "alias"), F.concat(F.lit("type-"), k)).otherwise("type-other")


def format_code(x: Column | str, nested_quotes: bool = True) -> Column:
    """Highlighted code. nested_quotes keeps the historical output, in which the
    quotes of the keyword marks are themselves marked as strings."""
    out = html_escape(x)
    for k in KEYWORDS:
        out = lit_replace(out, f"{k} ", f'<span class="keyword">{k}</span> ')
    if not nested_quotes:
        return out
    parts = F.split(out, '"')
    return F.array_join(F.transform(parts, lambda v, i: F.when(i % 2 == 1, F.concat(F.lit('<span class="string">"'), v, F.lit('"</span>'))).otherwise(v)), "")


def sanitize_anchor(x: Column | str) -> Column:
    out = F.lower(col(x))
    for c in " ./":
        out = lit_replace(out, c, "-")
    return out


def test_target(name: Column | str) -> Column:
    n = col(name)
    return F.when(n.startswith("Test"), F.substr(n, F.lit(5))).otherwise(n)


def lower_first(x: Column | str) -> Column:
    return F.concat(F.lower(F.substring(col(x), 1, 1)), F.substr(col(x), F.lit(2)))


def is_table_test(body: Column | str) -> Column:
    return col(body).rlike(TABLE_TEST)


def is_parallel(body: Column | str) -> Column:
    return col(body).rlike(PARALLEL)


def is_bdd(body: Column | str) -> Column:
    return col(body).rlike(BDD)


def log_tests(output: Column | str) -> Column:
    return F.regexp_extract_all(col(output), F.lit(LOG_TEST), F.lit(2))


def log_count(output: Column | str, verdict: str) -> Column:
    return F.regexp_count(col(output), F.lit(f"--- {verdict}: "))


def _items(a: Column, variadic: bool) -> Column:
    def one(p: Column) -> Column:
        name = F.when(p["name"] != "", F.concat(p["name"], F.lit(" "))).otherwise("")
        dots = F.when(p["is_variadic"], "...").otherwise("") if variadic else F.lit("")
        return F.concat(name, dots, p["type"])

    return F.array_join(F.transform(a, one), ", ")


def return_type(results: Column | str) -> Column:
    r = col(results)
    return F.when(F.size(r) > 1, F.concat(F.lit("("), _items(r, False), F.lit(")"))).when(F.size(r) == 1, F.get(r, F.lit(0))["type"]).otherwise("")


def signature(parameters: Column | str, results: Column | str) -> Column:
    """(params) results; several results in parentheses, one named result as ' name type'."""
    p, r = col(parameters), col(results)
    tail = F.when(F.size(r) > 1, F.concat(F.lit(" ("), _items(r, False), F.lit(")"))).when(F.size(r) == 1, F.concat(F.lit(" "), _items(r, False))).otherwise("")
    return F.concat(F.lit("("), F.coalesce(_items(p, True), F.lit("")), F.lit(")"), tail)


def signature_name(s: Column | str) -> Column:
    return F.substring_index(col(s), "(", 1)


def signature_rest(s: Column | str) -> Column:
    """What follows the name, with its parenthesis; '' where there is none."""
    s = col(s)
    return F.when(F.instr(s, "(") > 0, F.substr(s, F.instr(s, "("))).otherwise("")


def interface_code(name: Column | str, methods: Column | str, sources: Column | str) -> Column:
    """Text of an interface from a name, a map of method to signature, and source types."""
    m = col(methods)
    lines = F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(F.lit("\t"), k, m[k], F.lit("\n"))), "")
    return F.concat(F.lit("// "), col(name), F.lit(" represents common behavior implemented by: "), F.array_join(col(sources), ", "), F.lit("\ntype "), col(name), F.lit(" interface {\n"), lines, F.lit("}"))


def method_interface_name(method: Column | str) -> Column:
    """The verb's agent noun: Read, Reader; Write, Writer."""
    m = col(method)
    return F.concat(m, F.when(m.endswith("e"), "r").otherwise("er"))


def common_suffix(names: Column | str) -> Column:
    """The first known suffix that half of the names or more end in, else null."""
    n = col(names)
    out = F.lit(None).cast("string")
    for s in reversed(SUFFIXES):
        out = F.when((F.size(n) > 0) & (F.size(F.filter(n, _ends(s))) * 2 >= F.size(n)), s).otherwise(out)
    return out


def _ends(suffix: str):
    return lambda x: x.endswith(suffix)


def interface_name(types: Column | str, signatures: Column | str) -> Column:
    """Default name of an extracted interface."""
    first = F.get(col(signatures), F.lit(0))
    return F.coalesce(common_suffix(types), F.when((F.size(col(types)) > 0) & first.isNotNull(), method_interface_name(signature_name(first))), F.lit("Common"))


def naming_default(types: Column | str, signatures: Column | str) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.get(col(types), F.lit(0)), "Impl$", ""), "Implementation$", "")
    return F.coalesce(F.concat(base, F.lit("Interface")), F.lit("Interface"))


def naming_prefix(types: Column | str, signatures: Column | str) -> Column:
    word = F.regexp_extract(F.get(col(signatures), F.lit(0)), "[A-Za-z0-9]+", 0)
    return F.when(F.coalesce(word, F.lit("")) != "", F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)), F.lit("er"))).otherwise("Interface")


def naming_suffix(types: Column | str, signatures: Column | str) -> Column:
    hit = F.filter(col(types), lambda x: x.rlike("(Handler|Service|Repository)$"))
    return F.when(F.size(hit) > 0, F.regexp_extract(F.get(hit, F.lit(0)), "(Handler|Service|Repository)$", 1)).otherwise("Interface")


NAMING = {"default": naming_default, "prefix": naming_prefix, "suffix": naming_suffix}


def naming_strategy(name: str):
    return NAMING.get(name, naming_default)


def split_csv(s: Column | str) -> Column:
    """Trimmed parts; null for ''."""
    s = col(s)
    return F.when(s != "", F.transform(F.split(s, ","), lambda x: F.trim(x)))


def parse_env(s: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(s), ","), lambda x: F.trim(x)), lambda x: x != "")


def relative_path(import_path: Column | str, module_path: Column | str) -> Column:
    p, m = col(import_path), col(module_path)
    rest = F.substr(p, F.length(m) + 1)
    return F.when(F.startswith(p, m), F.regexp_replace(rest, "^/", "")).otherwise(p)


def position_text(file: Column | str, l1: Column | str, c1: Column | str, l2: Column | str, c2: Column | str) -> Column:
    """file:line:col, with the end where it differs; a fixed text for no position."""
    f, a, b, c, d = (col(x) for x in (file, l1, c1, l2, c2))
    one = F.concat_ws(":", f, a.cast("string"), b.cast("string"))
    two = F.concat(one, F.lit("-"), c.cast("string"), F.lit(":"), d.cast("string"))
    return F.when(a.isNull(), "<unknown position>").when((a == c) & (b == d), one).otherwise(two)


def receiver_text(r: Column | str) -> Column:
    """Receiver as source text: 'r *T', 'r T', '*T', 'T', or '' for none."""
    r = col(r)
    t = F.concat(F.when(r["is_pointer"], "*").otherwise(""), r["type"])
    return F.when(r.isNull(), "").when(r["name"] == "", t).otherwise(F.concat(r["name"], F.lit(" "), t))


def has_flag(args: Column | str, flag: str) -> Column:
    """Whether an argument list holds a flag as it is; false for no list."""
    return F.coalesce(F.array_contains(col(args), flag), F.lit(False))


def contains(items: Column | str, item: Column | str) -> Column:
    """Whether a list has an element; false for no list."""
    return F.coalesce(F.array_contains(col(items), col(item)), F.lit(False))


def types_for_method(by_method: Column | str, method: Column | str) -> Column:
    """The types that a map of method to types has for one method; none where it has not."""
    m = col(by_method)
    return F.coalesce(F.try_element_at(m, col(method)), F.array().cast("array<string>"))


def late_sources(sources: Column | str, readers: Column | str, writers: Column | str) -> Column:
    """Source types with those of two further methods that aren't among them yet, order kept."""
    return F.array_distinct(F.concat(col(sources), col(readers), col(writers)))


def upper_first(x: Column | str) -> Column:
    return F.concat(F.upper(F.substring(col(x), 1, 1)), F.substr(col(x), F.lit(2)))
