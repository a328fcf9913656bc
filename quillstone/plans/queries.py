"""One query for each operator, over whole tables seen as a code model."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import functions as fn
from quillstone.operators import joins, mutate, patterns, positions, receivers, structure, transform
from quillstone.operators import tests as testing
from quillstone.render import documents, markup, report, scaffold, walk
from quillstone.schema import Model
from quillstone.sinks import source
from quillstone.sources import jsonmodel, loader
from quillstone.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _each(source, name: str, make) -> None:
    """A query that selects from one adapter."""
    QUERIES[name] = lambda s, d: source(s, d).select(*make())


def _joined(name: str, sep: str = ",") -> F.Column:
    return F.array_join(name, sep)


@query
def structure_summary(s, d):
    return structure.structure_summary(t.types(s, d))


@query
def structure_exported(s, d):
    return structure.exported_names(t.types(s, d))


@query
def structure_all(s, d):
    return structure.exported_names(t.types(s, d), include_private=True)


@query
def interfaces_list(s, d):
    return structure.interfaces(t.types(s, d))


def _first(df: DataFrame) -> str:
    """The full name that sorts first: there is one at every scale."""
    return df.agg(F.min(F.concat_ws(".", "import_path", "name")).alias("n")).first().n or ""


@query
def find_type(s, d):
    types = t.types(s, d)
    return structure.find_by_full_name(types, _first(types)).select("import_path", "name", "kind", "doc")


@query
def find_function(s, d):
    """The first declaration of that name."""
    functions = t.functions(s, d)
    return structure.find_by_full_name(functions, _first(functions)).select("import_path", "name", "file_path", "ord")


@query
def get_variable(s, d):
    """All declarations of a package's variable."""
    v = t.variables(s, d)
    path, _, name = _first(v).rpartition(".")
    return structure.find_by_name(v, path, name).select("import_path", "file_path", "name", "value")


@query
def associate_methods(s, d):
    """The receivers of a package's methods spell its type names, the pointers with '*'."""
    own = t.types(s, d).select("type_id", "import_path", "name")
    receiver = F.concat(F.when(F.col("type_id") % 3 == 0, "*").otherwise(""), "type_name")
    m = t.methods(s, d).join(own.withColumnRenamed("name", "type_name"), "type_id").select("import_path", receiver.alias("receiver_type"), "name", "signature", F.lit(True).alias("is_method"))
    return structure.associate_methods(m, own).select("import_path", "type_name", "name", "signature")


@query
def types_without_methods(s, d):
    return structure.types_without_methods(t.types(s, d), t.methods(s, d), "type_id").select("import_path", "name")


for _name in ("group_receivers", "receiver_summary", "methods_per_type", "base_type_groups", "extract_interfaces"):
    _f = getattr(receivers, _name)
    QUERIES["receivers_grouped" if _name == "group_receivers" else _name] = lambda s, d, f=_f: f(t.methods(s, d))


@query
def common_methods(s, d):
    return receivers.common_methods(t.methods(s, d))


@query
def common_by_name(s, d):
    return receivers.common_by_name(t.methods(s, d))


@query
def interface_code(s, d):
    """Code of the interfaces that patterns give."""
    lines = F.map_from_entries(F.transform("signatures", lambda x: F.struct(x, F.lit(""))))
    coded = patterns.named_patterns(_typed(s, d)).withColumn("code", fn.interface_code("interface_name", lines, "types"))
    return coded.select(_joined("signatures", ";").alias("signatures"), "code")


@query
def method_signatures(s, d):
    return receivers.method_signatures(t.methods(s, d), "T1")


def _typed(s, d):
    return t.typed_methods(s, d).select("import_path", "type_name", "name", "signature")


def _named(s, d, options=patterns.Options()):
    return patterns.named_patterns(_typed(s, d), options).withColumn("signatures", _joined("signatures", ";"))


@query
def method_patterns(s, d):
    p = patterns.method_patterns(_typed(s, d))
    return p.select(_joined("signatures", ";").alias("signatures"), F.array_join("owners.type_name", ",").alias("types"), F.size("owners").cast("long").alias("n_types"))


@query
def pattern_names(s, d):
    return _named(s, d).select("signatures", "interface_name")


@query
def pattern_targets(s, d):
    return _named(s, d, patterns.Options(target_package="asia/nation_2")).select("signatures", "target_package")


@query
def extract_new_interfaces(s, d):
    return patterns.new_interfaces(_typed(s, d), t.types(s, d)).select("target_package", "interface_name", _joined("signatures", ";").alias("signatures"))


for _name in fn.NAMING:
    QUERIES[f"naming_{_name}"] = lambda s, d, n=_name: _named(s, d, patterns.Options(naming=fn.naming_strategy(n))).select("signatures", "interface_name")


@query
def exclude_filters(s, d):
    o = patterns.Options(exclude_packages=("asia/nation_2", "africa/nation_0"), exclude_types=("Svc1Writer",), exclude_methods=("PROMO",))
    return patterns.without(_typed(s, d), o).select("import_path", "type_name", "name")


@query
def test_classify(s, d):
    return testing.classify(t.tests(s, d))


@query
def test_map(s, d):
    return testing.map_tests(t.tests(s, d), t.functions(s, d))


@query
def test_unmapped(s, d):
    return testing.unmapped(t.tests(s, d), t.functions(s, d)).select("import_path", "name")


@query
def has_benchmark(s, d):
    return testing.has_benchmark(t.tests(s, d), t.benchmarks(s, d))


@query
def missing_tests(s, d):
    return testing.missing_tests(t.tests(s, d), t.functions(s, d))


@query
def test_summary(s, d):
    return testing.test_summary(t.tests(s, d), t.benchmarks(s, d), t.functions(s, d))


@query
def test_patterns(s, d):
    return testing.test_patterns(t.tests(s, d), t.benchmarks(s, d))


def _has(s, d):
    """Functions with parameters and results by their size."""
    one = lambda n, kind: F.struct(F.lit(n).alias("name"), F.lit(kind).alias("type"), F.lit(False).alias("is_variadic"))
    none = F.array().cast("array<struct<name:string,type:string,is_variadic:boolean>>")
    k = F.col("p_size")
    results = F.when(k % 3 == 0, F.array(one("", "error"))).when(k % 3 == 1, F.array(one("", "int"), one("", "error"))).otherwise(none)
    return t.functions(s, d).withColumn("parameters", F.when(k % 2 == 0, F.array(one("a", "int"))).otherwise(none)).withColumn("results", results)


@query
def test_template(s, d):
    """A skeleton of each kind for every testable function that has no test."""
    f = _has(s, d)
    made = [scaffold.missing_scaffolds(t.tests(s, d), f, kind).withColumn("kind", F.lit(kind)) for kind in (*scaffold.KINDS, "unknown")]
    return reduce(DataFrame.unionByName, made)


@query
def position_lookup(s, d):
    return positions.element_at(t.probes(s, d), "pos", t.elements(s, d), ["file_path"]).select("probe", "kind", "name")


@query
def position_string(s, d):
    o, same = F.col("ord"), F.col("ord") % 3 == 0
    c = (o % 80).cast("string")
    line = F.when(o % 7 != 0, F.col("start_pos"))
    return t.elements(s, d).select("name", fn.position_text("file_path", line, c, F.when(same, F.col("start_pos")).otherwise(F.col("end_pos")), c).alias("position"))


@query
def line_column(s, d):
    """Of a place in every text; an empty text has its first, a null one none."""
    at = F.when(F.col("text").isNotNull(), 1 + F.coalesce(F.col("doc_id") * 31 % F.nullif(F.length("text"), F.lit(0)), F.lit(0))).cast("long")
    line, col = positions.line_column_in_text("text", at)
    return t.read(s, d, "documents").select("doc_id", at.alias("pos"), line.alias("line"), col.alias("col"))


@query
def test_log_parse(s, d):
    return testing.parse_logs(t.logs(s, d))


@query
def last_wins(s, d):
    return joins.last_wins(t.variables(s, d), ["import_path", "name"], ["file_path", "ord"]).select("import_path", "name", "value")


@query
def rename_variable(s, d):
    return transform.rename_rows(t.variables(s, d), "V4", "Global").select("import_path", "file_path", "name", "value", "is_exported")


@query
def rename_changes(s, d):
    return transform.rename_changes(t.variables(s, d), "V4", "Global")


@query
def chained_transform(s, d):
    """Files that a chain of two renames touches."""
    v = t.variables(s, d).select("import_path", "file_path", F.col("ord").cast("int"), "name", "type", "value", "is_exported", "doc", F.lit(0).cast("long").alias("start_pos"), F.lit(0).cast("long").alias("end_pos"))
    steps = transform.chain(transform.rename_variable("V4", "Global"), transform.rename_variable("v7", "local"))
    return steps(Model.of(s, variables=v))[1].files


def _pages(s, d):
    return t.read(s, d, "pages")


def _documents(s, d):
    return t.read(s, d, "documents")


_each(_pages, "html_escape", lambda: ["page_id", fn.html_escape("html").alias("escaped")])
_each(_documents, "doc_comment", lambda: ["doc_id", fn.doc_comment("text").alias("doc")])
_each(lambda s, d: t.read(s, d, "benchmark"), "format_code", lambda: ["item_id", fn.format_code(F.concat(F.lit("func F"), F.col("item_id").cast("string"), F.lit(' () { return "'), F.col("text"), F.lit('" }'))).alias("code")])
_each(_pages, "sanitize_anchor", lambda: ["page_id", fn.sanitize_anchor("url").alias("anchor")])
_each(t.types, "kind_class", lambda: ["name", fn.kind_class("kind").alias("css")])
_each(_documents, "split_csv", lambda: ["doc_id", F.array_join(fn.split_csv("text"), "|").alias("parts")])
_each(_pages, "env_vars", lambda: ["page_id", F.array_join(fn.parse_env(F.concat("url", F.lit(", A=1,,B=2 "))), "|").alias("env")])
_each(t.types, "relative_path", lambda: ["name", fn.relative_path("import_path", F.lit("asia")).alias("path")])
_each(t.variables, "exported", lambda: ["ord", fn.is_exported("name").alias("exported")])


@query
def signature_build(s, d):
    def of(n: str, kind: str, variadic: bool = False):
        return F.struct(F.lit(n).alias("name"), F.lit(kind).alias("type"), F.lit(variadic).alias("is_variadic"))

    none = F.array().cast("array<struct<name:string,type:string,is_variadic:boolean>>")
    k = F.col("p_size")
    params = F.when(k % 4 == 0, none).when(k % 4 == 1, F.array(of("a", "int"))).when(k % 4 == 2, F.array(of("a", "int"), of("b", "string", True))).otherwise(F.array(of("", "string")))
    results = F.when(k % 5 == 0, none).when(k % 5 == 1, F.array(of("", "error"))).when(k % 5 == 2, F.array(of("n", "int"))).when(k % 5 == 3, F.array(of("", "int"), of("", "error"))).otherwise(F.array(of("n", "int"), of("err", "error")))
    return t.read(s, d, "part").select("p_partkey", fn.signature(params, results).alias("signature"))


@query
def set_intersect(s, d):
    k = F.col("p_size")
    p = t.read(s, d, "part").select("p_partkey", F.array(k % 3, k % 5, k % 3).alias("second"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>").alias("first"))
    return p.select("p_partkey", F.array_join(receivers.intersect_keep("first", "second").cast("array<string>"), ",").alias("kept"))


@query
def set_except(s, d):
    b = t.benchmarks(s, d).select("import_path", F.substr("name", F.lit(10)).alias("name"))
    return t.functions(s, d).select("import_path", "name").subtract(b)


@query
def walk_counts(s, d):
    k = F.col("p_size")
    fields = t.read(s, d, "part").select(F.when(k % 2 == 0, "").when(k % 3 == 0, "Field").otherwise("field").alias("name"))
    v = t.variables(s, d)
    m = t.methods(s, d).withColumn("is_interface_method", F.lit(False))
    return structure.walk_counts(t.types(s, d), fields, m, t.functions(s, d), v, v.filter("NOT is_exported"), t.imports(s, d))


@query
def render_markdown(s, d):
    """Whole documents: a package each, with its types, functions, variables and constants."""
    return walk.package_documents(t.model(s, d), documents.MarkdownVisitor())


@query
def render_html(s, d):
    """A package each as HTML: its head with the lists of names, then its members."""
    return walk.package_documents(t.model(s, d), documents.HtmlVisitor())


@query
def render_go_source(s, d):
    """Whole source files: package clause, constants, variables, types, functions."""
    return source.source_files(t.model(s, d)).select("import_path", "file_path", "folder", "source", "changed")


@query
def render_gomod(s, d):
    return source.manifest_text(t.model(s, d))


@query
def parse_go_source(s, d):
    """Every file of the model printed, then parsed: the declarations that are found."""
    files = source.source_files(t.model(s, d)).select(F.concat_ws("|", "import_path", "file_path").alias("path"), F.col("source").alias("text"))
    d = loader.parse_declarations(files).filter("what <> 'imports'")
    what, fault = F.col("what"), F.col("what") == "error"
    text = F.when(fault, F.col("value")).when(what == "types", F.col("kind")).when(what == "functions", F.col("signature")).otherwise(F.concat_ws(" ", "type", "value"))
    return d.select(
        F.when(fault, what).otherwise(F.regexp_replace(what, "s$", "")).alias("kind"), F.when(fault, "").otherwise(F.substring_index("file_path", "|", 1)).alias("import_path"), F.when(fault, F.col("file_path")).otherwise(F.substring_index("file_path", "|", -1)).alias("file_path"),
        "name", text.alias("text"), (~fault & fn.is_exported_unicode("name")).alias("is_exported"), F.trim(F.replace("doc", F.lit("\n"), F.lit(" "))).alias("doc"),
    )


@query
def json_roundtrip(s, d):
    """Every package as JSON, a large one in several documents, and read again: what it declares, the last of each name."""
    texts = jsonmodel.package_parts(t.model(s, d)).select(F.to_json(F.struct(F.lit("demo").alias("Path"), F.create_map("import_path", "package").alias("Packages"))).alias("text"))
    return jsonmodel.declared_in_json(texts)


@query
def visit_counts(s, d):
    return walk.visit_counts(t.model(s, d))


@query
def structure_report(s, d):
    """The lines of the report on each package."""
    return report.structure_lines(t.model(s, d), include_private=True)


@query
def markdown_members(s, d):
    """Functions, methods, variables and constants as Markdown, a row each."""
    k = F.col("ord") % 3 == 0
    f = t.functions(s, d).withColumn("signature", F.when(k, "").otherwise("(x int)"))
    owner = F.when(F.col("is_exported"), "T")
    own = f.filter("is_method").select(F.lit("method").alias("kind"), "ord", markup.markdown_function("name", "signature", "doc", owner).alias("text"))
    plain = f.filter("NOT is_method").select(F.lit("function").alias("kind"), "ord", markup.markdown_function("name", "signature", "doc", fenced=False).alias("text"))
    v = t.variables(s, d).select(F.lit("variable").alias("kind"), "ord", markup.markdown_value("var", "name", "type", "value", "doc").alias("text"))
    c = t.constants(s, d).select(F.lit("constant").alias("kind"), F.col("ord").cast("long").alias("ord"), markup.markdown_value("const", "name", "type", "value", "doc").alias("text"))
    return own.unionByName(plain).unionByName(v).unionByName(c)


@query
def html_members(s, d):
    f = t.functions(s, d)
    own = f.filter("is_method").select(F.lit("method").alias("kind"), "ord", markup.html_method("import_path", F.lit("T<K>"), "name", F.lit("(x int)"), "doc").alias("html"))
    plain = f.filter("NOT is_method").select(F.lit("function").alias("kind"), "ord", markup.html_function("import_path", "name", F.lit("(x int)"), "doc").alias("html"))
    v = t.variables(s, d).select(F.lit("variable").alias("kind"), "ord", markup.html_value("var", "import_path", "name", "type", "value", "doc").alias("html"))
    c = t.constants(s, d).select(F.lit("constant").alias("kind"), F.col("ord").cast("long").alias("ord"), markup.html_value("const", "import_path", "name", "type", "value", "doc").alias("html"))
    return own.unionByName(plain).unionByName(v).unionByName(c)


@query
def receiver_texts(s, d):
    k = F.col("p_size")
    r = F.when(k % 5 == 0, None).otherwise(F.struct(F.when(k % 2 == 0, "r").otherwise("").alias("name"), F.col("p_type").alias("type"), (k % 3 == 0).alias("is_pointer")))
    return t.read(s, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", fn.receiver_text("r").alias("receiver"))


@query
def signature_split(s, d):
    m = t.methods(s, d).select("type_id", F.when(F.col("type_id") % 5 == 0, F.col("name")).otherwise(F.concat("name", "signature")).alias("full"))
    return m.select("type_id", "full", fn.signature_name("full").alias("name"), fn.signature_rest("full").alias("rest"))


@query
def visible_files(s, d):
    k = F.col("ord")
    files = t.functions(s, d).select("import_path", "file_path", "ord", (k % 3 == 0).alias("is_test"), (k % 4 == 0).alias("is_generated"))
    return structure.visible(files).select("import_path", "file_path", "ord")


@query
def struct_methods(s, d):
    """Methods of structs: the rows that pattern mining looks at."""
    structs = t.types(s, d).filter("kind = 'struct'").select("type_id", "import_path", F.col("name").alias("type_name"))
    return t.methods(s, d).join(structs, "type_id").select("import_path", "type_name", "name", "signature")


@query
def test_report(s, d):
    return testing.report_lines(t.tests(s, d), t.benchmarks(s, d), t.functions(s, d))


@query
def list_contains(s, d):
    """Membership: a flag in arguments, an element in a list, the types of a method."""
    k = F.col("p_size")
    args = F.array(F.lit("-v"), F.concat(F.lit("-run="), F.col("p_brand")), F.when(k % 2 == 0, "-short").otherwise("-race"))
    by_method = F.create_map(F.lit("Read"), F.array(F.lit("A"), F.lit("B")), F.col("p_type"), F.array(F.col("p_brand")))
    late = fn.late_sources(F.array(F.lit("A"), F.col("p_type")), F.array(F.lit("B"), F.lit("A")), F.array(F.lit("C")))
    return t.read(s, d, "part").select("p_partkey", fn.has_flag(args, "-short").alias("short"), fn.contains(args, F.lit("-v")).alias("verbose"), F.array_join(fn.types_for_method(by_method, "p_type"), ",").alias("types"), F.array_join(fn.types_for_method(by_method, F.lit("Close")), ",").alias("none"), F.array_join(late, ",").alias("sources"))


@query
def parents(s, d):
    """Declarations with their package and module."""
    m = t.model(s, d)
    return joins.with_parents(m, "variables").select("import_path", "name", "ord", "file_name", "package_name", "module_path")


@query
def upserted(s, d):
    """Variables after those of one name were put in anew: a row for each package and name."""
    v = t.model(s, d).variables
    new = v.withColumn("value", F.lit("new")).filter("name IN ('V4', 'v7')")
    return mutate.upsert(Model.of(s, variables=v), "variables", new).variables.select("import_path", "file_path", "name", "ord", "value")


@query
def chain_dry_run(s, d):
    """The changes that a chain of two renames would make."""
    v = t.model(s, d).variables
    steps = transform.chain(transform.rename_variable("V4", "Global", dry_run=True), transform.rename_variable("v7", "local", dry_run=True), dry_run=True)
    return steps(Model.of(s, variables=v))[1].changes
