"""Models as nested JSON, read and written: a module is one document, or one row a package, or several of a large one."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.schema import DDL, Model, filled, rows
from quillstone.sources.batches import small_batches

_MEMBER = "Name:STRING,Signature:STRING,IsEmbedded:BOOLEAN,Doc:STRING"
_PARAM = "ARRAY<STRUCT<Name:STRING,Type:STRING,IsVariadic:BOOLEAN>>"
_VALUE = "MAP<STRING,STRUCT<Name:STRING,Type:STRING,Value:STRING,IsExported:BOOLEAN,Doc:STRING,File:STRING>>"
PACKAGE = (
    "STRUCT<Name:STRING,ImportPath:STRING,Dir:STRING,IsTest:BOOLEAN,Documentation:STRING,"
    f"Types:MAP<STRING,STRUCT<Name:STRING,Kind:STRING,Underlying:STRING,IsExported:BOOLEAN,Doc:STRING,File:STRING,Fields:ARRAY<STRUCT<Name:STRING,Type:STRING,Tag:STRING,IsEmbedded:BOOLEAN,Doc:STRING>>,Methods:ARRAY<STRUCT<{_MEMBER}>>,Interfaces:ARRAY<STRUCT<{_MEMBER}>>>>,"
    f"Functions:MAP<STRING,STRUCT<Name:STRING,Signature:STRING,Body:STRING,Doc:STRING,File:STRING,Receiver:STRUCT<Name:STRING,Type:STRING,IsPointer:BOOLEAN>,Parameters:{_PARAM},Results:{_PARAM},IsExported:BOOLEAN,IsMethod:BOOLEAN,IsTest:BOOLEAN>>,"
    f"Variables:{_VALUE},Constants:{_VALUE},"
    "Imports:MAP<STRING,STRUCT<Path:STRING,Name:STRING,IsBlank:BOOLEAN,Doc:STRING,File:STRING>>,"
    "Files:MAP<STRING,STRUCT<Path:STRING,Name:STRING,SourceCode:STRING,IsTest:BOOLEAN,IsGenerated:BOOLEAN>>>"
)
_PIN = "STRUCT<Path:STRING,Version:STRING>"
MODULE = f"STRUCT<Path:STRING,Version:STRING,GoVersion:STRING,Dir:STRING,GoMod:STRING,Packages:MAP<STRING,{PACKAGE}>,Dependencies:ARRAY<STRUCT<Path:STRING,Version:STRING,Indirect:BOOLEAN>>,`Replace`:ARRAY<STRUCT<Old:{_PIN},New:{_PIN}>>>"


class JsonError(ValueError):
    """A document that is no JSON object."""


#: Characters of JSON that a worker holds before it passes them on; declarations that a document of package_parts is to hold.
_HELD, PART = 1_000_000, 2048


def _speller(kind: T.DataType) -> Callable | None:
    """What gives a value its keys as ``kind`` spells them, whatever their case; keys of maps stay. None: values stay as they are."""
    if isinstance(kind, T.StructType):
        known = {f.name.lower(): (f.name, _speller(f.dataType)) for f in kind}
        exact = {name: (name, inner) for name, inner in known.values()}

        def struct(value):
            if not isinstance(value, dict):
                return value
            out = {}
            for k, v in value.items():
                at = exact.get(k) or known.get(k.lower())
                if at:
                    out[at[0]] = at[1](v) if at[1] else v
            return out

        return struct
    inner = _speller(kind.valueType) if isinstance(kind, T.MapType) else _speller(kind.elementType) if isinstance(kind, T.ArrayType) else None
    if inner is None:
        return None
    if isinstance(kind, T.MapType):
        return lambda value: {k: inner(v) for k, v in value.items()} if isinstance(value, dict) else value
    return lambda value: [inner(v) for v in value] if isinstance(value, list) else value


def read_modules(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row (module STRUCT) for each JSON document; a text that is no JSON object is an error. Map only."""
    small_batches(documents.sparkSession)
    module_t = T._parse_datatype_string(MODULE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = _speller(module_t)
        pack = lambda out: pa.record_batch([pa.array(out, pa.string())], ["text"])
        for batch in batches:
            out, held = [], 0
            for raw in batch.column(0):
                try:
                    value = json.loads(raw.as_py() or "")
                except json.JSONDecodeError as e:
                    raise JsonError(f"no JSON: {e}") from None
                if not isinstance(value, dict):
                    raise JsonError("a module is a JSON object")
                out.append(json.dumps(spell(value)))
                held += len(out[-1])
                if held >= _HELD:
                    yield pack(out)
                    out, held = [], 0
            if out:
                yield pack(out)

    return documents.select(text).mapInArrow(run, "text string").select(F.from_json("text", MODULE).alias("module"))


def _packages(modules: DataFrame) -> DataFrame:
    """(module_path, key, p STRUCT, import_path) of the packages of (module_path, Packages MAP)."""
    p = modules.select("module_path", F.explode(F.map_entries("Packages")).alias("e")).select("module_path", F.col("e.key").alias("key"), F.col("e.value").alias("p"))
    return p.withColumn("import_path", F.coalesce(F.when(F.col("p.ImportPath") != "", F.col("p.ImportPath")), F.col("key")))


def declared_in_json(documents: DataFrame, text: str = "text") -> DataFrame:
    """(kind, import_path, file_path, name, text, is_exported, doc) of each type, function, variable and constant in JSON modules.

    The rows are those of :func:`model_from_json`, whose tables each read all
    documents; here they are read once. text: a type's kind, a function's signature, a value.
    """
    p = _packages(read_modules(documents, text).select(F.coalesce("module.Path", F.lit("")).alias("module_path"), "module.Packages"))

    def of(kind: str, what: str, shown: str) -> Column:
        def row(e: Column) -> Column:
            d = e["value"]
            or_empty = lambda c: F.coalesce(d[c], F.lit(""))
            return F.struct(F.lit(kind).alias("kind"), or_empty("File").alias("file_path"), F.coalesce(F.when(d["Name"] != "", d["Name"]), e["key"]).alias("name"), or_empty(shown).alias("text"), F.coalesce(d["IsExported"], F.lit(False)).alias("is_exported"), or_empty("Doc").alias("doc"))

        made = F.transform(F.map_entries(f"p.{what}"), row)
        return F.when(F.col(f"p.{what}").isNotNull(), made).otherwise(F.array().cast("array<struct<kind:string,file_path:string,name:string,text:string,is_exported:boolean,doc:string>>"))

    found = F.concat(of("type", "Types", "Kind"), of("function", "Functions", "Signature"), of("variable", "Variables", "Value"), of("constant", "Constants", "Value"))
    return p.select("import_path", F.explode(found).alias("d")).select("d.kind", "import_path", "d.file_path", "d.name", "d.text", "d.is_exported", "d.doc")


def model_from_json(spark: SparkSession, documents: DataFrame | str, text: str = "text") -> Model:
    """The model of JSON modules. Keys are matched whatever their case; what is
    absent is '' or false, so that a type without IsExported isn't exported. A
    package may be spread over several documents, as package_parts does; ord
    then counts within each."""
    if isinstance(documents, str):
        documents = spark.createDataFrame([(documents,)], "text string")
    m = read_modules(documents, text).select("module.*").withColumn("module_path", F.coalesce("Path", F.lit("")))
    p = _packages(m)
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))

    def each(what: str) -> DataFrame:
        entries = F.array_sort(F.transform(F.map_keys(f"p.{what}"), lambda k: k))
        keys = p.select("import_path", F.posexplode(entries).alias("ord", "key"), F.col(f"p.{what}").alias("all"))
        out = keys.select("import_path", "ord", "key", F.element_at("all", F.col("key")).alias("d"))
        return out.withColumn("name", F.coalesce(F.when(F.col("d.Name") != "", F.col("d.Name")), F.col("key"))) if what != "Files" else out

    t = each("Types")
    member = lambda what, interface: t.select("import_path", F.col("name").alias("type_name"), F.posexplode(f"d.{what}").alias("ord", "m")).select(
        "import_path", "type_name", "ord", text_of("m.Name").alias("name"), text_of("m.Signature").alias("signature"), flag("m.IsEmbedded").alias("is_embedded"), F.lit(interface).alias("is_interface_method"), text_of("m.Doc").alias("doc")
    )
    fields = t.select("import_path", F.col("name").alias("type_name"), F.posexplode("d.Fields").alias("ord", "m")).select("import_path", "type_name", "ord", text_of("m.Name").alias("name"), text_of("m.Type").alias("type"), text_of("m.Tag").alias("tag"), flag("m.IsEmbedded").alias("is_embedded"), text_of("m.Doc").alias("doc"))
    param_t = T._parse_datatype_string(DDL["functions"])["parameters"].dataType
    zero = F.lit(0).cast("long")

    def params(c: str) -> Column:
        made = F.transform(F.col(c), lambda x: F.struct(F.coalesce(x["Name"], F.lit("")).alias("name"), F.coalesce(x["Type"], F.lit("")).alias("type"), F.coalesce(x["IsVariadic"], F.lit(False)).alias("is_variadic"), zero.alias("start_pos"), zero.alias("end_pos")))
        return F.coalesce(made.cast(param_t), F.array().cast(param_t))

    r = F.col("d.Receiver")
    receiver = F.when(r.isNotNull(), F.struct(F.coalesce(r["Name"], F.lit("")).alias("name"), F.coalesce(r["Type"], F.lit("")).alias("type"), F.coalesce(r["IsPointer"], F.lit(False)).alias("is_pointer"), zero.alias("start_pos"), zero.alias("end_pos")))
    functions = each("Functions").select("import_path", text_of("d.File").alias("file_path"), "ord", F.col("key").alias("func_key"), "name", text_of("d.Signature").alias("signature"), text_of("d.Body").alias("body"), text_of("d.Doc").alias("doc"), receiver.alias("receiver"), params("d.Parameters").alias("parameters"), params("d.Results").alias("results"), flag("d.IsExported").alias("is_exported"), (flag("d.IsMethod") | r.isNotNull()).alias("is_method"), flag("d.IsTest").alias("is_test"))
    value = lambda what: each(what).select("import_path", text_of("d.File").alias("file_path"), "ord", "name", text_of("d.Type").alias("type"), text_of("d.Value").alias("value"), flag("d.IsExported").alias("is_exported"), text_of("d.Doc").alias("doc"))
    found = {
        "modules": m.select("module_path", text_of("Version").alias("version"), text_of("GoVersion").alias("go_version"), text_of("Dir").alias("dir"), text_of("GoMod").alias("go_mod")),
        "packages": p.select("module_path", "import_path", text_of("p.Name").alias("name"), text_of("p.Dir").alias("dir"), text_of("p.Documentation").alias("documentation"), flag("p.IsTest").alias("is_test")).distinct(),
        "types": t.select("import_path", text_of("d.File").alias("file_path"), "ord", "name", text_of("d.Kind").alias("kind"), text_of("d.Underlying").alias("underlying"), flag("d.IsExported").alias("is_exported"), text_of("d.Doc").alias("doc")),
        "fields": fields,
        "methods": member("Methods", False).unionByName(member("Interfaces", True)),
        "functions": functions,
        "variables": value("Variables"),
        "constants": value("Constants"),
        "imports": each("Imports").select("import_path", text_of("d.File").alias("file_path"), "ord", F.coalesce(F.when(F.col("d.Path") != "", F.col("d.Path")), F.col("key")).alias("path"), text_of("d.Name").alias("name"), flag("d.IsBlank").alias("is_blank"), text_of("d.Doc").alias("doc")),
        "files": each("Files").select("import_path", F.coalesce("d.Path", "key").alias("file_path"), text_of("d.Name").alias("name"), text_of("d.SourceCode").alias("source_code"), flag("d.IsTest").alias("is_test"), flag("d.IsGenerated").alias("is_generated"), F.lit(False).alias("is_modified")),
        "dependencies": m.select("module_path", F.posexplode("Dependencies").alias("ord", "d")).select("module_path", "ord", text_of("d.Path").alias("path"), text_of("d.Version").alias("version"), flag("d.Indirect").alias("indirect")),
        "replaces": m.select("module_path", F.posexplode("Replace").alias("ord", "d")).select("module_path", "ord", F.col("d.Old").alias("old"), F.col("d.New").alias("new")),
    }
    return Model({k: filled(found[k], k) if k in found else rows(spark, k) for k in DDL})


def largest_package(model: Model) -> int:
    """How many entries the package with most of them has, repeated names included."""
    all_ = [model.tables[x].select("import_path") for x in ("types", "functions", "variables", "constants", "imports", "files")]
    return reduce(DataFrame.unionByName, all_).groupBy("import_path").count().agg(F.max("count")).first()[0] or 0


def package_views(model: Model) -> DataFrame:
    """(module_path, import_path, package STRUCT): the acyclic nested view. Where
    names repeat in a package the last declaration is shown, as in a map."""
    return package_parts(model, 1).drop("part")


def package_parts(model: Model, parts: int | None = None) -> DataFrame:
    """(module_path, import_path, part, package STRUCT): package_views with each
    package in several rows, if it is large. An entry is in one part, by its
    name; what a package says of itself is in all. Together the parts of a
    package are the whole: none is left out that has an entry, nor the first.
    parts: how many; as a rule as many as keep a part to PART entries or so,
    so that no text, and no row, grows with the package.
    """
    if parts is None:
        parts = 1 << max(0, (largest_package(model) - 1) // PART).bit_length()

    def entries(df: DataFrame, key: str, value: Column, name: str, order: tuple[str, Column] = ("file_path", F.col("ord"))) -> DataFrame:
        at = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")
        return df.select("import_path", at.alias("part"), F.lit(name).alias("section"), F.col(key).alias("key"), F.struct(F.col(order[0]).alias("a"), order[1].cast("int").alias("b")).alias("order"), value.alias(name))

    def shown(name: str) -> Column:
        each = F.collect_list(F.when(F.col("section") == name, F.struct("key", F.col(name).alias("value"))))
        made = F.map_from_entries(F.array_sort(each, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
        return F.when(F.size(each) > 0, made).alias(name)

    def listed(df: DataFrame, value: Column, name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct("ord", value.alias("v"))), lambda a, b: a["ord"] - b["ord"])
        return df.groupBy("import_path", "type_name").agg(F.transform(items, lambda x: x["v"]).alias(name))

    s = lambda **c: F.struct(*[F.col(v).alias(k) for k, v in c.items()])
    member = s(Name="name", Signature="signature", IsEmbedded="is_embedded", Doc="doc")
    of = ["import_path", "type_name"]
    t = model.types.withColumn("type_name", F.col("name"))
    t = t.join(listed(model.fields, s(Name="name", Type="type", Tag="tag", IsEmbedded="is_embedded", Doc="doc"), "fields"), of, "left")
    t = t.join(listed(model.methods.filter("NOT is_interface_method"), member, "methods"), of, "left").join(listed(model.methods.filter("is_interface_method"), member, "interfaces"), of, "left")
    type_ = s(Name="name", Kind="kind", Underlying="underlying", IsExported="is_exported", Doc="doc", File="file_path", Fields="fields", Methods="methods", Interfaces="interfaces")
    param = lambda c: F.transform(c, lambda x: F.struct(x["name"].alias("Name"), x["type"].alias("Type"), x["is_variadic"].alias("IsVariadic")))
    r = F.col("receiver")
    function = F.struct(
        F.col("name").alias("Name"), F.col("signature").alias("Signature"), F.col("body").alias("Body"), F.col("doc").alias("Doc"), F.col("file_path").alias("File"),
        F.when(r.isNotNull(), F.struct(r["name"].alias("Name"), r["type"].alias("Type"), r["is_pointer"].alias("IsPointer"))).alias("Receiver"),
        param("parameters").alias("Parameters"), param("results").alias("Results"), F.col("is_exported").alias("IsExported"), F.col("is_method").alias("IsMethod"), F.col("is_test").alias("IsTest"),
    )
    value = s(Name="name", Type="type", Value="value", IsExported="is_exported", Doc="doc", File="file_path")
    head = s(ModulePath="module_path", Name="name", ImportPath="import_path", Dir="dir", IsTest="is_test", Documentation="documentation")
    made = [
        model.packages.select("import_path", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit("Package").alias("section"), head.alias("Package")),
        entries(t, "name", type_, "Types"),
        entries(model.functions, "func_key", function, "Functions"),
        entries(model.variables, "name", value, "Variables"),
        entries(model.constants, "name", value, "Constants"),
        entries(model.imports, "path", s(Path="path", Name="name", IsBlank="is_blank", Doc="doc", File="file_path"), "Imports"),
        entries(model.files, "file_path", s(Path="file_path", Name="name", SourceCode="source_code", IsTest="is_test", IsGenerated="is_generated"), "Files", ("name", F.lit(0))),
    ]
    sections = ("Types", "Functions", "Variables", "Constants", "Imports", "Files")
    # one exchange serves both the choice of the last and the parts
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made).repartition("import_path", "part")
    w = Window.partitionBy("import_path", "part", "section", "key").orderBy(F.col("order").desc())
    last = every.withColumn("_rn", F.when(F.col("section") == "Package", 1).otherwise(F.row_number().over(w))).filter("_rn = 1")
    out = last.groupBy("import_path", "part").agg(F.collect_list("Package").alias("heads"), F.sum((F.col("section") != "Package").cast("int")).alias("n"), *map(shown, sections))
    out = out.filter("part = 0 OR n > 0").withColumn("h", F.explode("heads"))
    package = F.struct(*[F.col(f"h.{c}").alias(c) for c in ("Name", "ImportPath", "Dir", "IsTest", "Documentation")], *sections)
    return out.select(F.col("h.ModulePath").alias("module_path"), "import_path", "part", package.alias("package"))


def package_json(model: Model) -> DataFrame:
    """(import_path, json): one document for each package, for any number of them."""
    return package_views(model).select("import_path", F.to_json("package").alias("json"))


def module_json(model: Model, indent: int | None = 2) -> str:
    """The model's one module as a JSON text on the driver."""
    m = model.modules.first()
    out = {"Path": m.module_path, "Version": m.version, "GoVersion": m.go_version, "Dir": m.dir, "GoMod": m.go_mod}
    out["Packages"] = {r.import_path: json.loads(r.json) for r in package_json(model).orderBy("import_path").toLocalIterator()}
    out["Dependencies"] = [{"Path": r.path, "Version": r.version, "Indirect": r.indirect} for r in model.dependencies.orderBy("ord").collect()]
    pin = lambda x: {"Path": x.path, "Version": x.version}
    out["Replace"] = [{"Old": pin(r.old), "New": pin(r.new)} for r in model.replaces.orderBy("ord").collect()]
    return json.dumps(out, indent=indent, ensure_ascii=False)
