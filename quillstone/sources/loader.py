"""A module's sources as a code model: files are parsed where they are read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import is_exported_unicode
from quillstone.schema import DDL, Model, filled, rows
from quillstone.sources import golang, gomod
from quillstone.sources.batches import small_batches


@dataclass(frozen=True)
class LoadOptions:
    """include_tests: with files of tests. load_docs: with comments. package_paths:
    import paths to load, '/...' at the end for all below; empty: all. build_tags:
    names that hold in build lines. placeholders: fixed texts in place of
    signatures, types and values ('any', '...'), the model's historical content;
    otherwise what the source says. include_generated, include_ast and
    dependency_depth are accepted and have no effect on loading."""

    include_tests: bool = False
    include_generated: bool = True
    include_ast: bool = False
    load_docs: bool = True
    dependency_depth: int = 0
    package_paths: tuple[str, ...] = ()
    build_tags: tuple[str, ...] = ()
    placeholders: bool = True


class LoadError(ValueError):
    """What was wrong with a module, all files together."""


def validate_path(path: str | Path, base: str | Path) -> Path:
    """The absolute path, if it is ``base`` or below it; an error otherwise."""
    whole = Path(path).resolve()
    if not whole.is_relative_to(Path(base).resolve()):
        raise LoadError(f"{path} is outside {base}")
    return whole


def safe_read(path: str | Path, base: str | Path) -> str:
    return validate_path(path, base).read_text(encoding="utf-8")


_PARAM = "ARRAY<STRUCT<name:STRING,type:STRING,is_variadic:BOOLEAN>>"
PARSED = (
    "path STRING, file_path STRING, source STRING, error STRING, built BOOLEAN, generated BOOLEAN, build_tags ARRAY<STRING>, line_starts ARRAY<BIGINT>, package STRING, doc STRING, package_pos BIGINT, stop BIGINT, "
    "imports ARRAY<STRUCT<path:STRING,name:STRING,doc:STRING,start:BIGINT,stop:BIGINT>>, "
    "types ARRAY<STRUCT<name:STRING,kind:STRING,params:STRING,alias:BOOLEAN,underlying:STRING,doc:STRING,start:BIGINT,stop:BIGINT,"
    "fields:ARRAY<STRUCT<names:ARRAY<STRING>,type:STRING,tag:STRING,doc:STRING,start:BIGINT,stop:BIGINT>>,"
    "methods:ARRAY<STRUCT<name:STRING,signature:STRING,embedded:STRING,doc:STRING,start:BIGINT,stop:BIGINT>>>>, "
    f"functions ARRAY<STRUCT<name:STRING,receiver:STRUCT<name:STRING,type:STRING,is_pointer:BOOLEAN,full:STRING>,parameters:{_PARAM},results:{_PARAM},signature:STRING,body:STRING,doc:STRING,start:BIGINT,stop:BIGINT>>, "
    "variables ARRAY<STRUCT<name:STRING,type:STRING,value:STRING,given:BOOLEAN,spec:STRING,doc:STRING,start:BIGINT,stop:BIGINT>>, "
    "constants ARRAY<STRUCT<name:STRING,type:STRING,value:STRING,given:BOOLEAN,spec:STRING,doc:STRING,start:BIGINT,stop:BIGINT>>"
)

DECLARED = "file_path STRING, what STRING, name STRING, kind STRING, signature STRING, type STRING, value STRING, doc STRING"
#: Characters of source, or declarations, whose rows a worker holds before it passes them on.
_HELD, _ROWS = 1_000_000, 4096


def parse_sources(sources: DataFrame, path: str = "path", text: str = "text", build_tags: tuple[str, ...] = ()) -> DataFrame:
    """One row for each source text, its declarations nested; see PARSED. Map only.

    A text that isn't Go has its fault in ``error`` and no declarations. Null
    texts are empty ones. Texts are UTF-8 strings or bytes.
    """
    spark = sources.sparkSession
    small_batches(spark)
    schema = T._parse_datatype_string(PARSED)
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for p, raw in _texts(batch):
                row = {"path": p, "file_path": p or "", "source": "", "error": None}
                try:
                    row["source"] = raw.decode("utf-8") if isinstance(raw, bytes) else raw or ""
                    name = row["file_path"].rsplit("/", 1)[-1]
                    row |= {"built": golang.is_built(name, row["source"], build_tags), "generated": golang.is_generated(row["source"]), "build_tags": golang.build_tags(row["source"]), "line_starts": golang.line_starts(row["source"])}
                    if row["built"]:
                        row |= golang.parse(row["source"])
                except (golang.GoSyntaxError, UnicodeDecodeError) as e:
                    row["error"] = str(e)
                out.append(row)
                held += len(row["source"])
                if len(out) == 64 or held >= _HELD:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return sources.select(path, text).mapInArrow(run, schema)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple]:
    return ((p.as_py(), t.as_py()) for p, t in zip(batch.column(0), batch.column(1), strict=True))


def parse_declarations(sources: DataFrame, path: str = "path", text: str = "text", build_tags: tuple[str, ...] = ()) -> DataFrame:
    """One row for each declaration of the source texts; see DECLARED. Map only.

    what: "types", "functions", "variables", "constants" or "imports" (name: the
    path); "error" for a text that isn't Go, with its fault as value, of which no
    declaration is given. kind is that of a type ("alias" too), signature a
    function's. A file's declarations are kept as columns until its end is seen;
    what isn't asked for is never made, so that a long file needs a few times its text.
    """
    small_batches(sources.sparkSession)
    names = [f.name for f in T._parse_datatype_string(DECLARED)]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)

    def of(file: str, source: str) -> Iterator[tuple]:
        for what, d in golang.declarations(source):
            kind = "alias" if d.get("alias") else d.get("kind", "")
            yield file, what, d["path"] if what == "imports" else d["name"], kind, d.get("signature", ""), d.get("type", ""), d.get("value", ""), d["doc"] or ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # of files that have ended
        for batch in batches:
            for p, raw in _texts(batch):
                file, own, packed = p or "", [], []
                try:
                    source = raw.decode("utf-8") if isinstance(raw, bytes) else raw or ""
                    if golang.is_built(file.rsplit("/", 1)[-1], source, build_tags):
                        for row in of(file, source):
                            own.append(row)
                            if len(own) == _ROWS:
                                packed.append(pack(own))
                                own = []
                except (golang.GoSyntaxError, UnicodeDecodeError) as e:
                    own, packed = [(file, "error", "", "", "", "", str(e), "")], []
                yield from packed
                done += own
                if len(done) >= _ROWS:
                    yield pack(done)
                    done = []
        if done:
            yield pack(done)

    return sources.select(path, text).mapInArrow(run, DECLARED)


def _each(parsed: DataFrame, what: str) -> DataFrame:
    return parsed.select("import_path", "file_path", "file_name", F.posexplode(what).alias("ord", "d"))


def model_of(parsed: DataFrame, import_path: Column, options: LoadOptions = LoadOptions()) -> Model:
    """The model's tables from parsed files; ``import_path`` of each file is an expression over its row."""
    spark = parsed.sparkSession
    p = parsed.filter("built AND error IS NULL").withColumn("import_path", import_path).withColumn("file_name", F.substring_index("file_path", "/", -1))
    text = lambda c, fixed: F.lit(fixed) if options.placeholders else F.col(c)
    doc = lambda c: F.coalesce(F.col(c), F.lit("")) if options.load_docs else F.lit("")
    where = [F.col("d.start").alias("start_pos"), F.col("d.stop").alias("end_pos")]
    is_test = F.col("file_name").endswith("_test.go")

    files = p.select(
        "import_path", "file_path", F.col("file_name").alias("name"), F.col("source").alias("source_code"), is_test.alias("is_test"), F.col("generated").alias("is_generated"),
        F.lit(False).alias("is_modified"), F.lit(1).cast("long").alias("base"), F.octet_length("source").cast("long").alias("size"), "line_starts", "build_tags",
    )
    imports = _each(p, "imports").select("import_path", "file_path", "ord", "d.path", "d.name", (F.col("d.name") == "_").alias("is_blank"), doc("d.doc").alias("doc"), *where)
    kind = F.col("d.kind") if options.placeholders else F.when(F.col("d.alias"), "alias").otherwise(F.col("d.kind"))
    name = F.col("d.name")
    types = _each(p, "types").select("import_path", "file_path", "ord", name.alias("name"), kind.alias("kind"), text("d.underlying", "").alias("underlying"), is_exported_unicode(name).alias("is_exported"), doc("d.doc").alias("doc"), *where, F.col("d.fields").alias("fields"), F.col("d.methods").alias("methods"))
    one = types.select("import_path", F.col("name").alias("type_name"), F.posexplode("fields").alias("ord", "d"))
    # placeholders name the first of several names only; otherwise each has a row
    names = F.when(F.size("d.names") == 0, F.array(F.lit(""))).otherwise(F.slice("d.names", 1, 1) if options.placeholders else F.col("d.names"))
    fields = one.select("*", F.explode(names).alias("name")).select("import_path", "type_name", "ord", "name", text("d.type", "any").alias("type"), "d.tag", (F.size("d.names") == 0).alias("is_embedded"), doc("d.doc").alias("doc"), *where)
    contract = types.select("import_path", F.col("name").alias("type_name"), F.posexplode("methods").alias("ord", "d"))
    inside = F.col("d.embedded") != ""
    contract = contract.select("import_path", "type_name", "ord", "d.name", F.when(inside, "").otherwise(text("d.signature", "func(...) ...")).alias("signature"), inside.alias("is_embedded"), F.lit(True).alias("is_interface_method"), doc("d.doc").alias("doc"), F.col("d.embedded").alias("embedded"), *where)
    param = T._parse_datatype_string(DDL["functions"])["parameters"].dataType
    zero = F.lit(0).cast("long")

    def params(c: str) -> Column:
        if options.placeholders:
            return F.array().cast(param)
        return F.transform(F.col(c), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["is_variadic"].alias("is_variadic"), zero.alias("start_pos"), zero.alias("end_pos")))

    r = F.col("d.receiver")
    receiver = F.when(r.isNotNull(), F.struct(r["name"].alias("name"), (r["type"] if options.placeholders else r["full"]).alias("type"), r["is_pointer"].alias("is_pointer"), zero.alias("start_pos"), zero.alias("end_pos")))
    signature = F.concat(F.lit("func "), name, F.lit("(...) {...}")) if options.placeholders else F.col("d.signature")
    body = F.lit("") if options.placeholders else F.coalesce("d.body", F.lit(""))
    functions = _each(p, "functions").select(
        "import_path", "file_path", "ord", name.alias("func_key"), name.alias("name"), signature.alias("signature"), body.alias("body"), doc("d.doc").alias("doc"), receiver.alias("receiver"), params("d.parameters").alias("parameters"),
        params("d.results").alias("results"), is_exported_unicode(name).alias("is_exported"), r.isNotNull().alias("is_method"), (name.startswith("Test") & is_test).alias("is_test"), *where,
    )
    base = F.regexp_replace("receiver.type", r"\[.*$", "")
    owners = types.select("import_path", F.col("name").alias("type_name")).distinct()
    own = functions.filter("is_method").withColumn("type_name", base).join(owners, ["import_path", "type_name"])
    own = own.select("import_path", "type_name", "ord", "name", "signature", F.lit(False).alias("is_embedded"), F.lit(False).alias("is_interface_method"), "doc", F.lit("").alias("embedded"), "start_pos", "end_pos")

    def values(what: str) -> DataFrame:
        value = F.when(F.col("d.given"), "...").otherwise("") if options.placeholders else F.col("d.value")
        return _each(p, what).select("import_path", "file_path", "ord", name.alias("name"), text("d.type", "any").alias("type"), value.alias("value"), is_exported_unicode(name).alias("is_exported"), doc("d.doc").alias("doc"), *where, text("d.spec", "").alias("spec"))

    packages = p.groupBy("import_path").agg(F.min_by("package", "file_name").alias("name"), F.min_by(F.regexp_replace("file_path", "/[^/]*$", ""), "file_name").alias("dir"), F.min_by("package_pos", "file_name").alias("start_pos"), F.max_by("stop", "file_name").alias("end_pos"))
    packages = packages.select("*", F.lit(False).alias("is_test"))
    found = {"packages": packages, "files": files, "imports": imports, "types": types, "fields": fields, "methods": contract.unionByName(own), "functions": functions, "variables": values("variables"), "constants": values("constants")}
    return Model({t: filled(found[t], t) if t in found else rows(spark, t) for t in DDL})


def load_module(spark: SparkSession, folder: str, options: LoadOptions = LoadOptions()) -> Model:
    """The module below ``folder``, which has its manifest go.mod.

    ``folder`` is a local path or the URI of any file system that Spark reads.
    Files are listed and parsed by the executors, one by one; folders whose
    names begin with '.' or '_', and those called testdata or vendor, are not
    part of a module. A file that can't be parsed makes the whole load fail,
    with all faults. Test files are left out before they are parsed.
    Positions are byte offsets in their file plus one.
    """
    if "://" in folder:
        root, shown = folder.rstrip("/"), folder
        found = spark.read.text(f"{root}/go.mod", wholetext=True).first()
        if found is None:
            raise LoadError(f"no go.mod in {folder}")
        manifest_text = found[0]
    else:
        path = Path(folder).resolve()
        if not (path / "go.mod").is_file():
            raise LoadError(f"no go.mod in {folder}")
        manifest_text, root, shown = safe_read(path / "go.mod", path), f"file://{path}", str(path)
    try:
        manifest = gomod.parse(manifest_text)
    except gomod.ManifestError as e:
        raise LoadError(f"go.mod: {e}") from None
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.go").load(root)
    prefix = root.replace("file:///", "file:/")
    relative = F.regexp_replace(F.substring(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(len(prefix) + 1), F.length("path")), "^/+", "")
    listed = listed.select(relative.alias("path"), F.col("content").alias("text")).filter(~F.col("path").rlike(r"(^|/)([._][^/]*|testdata|vendor)/"))
    if not options.include_tests:
        listed = listed.filter(~F.col("path").endswith("_test.go"))
    if options.package_paths:
        listed = listed.filter(_wanted(options.package_paths, _import_path(manifest.path, F.col("path"))))
    parsed = parse_sources(listed, build_tags=options.build_tags).persist(StorageLevel.MEMORY_AND_DISK)
    faults = parsed.filter("error IS NOT NULL").select("file_path", "error")
    first = faults.orderBy("file_path").limit(20).collect()
    if first:
        raise LoadError("; ".join(f"{r.file_path}: {r.error}" for r in first) + (f"; {faults.count() - 20} more" if len(first) == 20 and faults.count() > 20 else ""))
    model = model_of(parsed, _import_path(manifest.path, F.col("file_path")), options)
    return model.with_tables(
        modules=rows(spark, "modules", [{"module_path": manifest.path, "go_version": manifest.go_version, "dir": shown, "go_mod": manifest_text, "build_tags": list(options.build_tags)}]),
        dependencies=rows(spark, "dependencies", [{"module_path": manifest.path, "ord": i, "path": p, "version": v, "indirect": x} for i, (p, v, x) in enumerate(manifest.requires)]),
        replaces=rows(spark, "replaces", [{"module_path": manifest.path, "ord": i, "old": {"path": a, "version": b}, "new": {"path": c, "version": d}} for i, (a, b, c, d) in enumerate(manifest.replaces)]),
        packages=model.packages.withColumn("module_path", F.lit(manifest.path)),
    )


def _import_path(module_path: str, path: Column) -> Column:
    """Of a file: the module's path and the file's folder."""
    return F.when(path.contains("/"), F.concat(F.lit(module_path + "/"), F.regexp_replace(path, "/[^/]*$", ""))).otherwise(F.lit(module_path))


def _wanted(patterns: tuple[str, ...], import_path: Column) -> Column:
    out = F.lit(False)
    for p in patterns:
        p = p.rstrip("/")
        if p in ("./...", "..."):
            return F.lit(True)
        if p.startswith("./"):
            out |= import_path.endswith(p[1:].removesuffix("/...")) | (import_path.contains(p[1:].removesuffix("...")) if p.endswith("...") else F.lit(False))
        elif p.endswith("/..."):
            out |= (import_path == p[:-4]) | import_path.startswith(p[:-3])
        else:
            out |= import_path == p
    return out
