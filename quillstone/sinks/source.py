"""Go source and manifest texts of a model, and the files they make."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quillstone.functions import relative_path
from quillstone.render.markup import commented, ordered_text, receiver_text, require_line
from quillstone.schema import Model


@dataclass(frozen=True)
class SaveOptions:
    """organize_imports: imports sorted by path, repeated ones once. create_backups:
    a file that is there already is kept as NAME.bak. only_modified: files that
    aren't modified are not written. Files that aren't modified keep their own
    source. format, gofmt, use_tabs and tab_width are accepted and have no
    effect: texts are tab-indented as they are made, and no formatter is run."""

    format: bool = True
    organize_imports: bool = True
    gofmt: bool = True
    use_tabs: bool = True
    tab_width: int = 8
    force: bool = False
    create_backups: bool = False
    only_modified: bool = False


def _line(text: Column, doc: str = "doc") -> Column:
    return F.concat(commented(doc), text)


def _value(word: str) -> Column:
    """'const N T = V'. spec: several names of one value; '-' where another row has it."""
    names = F.when(F.coalesce("spec", F.lit("")) == "", F.col("name")).otherwise(F.col("spec"))
    out = F.concat(F.lit(f"{word} "), names, F.when(F.col("type") != "", F.concat(F.lit(" "), "type")).otherwise(""), F.when(F.col("value") != "", F.concat(F.lit(" = "), "value")).otherwise(""), F.lit("\n\n"))
    return F.when(F.coalesce("spec", F.lit("")) == "-", "").otherwise(_line(out))


def declaration_texts(model: Model, options: SaveOptions = SaveOptions()) -> DataFrame:
    """(import_path, file_path, section, ord, text): each declaration as source, to be put together by section and ord."""
    key = ["import_path", "file_path"]
    quoted = F.concat(F.lit("\t"), F.when(F.col("is_blank"), "_ ").when(F.col("name") != "", F.concat("name", F.lit(" "))).otherwise(""), F.lit('"'), "path", F.lit('"\n'))
    imports = model.imports
    if options.organize_imports:
        imports = imports.dropDuplicates([*key, "path", "name"])
    order = [F.col("path"), F.col("name")] if options.organize_imports else [F.col("ord")]
    lines = imports.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, quoted.alias("t")))), lambda x: x["t"]), "").alias("lines"))
    imported = lines.select(*key, F.lit(1).alias("section"), F.lit(0).alias("ord"), F.concat(F.lit("import (\n"), "lines", F.lit(")\n\n")).alias("text"))
    tag = F.when(F.coalesce("tag", F.lit("")) != "", F.concat(F.lit(" "), "tag")).otherwise("")
    field = F.concat(_indented("doc"), F.lit("\t"), F.when(F.col("is_embedded"), "").otherwise(F.concat("name", F.lit(" "))), "type", tag, F.lit("\n"))
    of_type = ["import_path", "type_name"]
    fields = model.fields.withColumn("t", field).groupBy(*of_type).agg(ordered_text(["ord", "name"], "t").alias("fields"))
    base = F.when(F.col("name") != "", F.col("name")).otherwise(F.coalesce("embedded", F.lit("")))
    member = F.concat(_indented("doc"), F.lit("\t"), F.when(F.col("is_embedded"), base).otherwise(F.concat("name", "signature")), F.lit("\n"))
    members = model.methods.filter("is_interface_method").withColumn("t", member).groupBy(*of_type).agg(ordered_text(["ord", "name"], "t").alias("members"))
    t = model.types.withColumn("type_name", F.col("name")).join(fields, of_type, "left").join(members, of_type, "left")
    head = F.concat(F.lit("type "), "name", F.lit(" "))
    empty = F.lit("")
    body = (
        F.when(F.col("kind") == "struct", F.concat(F.lit("struct {\n"), F.coalesce("fields", empty), F.lit("}")))
        .when(F.col("kind") == "interface", F.concat(F.lit("interface {\n"), F.coalesce("members", empty), F.lit("}")))
        .when(F.col("kind") == "alias", F.concat(F.lit("= "), "underlying"))
        .otherwise(F.col("underlying"))
    )
    types = t.select(*key, F.lit(4).alias("section"), "ord", _line(F.concat(head, body, F.lit("\n\n"))).alias("text"))
    owner = F.when(F.col("is_method"), F.concat(F.lit("("), receiver_text("receiver"), F.lit(") "))).otherwise("")
    inside = F.when(F.col("body") != "", F.col("body")).otherwise(F.lit("\t// Implementation\n"))
    function = F.concat(F.lit("func "), owner, "name", "signature", F.lit(" {\n"), inside, F.lit("}\n\n"))
    functions = model.functions.select(*key, F.lit(5).alias("section"), "ord", _line(function).alias("text"))
    consts = model.constants.select(*key, F.lit(2).alias("section"), "ord", _value("const").alias("text"))
    variables = model.variables.select(*key, F.lit(3).alias("section"), "ord", _value("var").alias("text"))
    return reduce(DataFrame.unionByName, [imported, consts, variables, types, functions])


def _indented(doc: str) -> Column:
    """A doc text as comments within a type."""
    c = commented(F.coalesce(F.col(doc), F.lit("")))
    return F.when(c != "", F.concat(F.lit("\t"), F.replace(F.regexp_replace(c, "\n$", ""), F.lit("\n"), F.lit("\n\t")), F.lit("\n"))).otherwise("")


def is_modified(model: Model) -> DataFrame:
    """(import_path, file_path, changed): files to write anew. A file without a source of its own is."""
    return model.files.select("import_path", "file_path", (F.col("is_modified") | (F.coalesce("source_code", F.lit("")) == "")).alias("changed"))


def source_files(model: Model, options: SaveOptions = SaveOptions()) -> DataFrame:
    """(import_path, file_path, name, folder, source, changed) of every file of the model.

    folder is relative to the module's. A file's text is put together from its
    own declarations: no group is larger than a file.
    """
    texts = declaration_texts(model, options).groupBy("import_path", "file_path").agg(ordered_text(["section", "ord"], "text").alias("body"))
    names = model.packages.select("import_path", F.col("name").alias("package"), "module_path")
    f = model.files.join(names, "import_path").join(texts, ["import_path", "file_path"], "left")
    made = F.concat(F.lit("package "), "package", F.lit("\n\n"), F.coalesce("body", F.lit("")))
    changed = F.col("is_modified") | (F.coalesce("source_code", F.lit("")) == "")
    return f.select("import_path", "file_path", "name", relative_path("import_path", "module_path").alias("folder"), F.when(changed, made).otherwise(F.col("source_code")).alias("source"), changed.alias("changed"))


def manifest_text(model: Model) -> DataFrame:
    """(module_path, text): the manifest of each module of the model."""
    one = model.dependencies.withColumn("t", require_line("path", "version", "indirect")).groupBy("module_path").agg(ordered_text(["ord", "path"], "t").alias("required"))
    new = F.col("new.version")
    line = F.concat(F.lit("\t"), F.col("old.path"), F.when(F.coalesce(F.col("old.version"), F.lit("")) != "", F.concat(F.lit(" "), F.col("old.version"))).otherwise(""), F.lit(" => "), F.col("new.path"), F.when(F.coalesce(new, F.lit("")) != "", F.concat(F.lit(" "), new)).otherwise(""), F.lit("\n"))
    two = model.replaces.withColumn("t", line).groupBy("module_path").agg(ordered_text(["ord"], "t").alias("replaced"))
    block = lambda word, c: F.coalesce(F.concat(F.lit(f"\n{word} (\n"), c, F.lit(")\n")), F.lit(""))
    return model.modules.join(one, "module_path", "left").join(two, "module_path", "left").select("module_path", F.concat(F.lit("module "), "module_path", F.lit("\n"), F.when(F.col("go_version") != "", F.concat(F.lit("\ngo "), "go_version", F.lit("\n"))).otherwise(""), block("require", F.col("required")), block("replace", F.col("replaced"))).alias("text"))


def write_text(path: str, text: str, backup: bool = False) -> None:
    """Writes under another name and moves, so that a repeated task leaves the same file."""
    import os
    import uuid

    os.makedirs(os.path.dirname(path), mode=0o750, exist_ok=True)
    if backup and os.path.exists(path):
        os.replace(path, path + ".bak")
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(os.open(tmp, os.O_WRONLY | os.O_CREAT, 0o600), "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, path)


def save_to(model: Model, folder: str, options: SaveOptions = SaveOptions()) -> None:
    """The model's one module as files below ``folder``: manifest, then packages.

    All texts are made before the first is written. ``folder`` is a path that
    driver and executors share; the executors write the files they made.
    """
    manifests = manifest_text(model).collect()  # a row for each module
    if len(manifests) != 1:
        raise ValueError(f"a model of one module is wanted, this has {len(manifests)}")
    files = source_files(model, options)
    if options.only_modified:
        files = files.filter("changed")
    files = files.persist()
    if files.filter("source IS NULL OR name IS NULL OR name LIKE '%/%' OR folder LIKE '%..%'").count():
        raise ValueError("a file has no source, or a name that leads out of its folder")
    backups = options.create_backups

    def write(rows: Iterator[Row]) -> None:
        for r in rows:
            write_text("/".join(x for x in (folder, r.folder, r.name) if x), r.source, backups)

    write_text(f"{folder}/go.mod", manifests[0].text)
    files.foreachPartition(write)
    files.unpersist()


def save(model: Model, options: SaveOptions = SaveOptions()) -> None:
    """Saves in place, to the folder the module was loaded from."""
    save_to(model, model.modules.first().dir, options)
