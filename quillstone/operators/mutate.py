"""Changes of a model: rows put in, upserts, receivers, parameters, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.joins import last_wins
from quillstone.schema import DDL, Model, filled, rows

#: What names a row within its table.
KEYS = {
    "modules": ["module_path"],
    "packages": ["module_path", "import_path"],
    "files": ["import_path", "file_path"],
    "types": ["import_path", "name"],
    "functions": ["import_path", "func_key"],
    "variables": ["import_path", "name"],
    "constants": ["import_path", "name"],
    "imports": ["import_path", "file_path", "path"],
    "dependencies": ["module_path", "path"],
}


def append(model: Model, table: str, data: list[dict] | DataFrame) -> Model:
    """Rows at the end of a file's declarations: nothing is replaced; the file and its package count as modified."""
    new = filled(data, table) if isinstance(data, DataFrame) else rows(model.tables[table].sparkSession, table, data)
    return _touched(model.add(table, new), table, new)


def upsert(model: Model, table: str, data: list[dict] | DataFrame) -> Model:
    """Rows by name, as inserting into a map does: a row of the same key goes, the last given wins."""
    new = filled(data, table) if isinstance(data, DataFrame) else rows(model.tables[table].sparkSession, table, data)
    keys = KEYS[table]
    if isinstance(data, list):
        last = {tuple(d.get(k, "") for k in keys): d for d in data}
        new = rows(model.tables[table].sparkSession, table, list(last.values()))
    elif "ord" in new.columns:
        new = last_wins(new, keys, ["ord"])
    kept = model.tables[table].join(new.select(*keys).distinct(), keys, "left_anti")
    return _touched(model.with_tables(**{table: filled(kept, table).unionByName(new)}), table, new)


def _touched(model: Model, table: str, new: DataFrame) -> Model:
    """Files and packages that hold one of the rows, marked."""
    changed = {}
    columns = T._parse_datatype_string(DDL[table]).names
    if table in ("packages", "modules") or "import_path" not in columns:
        return model
    hit = new.select("import_path").distinct().withColumn("_hit", F.lit(True))
    p = filled(model.packages, "packages").join(hit, "import_path", "left")
    changed["packages"] = filled(p.withColumn("is_modified", F.col("is_modified") | F.coalesce("_hit", F.lit(False))), "packages")
    if "file_path" in columns and table != "files":
        keys = ["import_path", "file_path"]
        f = filled(model.files, "files").join(new.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
        changed["files"] = filled(f.withColumn("is_modified", F.col("is_modified") | F.coalesce("_hit", F.lit(False))), "files")
    return model.with_tables(**changed)


def add_dependency(model: Model, module_path: str, path: str, version: str, indirect: bool = False) -> Model:
    return append(model, "dependencies", [{"module_path": module_path, "ord": _next(model, "dependencies", module_path), "path": path, "version": version, "indirect": indirect}])


def add_replace(model: Model, module_path: str, old: tuple[str, str], new: tuple[str, str]) -> Model:
    """old, new: (path, version), the version '' where none is meant."""
    return append(model, "replaces", [{"module_path": module_path, "ord": _next(model, "replaces", module_path), "old": {"path": old[0], "version": old[1]}, "new": {"path": new[0], "version": new[1]}}])


def _next(model: Model, table: str, module_path: str) -> int:
    return model.tables[table].filter(F.col("module_path") == module_path).agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]


def _where(keys: dict) -> Column:
    out = F.lit(True)
    for c, v in keys.items():
        out &= F.col(c) == F.lit(v)
    return out


def set_receiver(model: Model, keys: dict, name: str, type_: str, is_pointer: bool) -> Model:
    """The functions that ``keys`` (column: value) name become methods."""
    kind = T._parse_datatype_string(DDL["functions"])["receiver"].dataType
    r = F.struct(F.lit(name).alias("name"), F.lit(type_).alias("type"), F.lit(is_pointer).alias("is_pointer"), F.lit(0).cast("long").alias("start_pos"), F.lit(0).cast("long").alias("end_pos")).cast(kind)
    hit = _where(keys)
    f = model.functions.withColumn("receiver", F.when(hit, r).otherwise(F.col("receiver"))).withColumn("is_method", hit | F.col("is_method"))
    return _touched(model.with_tables(functions=f), "functions", f.filter(hit))


def _add_to(model: Model, column: str, keys: dict, name: str, type_: str, is_variadic: bool) -> Model:
    kind = T._parse_datatype_string(DDL["functions"])[column].dataType
    one = F.struct(F.lit(name).alias("name"), F.lit(type_).alias("type"), F.lit(is_variadic).alias("is_variadic"), F.lit(0).cast("long").alias("start_pos"), F.lit(0).cast("long").alias("end_pos")).cast(kind.elementType)
    hit, empty = _where(keys), F.array().cast(kind)
    f = model.functions.withColumn(column, F.when(hit, F.array_append(F.coalesce(column, empty), one)).otherwise(F.col(column)))
    return _touched(model.with_tables(functions=f), "functions", f.filter(hit))


def add_parameter(model: Model, keys: dict, name: str, type_: str, is_variadic: bool = False) -> Model:
    return _add_to(model, "parameters", keys, name, type_, is_variadic)


def add_result(model: Model, keys: dict, name: str, type_: str) -> Model:
    return _add_to(model, "results", keys, name, type_, False)


def _member(model: Model, table: str, import_path: str, type_name: str, data: dict) -> Model:
    own = model.tables[table].filter((F.col("import_path") == import_path) & (F.col("type_name") == type_name))
    n = own.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
    new = rows(model.types.sparkSession, table, [{"import_path": import_path, "type_name": type_name, "ord": n, **data}])
    home = model.types.filter((F.col("import_path") == import_path) & (F.col("name") == type_name)).select("import_path", "file_path")
    return _touched(model.add(table, new), "types", home)


def add_field(model: Model, import_path: str, type_name: str, name: str, type_: str, tag: str = "", is_embedded: bool = False, doc: str = "") -> Model:
    return _member(model, "fields", import_path, type_name, {"name": name, "type": type_, "tag": tag, "is_embedded": is_embedded, "doc": doc})


def add_method(model: Model, import_path: str, type_name: str, name: str, signature: str, is_embedded: bool = False, doc: str = "", interface: bool = False) -> Model:
    """A method of a type, or of an interface's contract."""
    return _member(model, "methods", import_path, type_name, {"name": name, "signature": signature, "is_embedded": is_embedded, "doc": doc, "is_interface_method": interface})


def set_position(model: Model, table: str, keys: dict, start: int, end: int, part: str | None = None) -> Model:
    """Start and end of the rows that ``keys`` name; ``part``: of their receiver, or of each of their 'parameters' or 'results'."""
    hit, df = _where(keys), model.tables[table]
    a, b = F.lit(start).cast("long"), F.lit(end).cast("long")
    if part == "receiver":
        df = df.withColumn(part, F.when(hit & F.col(part).isNotNull(), F.col(part).withField("start_pos", a).withField("end_pos", b)).otherwise(F.col(part)))
    elif part:
        df = df.withColumn(part, F.when(hit, F.transform(part, lambda x: x.withField("start_pos", a).withField("end_pos", b))).otherwise(F.col(part)))
    else:
        df = df.withColumn("start_pos", F.when(hit, a).otherwise(F.col("start_pos"))).withColumn("end_pos", F.when(hit, b).otherwise(F.col("end_pos")))
    return model.with_tables(**{table: df})
