"""The code model as flat tables; absent strings are '' rather than null."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARAM = "ARRAY<STRUCT<name:STRING,type:STRING,is_variadic:BOOLEAN,start_pos:BIGINT,end_pos:BIGINT>>"

DDL = {
    "modules": "module_path STRING, version STRING, go_version STRING, dir STRING, go_mod STRING, build_flags MAP<STRING,STRING>, build_tags ARRAY<STRING>",
    "packages": "module_path STRING, import_path STRING, name STRING, dir STRING, documentation STRING, is_test BOOLEAN, is_modified BOOLEAN, start_pos BIGINT, end_pos BIGINT",
    "files": "import_path STRING, file_path STRING, name STRING, source_code STRING, is_test BOOLEAN, is_generated BOOLEAN, is_modified BOOLEAN, base BIGINT, size BIGINT, line_starts ARRAY<BIGINT>, build_tags ARRAY<STRING>",
    "imports": "import_path STRING, file_path STRING, ord INT, path STRING, name STRING, is_blank BOOLEAN, doc STRING, start_pos BIGINT, end_pos BIGINT",
    "types": "import_path STRING, file_path STRING, ord INT, name STRING, kind STRING, underlying STRING, is_exported BOOLEAN, doc STRING, start_pos BIGINT, end_pos BIGINT",
    "fields": "import_path STRING, type_name STRING, ord INT, name STRING, type STRING, tag STRING, is_embedded BOOLEAN, doc STRING, start_pos BIGINT, end_pos BIGINT",
    "methods": "import_path STRING, type_name STRING, ord INT, name STRING, signature STRING, is_embedded BOOLEAN, is_interface_method BOOLEAN, doc STRING, embedded STRING, start_pos BIGINT, end_pos BIGINT",
    "functions": f"import_path STRING, file_path STRING, ord INT, func_key STRING, name STRING, signature STRING, body STRING, doc STRING, receiver STRUCT<name:STRING,type:STRING,is_pointer:BOOLEAN,start_pos:BIGINT,end_pos:BIGINT>, parameters {_PARAM}, results {_PARAM}, is_exported BOOLEAN, is_method BOOLEAN, is_test BOOLEAN, start_pos BIGINT, end_pos BIGINT",
    "variables": "import_path STRING, file_path STRING, ord INT, name STRING, type STRING, value STRING, is_exported BOOLEAN, doc STRING, start_pos BIGINT, end_pos BIGINT, spec STRING",
    "constants": "import_path STRING, file_path STRING, ord INT, name STRING, type STRING, value STRING, is_exported BOOLEAN, doc STRING, start_pos BIGINT, end_pos BIGINT, spec STRING",
    "dependencies": "module_path STRING, ord INT, path STRING, version STRING, indirect BOOLEAN",
    "replaces": "module_path STRING, ord INT, old STRUCT<path:STRING,version:STRING>, new STRUCT<path:STRING,version:STRING>",
}


def rows(spark: SparkSession, table: str, data: list[dict] = ()) -> DataFrame:
    """A model table from dicts; absent values get '' (strings), false or null.
    One without rows is known to be empty when a query is planned, so that joins with it cost no exchange."""
    empty = spark.createDataFrame([], DDL[table]).filter(F.lit(False))
    base = {f.name: {"string": "", "boolean": False, "int": 0, "bigint": 0}.get(f.dataType.simpleString()) for f in empty.schema}
    unknown = {k for d in data for k in d} - set(base)
    if unknown:
        raise ValueError(f"{table} has no columns {sorted(unknown)}")

    def whole(value, kind):
        """Nested values with the members that were left out."""
        if isinstance(kind, T.ArrayType):
            return None if value is None else [whole(v, kind.elementType) for v in value]
        if isinstance(kind, T.StructType) and isinstance(value, dict):
            return {f.name: whole(value.get(f.name, {"string": "", "boolean": False, "bigint": 0}.get(f.dataType.simpleString())), f.dataType) for f in kind}
        return value

    kinds = {f.name: f.dataType for f in empty.schema}
    return spark.createDataFrame([tuple(whole({**base, **d}[c], kinds[c]) for c in base) for d in data], empty.schema) if data else empty


def filled(df: DataFrame, table: str) -> DataFrame:
    """``df`` with all columns of the model table, in order; '' , false or 0 where it has none."""
    empty = T._parse_datatype_string(DDL[table])
    zero = {"string": "", "boolean": False, "int": 0, "bigint": 0}
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(zero.get(f.dataType.simpleString()))).cast(f.dataType).alias(f.name) for f in empty])


@dataclass(frozen=True)
class Model:
    """Immutable set of tables; transforms return another Model."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, **data) -> Model:
        """Tables given as DataFrames or lists of dicts; the others are empty."""
        return cls({t: data[t] if isinstance(data.get(t), DataFrame) else rows(spark, t, data.get(t) or []) for t in DDL})

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def with_tables(self, **changed: DataFrame) -> Model:
        return replace(self, tables={**self.tables, **changed})

    def add(self, table: str, more: DataFrame) -> Model:
        """Rows appended; columns are matched by name, absent ones get '' , false or 0."""
        return self.with_tables(**{table: filled(self.tables[table], table).unionByName(filled(more, table))})

    def cached(self) -> Model:
        return Model({k: v.cache() for k, v in self.tables.items()})
