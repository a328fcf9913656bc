"""Positions: lines, columns, and the element at a position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.joins import first_match, interval_join
from quillstone.schema import Model

#: Which kind of element answers first where several hold a position.
PRIORITY = ("type", "function", "variable", "constant", "import")


def line_column(pos: Column | str, line_starts: Column | str) -> tuple[Column, Column]:
    """Line and column, from 1, by the ascending starts of a file's lines; null for position 0."""
    p = F.col(pos) if isinstance(pos, str) else pos
    s = F.col(line_starts) if isinstance(line_starts, str) else line_starts
    before = F.filter(s, lambda x: x <= p)
    return F.when(p != 0, F.size(before)), F.when(p != 0, p - F.element_at(before, -1) + 1)


def element_at(probes: DataFrame, pos: str, elements: DataFrame, keys: list[str], start: str = "start_pos", stop: str = "end_pos", probe_id: list[str] = ("probe",), width: int = 4096) -> DataFrame:
    """Each probe's first element by kind priority, then order of declaration.

    elements: keys, kind, ord, name, start and stop. Elements without a
    position (0) are never found; probes outside all elements have no row.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), F.col("kind"))
    hits = interval_join(probes, pos, elements.filter(f"{start} <> 0"), start, stop, keys, width)
    return first_match(hits.withColumn("_rank", F.when(rank > 0, rank).otherwise(99)), list(probe_id), [F.col("_rank"), F.col("ord")]).drop("_rank")


def line_column_in_text(text: Column | str, pos: Column | str) -> tuple[Column, Column]:
    """Line and column, from 1, of a character position (from 1) in a text that is at hand."""
    t, p = (F.col(x) if isinstance(x, str) else x for x in (text, pos))
    lines = F.split(F.substring(t, F.lit(1), (p - 1).cast("int")), "\n")
    return F.size(lines), (F.length(F.element_at(lines, -1)) + 1).cast("long")


def positions_of(model: Model, table: str) -> DataFrame:
    """A table's rows with line_start, col_start, line_end and col_end in their file; null without a position.

    One equi-join by file, for tables that have file_path; fields and methods
    take their type's file.
    """
    rows = model.tables[table]
    if "file_path" not in rows.columns:
        home = model.types.select("import_path", F.col("name").alias("type_name"), "file_path")
        rows = rows.join(home, ["import_path", "type_name"])
    at = rows.join(model.files.select("import_path", "file_path", "line_starts"), ["import_path", "file_path"])
    (l1, c1), (l2, c2) = line_column("start_pos", "line_starts"), line_column("end_pos", "line_starts")
    return at.select(*rows.columns, l1.alias("line_start"), c1.cast("int").alias("col_start"), l2.alias("line_end"), c2.cast("int").alias("col_end"))


def elements_of(model: Model) -> DataFrame:
    """(file_path, kind, ord, name, start_pos, end_pos) of all elements of the model that a position can hold."""
    kinds = {"type": model.types, "function": model.functions, "variable": model.variables, "constant": model.constants, "import": model.imports}
    one = lambda k, df: df.select("file_path", F.lit(k).alias("kind"), "ord", F.col("path" if k == "import" else "name").alias("name"), "start_pos", "end_pos")
    return reduce(DataFrame.unionByName, [one(k, df) for k, df in kinds.items()])
