"""Text and JSON reports: the structure of a module, its interfaces."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.schema import Model


def structure_lines(model: Model, include_private: bool = False, show_types: bool = True, show_functions: bool = True) -> DataFrame:
    """(import_path, section, name, line): what a package's report says, to be read in that order.

    Headings count all declarations, the lists below them hold the exported
    ones, or all with a mark; a name that repeats in its package has one line.
    """
    head = lambda df, section, text: df.select("import_path", F.lit(section).alias("section"), F.lit("").alias("name"), text.alias("line"))
    parts = [head(model.packages, 0, F.concat(F.lit("  "), "import_path"))]
    mark = F.when(F.col("is_exported"), "").otherwise(" (unexported)")
    for on, table, section, title in ((show_types, model.types, 1, "Types"), (show_functions, model.functions, 3, "Functions")):
        if not on:
            continue
        what = F.concat(F.lit(" "), F.col("kind")) if title == "Types" else F.lit("")
        named = table.withColumn("what", what).groupBy("import_path", "name").agg(F.max_by(F.struct("is_exported", "what"), F.struct("file_path", "ord")).alias("d")).select("import_path", "name", "d.*")
        parts.append(head(named.groupBy("import_path").agg(F.count("*").alias("n")), section, F.concat(F.lit(f"    {title} ("), F.col("n").cast("string"), F.lit("):"))))
        shown = named if include_private else named.filter("is_exported")
        parts.append(shown.select("import_path", F.lit(section + 1).alias("section"), "name", F.concat(F.lit("      "), "name", "what", mark).alias("line")))
    return reduce(DataFrame.unionByName, parts)


def structure_report(model: Model, include_private: bool = False, show_types: bool = True, show_functions: bool = True) -> str:
    """The report as one text on the driver; its lines arrive in order, partition by partition."""
    m = model.modules.first()
    out = [f"Module: {m.module_path}"] + ([f"Version: {m.version}"] if m.version else []) + [f"Go Version: {m.go_version}", f"Directory: {m.dir}", "", f"Packages ({model.packages.count()}):"]
    open_ = False
    for r in structure_lines(model, include_private, show_types, show_functions).orderBy("import_path", "section", "name").toLocalIterator():
        if r.section == 0 and open_:
            out.append("")
        open_ = True
        out.append(r.line)
    return "\n".join(out) + "\n" + ("\n" if open_ else "")


def interface_names(model: Model, include_private: bool = False) -> list[str]:
    t = model.types.filter("kind = 'interface'")
    names = (t if include_private else t.filter("is_exported")).select(F.concat_ws(".", "import_path", "name").alias("n")).distinct().orderBy("n")
    return [r.n for r in names.toLocalIterator()]


def interfaces_report(model: Model, include_private: bool = False) -> str:
    return "\n".join([f"Interfaces in {model.modules.first().module_path}:", "", *interface_names(model, include_private)]) + "\n"


def interfaces_json(model: Model, include_private: bool = False) -> str:
    """Each interface with its implementors, which aren't searched for."""
    return json.dumps({n: {} for n in interface_names(model, include_private)}, indent=2)
