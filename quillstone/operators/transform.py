"""Transforms: model in, model and result out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import is_exported_unicode
from quillstone.operators.joins import last_wins
from quillstone.schema import Model


@dataclass
class Result:
    success: bool
    summary: str = ""
    error: str | None = None
    changes: DataFrame | None = None  # file_path, line_number, original, new
    files: DataFrame | None = None  # file_path
    dry_run: bool = False


Transform = Callable[[Model], tuple[Model, Result]]


def rename_rows(variables: DataFrame, old: str, new: str, compat: bool = False) -> DataFrame:
    """Variables with ``old`` renamed, in every package; position, type and value stay.

    The exported flag follows the new name (compat: stays). Where a package
    already has ``new``, the renamed row replaces it.
    """
    hit = F.col("name") == old
    flag = F.col("is_exported") if compat else F.when(hit, is_exported_unicode(F.lit(new))).otherwise(F.col("is_exported"))
    out = variables.withColumn("_hit", hit.cast("int")).withColumn("is_exported", flag).withColumn("name", F.when(hit, F.lit(new)).otherwise(F.col("name")))
    touched = out.filter(F.col("name") == new)
    # only rows of the new name can collide: the others need no exchange
    kept = last_wins(touched, ["import_path", "name"], ["_hit", "file_path", "ord"])
    return out.filter(F.col("name") != new).unionByName(kept).drop("_hit")


def rename_changes(variables: DataFrame, old: str, new: str) -> DataFrame:
    """What a rename would change; lines aren't tracked and are 0."""
    return variables.filter(F.col("name") == old).select("import_path", "file_path", F.lit(0).alias("line_number"), F.lit(old).alias("original"), F.lit(new).alias("new"))


def rename_variable(old: str, new: str, dry_run: bool = False, compat: bool = False) -> Transform:
    def run(model: Model) -> tuple[Model, Result]:
        changes = rename_changes(model.variables, old, new)
        if changes.isEmpty():
            return model, Result(False, f"no variable {old}", error=f"variable {old!r} is in no package", dry_run=dry_run)
        if not compat and not dry_run:
            both = model.variables.filter(F.col("name") == new).join(changes.select("import_path").distinct(), "import_path", "left_semi")
            if not both.isEmpty():
                return model, Result(False, f"{new} exists", error=f"variable {new!r} exists already", dry_run=dry_run)
        files = changes.select("file_path").distinct()
        result = Result(True, f"renamed {old} to {new}", changes=changes, files=files, dry_run=dry_run)
        if dry_run:
            return model, result
        marked = model.files.join(files.withColumn("_m", F.lit(True)), "file_path", "left").withColumn("is_modified", F.col("is_modified") | F.col("_m").isNotNull()).select(model.files.columns)
        packages = model.packages.join(changes.select("import_path").distinct().withColumn("_m", F.lit(True)), "import_path", "left").withColumn("is_modified", F.col("is_modified") | F.col("_m").isNotNull()).select(model.packages.columns)
        return model.with_tables(variables=rename_rows(model.variables, old, new, compat), files=marked, packages=packages), result

    return run


def chain(*steps: Transform, dry_run: bool = False) -> Transform:
    """Steps in order, up to the first that fails; what earlier ones did stays.

    Affected files are united; changes are kept for dry runs only.
    """

    def run(model: Model) -> tuple[Model, Result]:
        done: list[Result] = []
        for step in steps:
            model, r = step(model)
            done.append(r)
            if not r.success:
                return model, Result(False, f"stopped after {len(done)} of {len(steps)} steps: {r.summary}", error=r.error, dry_run=dry_run)
        union = lambda frames: reduce(DataFrame.unionByName, frames) if frames else None
        files = union([r.files for r in done if r.files is not None])
        changes = union([r.changes for r in done if r.changes is not None]) if dry_run else None
        return model, Result(True, f"{len(done)} steps", changes=changes, files=files.distinct() if files is not None else None, dry_run=dry_run)

    return run
