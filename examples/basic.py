"""Loads a module, lists what it declares, and saves it to a folder: python examples/basic.py MODULE TARGET"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillstone.operators.structure import structure_summary  # noqa: E402
from quillstone.render import documents, report  # noqa: E402
from quillstone.sinks.source import save_to  # noqa: E402
from quillstone.sources.loader import LoadOptions, load_module  # noqa: E402


def main(folder: str, target: str) -> None:
    spark = SparkSession.builder.appName("quillstone-example").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    model = load_module(spark, folder, LoadOptions(placeholders=False))
    print(report.structure_report(model))
    structure_summary(model.types).orderBy("import_path", "kind").show(truncate=False)
    save_to(model, target)
    with open(os.path.join(target, "module.md"), "w", encoding="utf-8") as f:
        f.write(documents.markdown(model))
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:3])
