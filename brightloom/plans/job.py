"""Run a recipe file as a Spark job: load, apply, export.

    spark-submit -m brightloom.plans.job recipe.json input.parquet output.parquet
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from brightloom.plans.recipe import Recipe
from brightloom.sources.tables import export_table, load_table


def run(spark: SparkSession, recipe_path: str, source: str, target: str) -> str:
    cleaned = Recipe.load(spark, recipe_path).apply(load_table(spark, source))
    return export_table(cleaned, target, mode="overwrite")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("recipe")
    parser.add_argument("source")
    parser.add_argument("target")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("brightloom-recipe").getOrCreate()
    print(run(spark, args.recipe, args.source, args.target))


if __name__ == "__main__":
    main()
