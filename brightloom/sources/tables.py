"""Reading and writing tables: CSV, JSON, JSON lines, Parquet."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.errors import EmptyDataset, StepError, UnsupportedFileType
from brightloom.functions.columns import FLOATING, col, replace_columns

# Texts that stand for a missing value in a CSV file.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet"}


def format_of(path: str) -> str:
    extension = os.path.splitext(path.rstrip("/").lower())[1]
    if extension not in FORMATS:
        raise UnsupportedFileType(path, FORMATS)
    return FORMATS[extension]


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so NULL is the only missing value."""
    changes = {
        f.name: F.when(~F.isnan(col(f.name)), col(f.name))
        for f in df.schema if isinstance(f.dataType, FLOATING)
    }
    return replace_columns(df, changes) if changes else df


def load_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None, multiline: bool | None = None) -> DataFrame:
    """Load a table by format or file extension; an empty table is an error.

    A schema spares the inference scan. ``multiline`` says whether a CSV field or a JSON
    value goes over several lines; then each file is one task. By default a scan of the
    raw lines decides, so a large file is only read as a whole where it has to be.
    """
    fmt = fmt or format_of(path)
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt in ("json", "jsonl"):
        whole = _json_over_lines(spark, path) if multiline is None else multiline
        reader = spark.read.option("multiLine", whole and fmt == "json")
        df = (reader.schema(schema) if schema is not None else reader).json(path)
    elif fmt == "csv":
        df = _load_csv(spark, path, schema, multiline)
    else:
        raise UnsupportedFileType(path, FORMATS)
    df = normalise_missing(df)
    if df.isEmpty():
        raise EmptyDataset(f"'{path}'")
    return df


def _csv_over_lines(spark, path) -> list[str]:
    """The files in which a quoted field may hold a line break: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = spark.read.text(path).where(quotes % 2 == 1).select(F.input_file_name().alias("f")).distinct()
    return [r["f"] for r in odd.collect()]


def _json_over_lines(spark, path) -> bool:
    """JSON lines hold one object per line; anything else must be read file by file."""
    line = F.trim("value")
    single = line.startswith("{") & line.endswith("}")
    return not spark.read.text(path).where((line != "") & ~single).isEmpty()


def _load_csv(spark, path, schema, multiline):
    options = {"header": True, "escape": '"'}
    whole = _csv_over_lines(spark, path) if multiline is None else []
    reader = spark.read.options(multiLine=bool(multiline), **options)
    if schema is not None:
        reader = reader.schema(schema)
    texts = reader.csv(path)
    if whole:       # only these files are read as one task each
        names = {_plain(f): f for f in texts.inputFiles()}
        apart = {names.get(_plain(f), f) for f in whole}
        rest = sorted(set(names.values()) - apart)
        layout = texts.schema
        texts = spark.read.options(multiLine=True, **options).schema(layout).csv(sorted(apart))
        if rest:
            texts = texts.union(spark.read.options(multiLine=False, **options).schema(layout).csv(rest))
    strings = [f.name for f in texts.schema if isinstance(f.dataType, T.StringType)]
    cleaned = replace_columns(texts, {
        c: F.when(~col(c).isin(*MISSING_TEXTS), col(c)) for c in strings
    })
    return cleaned if schema is not None else _infer_types(cleaned)


def _plain(path: str) -> str:
    """A file's address without the differences between ways to write it."""
    return unquote(re.sub(r"^file:/+", "/", path))


def _infer_types(df: DataFrame) -> DataFrame:
    """Narrowest of bigint, double, boolean that every non-null text of a column fits."""
    names = df.columns
    fits: dict[str, str] = {}
    for start in range(0, len(names), 50):
        part = names[start:start + 50]
        aggregates = []
        for i, c in enumerate(part):
            value, present = F.trim(col(c)), col(c).isNotNull()
            whole = value.rlike(r"^[+-]?\d+$")
            aggregates += [
                F.count(col(c)).alias(f"n{i}"),
                F.count_if(present & ~(whole & value.try_cast("bigint").isNotNull())).alias(f"bigint{i}"),
                # a whole number beyond bigint would be rounded: such a column stays text
                F.count_if(present & (value.try_cast("double").isNull()
                                      | (whole & value.try_cast("bigint").isNull()))).alias(f"double{i}"),
                F.count_if(present & ~value.isin("True", "False", "TRUE", "FALSE", "true", "false"))
                .alias(f"boolean{i}"),
            ]
        row = df.agg(*aggregates).first()
        for i, c in enumerate(part):
            if row[f"n{i}"] == 0:
                fits[c] = "double"      # a column without values is an empty number column
                continue
            for name in ("bigint", "double", "boolean"):
                if row[f"{name}{i}"] == 0:
                    fits[c] = name
                    break
    return replace_columns(df, {c: F.trim(col(c)).cast(t) for c, t in fits.items()})


def export_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> str:
    """Write a non-empty table as CSV, JSON lines or Parquet and return the path."""
    if df.isEmpty():
        raise StepError("export", "the table has no rows")
    fmt = fmt or format_of(path)
    writer = df.write.mode(mode)
    if fmt == "csv":
        nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
        flat = replace_columns(df, {c: F.to_json(col(c)) for c in nested}) if nested else df
        flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif fmt in ("json", "jsonl"):
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise UnsupportedFileType(path, FORMATS)
    return path


def cleaned_path(folder: str, name: str, fmt: str) -> str:
    """``<folder>/<name>_cleaned.<fmt>``, the export naming rule."""
    return f"{folder.rstrip('/')}/{name}_cleaned.{fmt}"
