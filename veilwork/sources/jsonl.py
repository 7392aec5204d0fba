"""JSON-lines input that tolerates broken lines, and JSON-lines output."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BROKEN = "_broken"


def read_jsonl(spark: SparkSession, path: str, schema: str, label: str | None = None,
               name_glob: str | None = None) -> DataFrame:
    """One object per line; broken lines are dropped. `label` overrides the label column.

    With `name_glob`, only files of that name shape are read (merging shards).
    """
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return override_label(reader.json(path), label)


def override_label(df: DataFrame, label: str | None) -> DataFrame:
    """Every row gets the label if one is given, else keeps its own."""
    return df if label is None else df.withColumn("label", F.lit(label))


def parse_lines(df: DataFrame, line: Column, schema: str) -> DataFrame:
    """Columns of the objects in a text column, without the rows whose line is broken."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType(wanted.fields + [T.StructField(BROKEN, T.StringType())])
    parsed = F.from_json(line, full, {"columnNameOfCorruptRecord": BROKEN})
    kept = [c for c in df.columns if c not in wanted.names]
    rows = df.select(*kept, parsed.alias("_row"))
    rows = rows.filter(F.col("_row").isNotNull() & F.col(f"_row.{BROKEN}").isNull())
    return rows.select(*kept, *[F.col(f"_row.{n}").alias(n) for n in wanted.names])


def union_sources(named: dict[str, DataFrame | None]) -> DataFrame:
    """All sources by column name, with a `source` column; sources that are None are skipped."""
    frames = [df.withColumn("source", F.lit(name)) for name, df in named.items() if df is not None]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_lines(df: DataFrame, text: Column, path: str) -> None:
    """One text per line, newlines inside a text escaped by the caller."""
    df.select(text.alias("value")).write.mode("overwrite").text(path)
