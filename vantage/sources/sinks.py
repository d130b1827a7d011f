"""Results as files: JSON lines, one-row CSV, a markdown table, flat columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns a_b_c, arrays joined by semicolons."""

    def walk(schema: StructType, path: str, name: str):
        for f in schema.fields:
            p, n = f"{path}.`{f.name}`" if path else f"`{f.name}`", f"{name}{sep}{f.name}" if name else f.name
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, p, n)
            elif isinstance(f.dataType, ArrayType):
                yield F.array_join(F.transform(p, lambda x: x.cast("string")), ";").alias(n)
            else:
                yield F.col(p).alias(n)

    return df.select(*walk(df.schema, "", ""))


def markdown(df: DataFrame) -> DataFrame:
    """Lines of a markdown table of an aggregated result: numbers with six decimals, blanks
    for nulls, bars escaped."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        text = F.format_string("%.6f", c) if f.dataType.simpleString() in ("double", "float") else c.cast("string")
        cells.append(F.coalesce(F.when(c.isNotNull(), F.replace(text, F.lit("|"), F.lit("\\|"))), F.lit("")))
    head = [f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}"]
    lines = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return df.sparkSession.createDataFrame([(h,) for h in head], "line string").unionAll(lines)


def write_results(details: DataFrame, summary: DataFrame, path: str) -> None:
    """Details as JSON lines; the summary as JSON, CSV with a header and markdown."""
    details.write.mode("overwrite").json(f"{path}/details")
    summary.write.mode("overwrite").json(f"{path}/summary")
    flatten(summary).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    markdown(flatten(summary)).write.mode("overwrite").text(f"{path}/markdown")
