"""Sinks: JSON reports, ranked text, issue and matrix markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, fields in name order, nulls left in."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def ranked_text(df: DataFrame, order: list[Column], line: Column, top: int) -> DataFrame:
    """The first ``top`` rows in a total order as numbered lines of text."""
    from pyspark.sql import Window

    first = df.orderBy(*order).limit(top)  # the window sees no more rows than the report has
    return first.select(F.row_number().over(Window.orderBy(*order)).alias("no"), line.alias("line")).select("no", F.format_string("%3d. %s", "no", "line").alias("line"))


def markdown_row(*cells: Column) -> Column:
    """A table row; null cells are blank, bars are escaped."""
    text = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\|", r"\\|") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *text), F.lit(" |"))


def markdown_issue(title: Column, fields: dict[str, Column], body: Column) -> Column:
    """A title, a list of named fields without the null ones, and a body."""
    listed = [F.when(v.isNotNull(), F.concat(F.lit(f"- **{n}**: "), v.cast("string"))) for n, v in fields.items()]
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), *listed, F.lit(""), body)
