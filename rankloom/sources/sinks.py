"""Results as text, JSON and CSV; Spark writes them in parts, so no task holds a whole result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def rendered(number: Column, title: Column, company: Column, location: Column, url: Column, text: Column) -> Column:
    """A posting as text: a rule, its number and title, labelled fields that aren't blank, a rule, the body."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c, F.lit("\n"))).otherwise(F.lit(""))
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.concat(
        F.lit("=" * 100 + "\nJOB "), number.cast("string"), F.lit("\nJob Title: "), F.coalesce(title, F.lit("")), F.lit("\n"),
        line("Company", company), line("Location", location), line("Job URL", url), F.lit("-" * 100 + "\n"), body, F.lit("\n\n"),
    )


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path, lineSep="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_counted(df: DataFrame, path: str, **counters: Column) -> dict[str, int]:
    """Write df as Parquet and count in the same pass; counters are aggregates. The numbers are those of the rows written."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("rows"), *(c.alias(n) for n, c in counters.items())).write.mode("overwrite").parquet(path)
    return seen.get
