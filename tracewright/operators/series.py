"""Daily series of opened and resolved records with a running backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses that close a bug, and the fields that tell of it.
CLOSED = ("RESOLVED", "VERIFIED", "CLOSED")


def first_resolution(bugs: DataFrame, start: str) -> DataFrame:
    """bug_id, resolved: day of the first event on or after ``start`` that resolves or closes a bug.

    Events out of order count by their time. Bugs that never were have no row.
    """
    event = bugs.where("bug_id is not null").select("bug_id", F.explode("history").alias("e")).select("bug_id", F.to_date("e.changed_at").alias("day"), F.explode("e.changes").alias("c"))
    closes = ((F.col("c.field_name") == "resolution") & (F.trim("c.added") != "")) | (F.col("c.field_name").isin("status", "bug_status") & F.col("c.added").isin(*CLOSED))
    return event.where(closes & (F.col("day") >= F.lit(start).cast("date"))).groupBy("bug_id").agg(F.min("day").alias("resolved"))


def categories(component: Column, severity: Column, summary: Column) -> dict[str, Column]:
    """Named predicates; enhancements are in none."""
    bug = F.lower(F.coalesce(severity, F.lit(""))) != "enhancement"
    regression = F.lower(F.coalesce(summary, F.lit(""))).contains("regression")
    fortran = F.coalesce(component == "fortran", F.lit(False))
    return {"all-bugs": bug, "regression-bugs": bug & regression, "fortran-bugs": bug & fortran, "fortran-regressions": bug & fortran & regression}


def in_categories(bugs: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One row for each record and category that it is in."""
    member = F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in named.items())))
    return bugs.withColumn("category", F.explode(member))


def backlog(bugs: DataFrame, start: str, end: str) -> DataFrame:
    """category, day, created, resolved, open_bugs for every day of the range, zero days included.

    ``bugs``: category, created, resolved (dates), is_open. The backlog ends at the number open now.
    """
    spine = bugs.select("category").distinct().select("category", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    inside = lambda c: F.col(c).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    created = bugs.where(inside("created")).groupBy("category", F.col("created").alias("day")).agg(F.count(F.lit(1)).alias("created"))
    resolved = bugs.where(inside("resolved")).groupBy("category", F.col("resolved").alias("day")).agg(F.count(F.lit(1)).alias("resolved"))
    now = bugs.groupBy("category").agg(F.count_if("is_open").alias("now_open"))
    daily = spine.join(created, ["category", "day"], "left").join(resolved, ["category", "day"], "left").fillna(0, ["created", "resolved"]).join(now, "category")
    running = Window.partitionBy("category").orderBy("day")
    whole = Window.partitionBy("category")
    change = F.col("created") - F.col("resolved")
    return daily.select("category", "day", "created", "resolved", (F.col("now_open") - F.sum(change).over(whole) + F.sum(change).over(running)).alias("open_bugs"))
