"""Bug time series (inventory 2.6, 2.7: daily counts, first resolution, backlog)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.series import backlog, categories, first_resolution, in_categories
from ..operators.similarity import first_of
from ..session import table

START, END = "2023-01-01", "2025-01-31"


def _bugs(spark, sf):
    b = table(spark, sf, "bug_history").drop("history").distinct()
    is_open = F.coalesce("resolution", F.lit("")) == ""
    resolved = first_resolution(table(spark, sf, "bug_history").select("bug_id", "history").distinct(), START)
    return b.join(resolved, "bug_id", "left").withColumns({"created": F.to_date("creation_time"), "is_open": is_open})


def _named(spark, sf):
    return in_categories(_bugs(spark, sf), categories(F.col("component"), F.col("bug_severity"), F.col("summary")))


def w7_first_resolution(spark, sf):
    r = first_resolution(table(spark, sf, "bug_history").select("bug_id", "history").distinct(), START)
    return r.select("bug_id", F.col("resolved").cast("string").alias("resolved"))


def f12_categories(spark, sf):
    return _named(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("bugs"), F.count_if("is_open").alias("open_now"))


def a7_daily_counts(spark, sf):
    n = _named(spark, sf)
    days = n.select("category", F.col("created").alias("day"), F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(n.where("resolved is not null").select("category", F.col("resolved").alias("day"), F.lit(0).alias("c"), F.lit(1).alias("r")))
    inside = days.where(F.col("day").between(F.lit(START).cast("date"), F.lit(END).cast("date")))
    return inside.groupBy("category", F.col("day").cast("string").alias("day")).agg(F.sum("c").alias("created"), F.sum("r").alias("resolved"))


def w3_backlog(spark, sf):
    return backlog(_named(spark, sf), START, END).withColumn("day", F.col("day").cast("string"))


def a8_totals(spark, sf):
    """Opened, resolved, and the backlog at the start and the end, for each category."""
    b = backlog(_named(spark, sf), START, END)
    return b.groupBy("category").agg(F.sum("created").alias("opened"), F.sum("resolved").alias("resolved"), F.min_by("open_bugs", "day").alias("at_start"), F.max_by("open_bugs", "day").alias("at_end"))


def j11_bug_documents(spark, sf):
    """Documents about each bug: an inner join, one to many."""
    d = table(spark, sf, "documents", ["doc_id", "pr", "kind"])
    b = table(spark, sf, "bug_history", ["bug_id", "component"]).distinct()
    return d.join(b, F.col("pr") == F.col("bug_id")).groupBy("bug_id", "component", "kind").agg(F.count(F.lit(1)).alias("documents"))


def j12_first_commit(spark, sf):
    """Bugs that some commit message is about, with the earliest one."""
    d = table(spark, sf, "documents", ["doc_id", "pr", "kind", "created_at"]).where("kind = 'commit_message' and pr is not null")
    b = table(spark, sf, "bug_history", ["bug_id"]).distinct()
    return first_of(d.join(b, F.col("pr") == F.col("bug_id"), "left_semi"), ["pr"], [F.col("created_at").asc_nulls_last(), F.col("doc_id")]).select(F.col("pr").alias("bug_id"), "doc_id")


def j13_untracked(spark, sf):
    """Bugs of no status record."""
    b = table(spark, sf, "bug_history", ["bug_id", "bug_severity"]).distinct()
    return b.join(table(spark, sf, "pr_status", ["pr"]).distinct(), F.col("bug_id") == F.col("pr"), "left_anti").select("bug_id")


def j16_new_failures(spark, sf):
    """Failing tests in texts from a day on that no earlier text has."""
    line = table(spark, sf, "documents", ["doc_id", "text", "created_at"]).select("created_at", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").startswith("FAIL: "))
    name = line.select("created_at", F.regexp_extract("line", r"^FAIL: (\S+)", 1).alias("test"))
    day = F.lit("2025-01-01").cast("timestamp")
    return name.where(F.col("created_at") >= day).select("test").distinct().join(name.where(F.col("created_at") < day).select("test"), "test", "left_anti")


QUERIES = {
    f.__name__: f
    for f in (w7_first_resolution, f12_categories, a7_daily_counts, w3_backlog, a8_totals, j11_bug_documents, j12_first_commit, j13_untracked, j16_new_failures)
}

_RES = f"""res AS (SELECT bug_id, min(day) AS resolved FROM (SELECT bug_id, CAST(e.changed_at AT TIME ZONE 'UTC' AS DATE) AS day, unnest(e.changes) AS c FROM (SELECT bug_id, unnest(history) AS e FROM (SELECT DISTINCT bug_id, history FROM bug_history)))
    WHERE ((c.field_name = 'resolution' AND trim(c.added) <> '') OR (c.field_name IN ('status', 'bug_status') AND c.added IN ('RESOLVED', 'VERIFIED', 'CLOSED'))) AND day >= DATE '{START}' GROUP BY bug_id)"""
_NAMED = f"""{_RES}, b AS (SELECT DISTINCT bug_id, component, summary, bug_severity, creation_time, last_change_time, resolution, status FROM bug_history),
    c AS (SELECT b.*, resolved, CAST(creation_time AT TIME ZONE 'UTC' AS DATE) AS created, coalesce(resolution, '') = '' AS is_open, lower(coalesce(bug_severity, '')) <> 'enhancement' AS bug, contains(lower(coalesce(summary, '')), 'regression') AS reg, coalesce(component = 'fortran', false) AS fo FROM b LEFT JOIN res USING (bug_id)),
    n AS (SELECT *, unnest(list_filter([CASE WHEN bug THEN 'all-bugs' END, CASE WHEN bug AND reg THEN 'regression-bugs' END, CASE WHEN bug AND fo THEN 'fortran-bugs' END, CASE WHEN bug AND fo AND reg THEN 'fortran-regressions' END], lambda x: x IS NOT NULL)) AS category FROM c)"""
_BACKLOG = f"""{_NAMED}, spine AS (SELECT category, CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT category FROM n)),
    cr AS (SELECT category, created AS day, count(*) AS c FROM n GROUP BY ALL), re AS (SELECT category, resolved AS day, count(*) AS r FROM n GROUP BY ALL), now AS (SELECT category, count(*) FILTER (is_open) AS o FROM n GROUP BY category),
    d AS (SELECT category, day, coalesce(c, 0) AS created, coalesce(r, 0) AS resolved, o FROM spine LEFT JOIN cr USING (category, day) LEFT JOIN re USING (category, day) JOIN now USING (category)),
    bl AS (SELECT category, day, created, resolved, (o - sum(created - resolved) OVER (PARTITION BY category) + sum(created - resolved) OVER (PARTITION BY category ORDER BY day))::BIGINT AS open_bugs FROM d)"""

SQL = {
    "w7_first_resolution": f"WITH {_RES} SELECT bug_id, resolved::VARCHAR AS resolved FROM res",
    "f12_categories": f"WITH {_NAMED} SELECT category, count(*)::BIGINT AS bugs, count(*) FILTER (is_open)::BIGINT AS open_now FROM n GROUP BY category",
    "a7_daily_counts": f"WITH {_NAMED} SELECT category, day::VARCHAR AS day, sum(c)::BIGINT AS created, sum(r)::BIGINT AS resolved FROM (SELECT category, created AS day, 1 AS c, 0 AS r FROM n UNION ALL SELECT category, resolved, 0, 1 FROM n WHERE resolved IS NOT NULL) WHERE day BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY ALL",
    "w3_backlog": f"WITH {_BACKLOG} SELECT category, day::VARCHAR AS day, created, resolved, open_bugs FROM bl",
    "a8_totals": f"WITH {_BACKLOG} SELECT category, sum(created)::BIGINT AS opened, sum(resolved)::BIGINT AS resolved, arg_min(open_bugs, day) AS at_start, arg_max(open_bugs, day) AS at_end FROM bl GROUP BY category",
    "j11_bug_documents": "SELECT bug_id, component, kind, count(*)::BIGINT AS documents FROM (SELECT DISTINCT doc_id, pr, kind FROM documents) JOIN (SELECT DISTINCT bug_id, component FROM bug_history) ON pr = bug_id GROUP BY ALL",
    "j12_first_commit": "SELECT pr AS bug_id, doc_id FROM (SELECT DISTINCT doc_id, pr, created_at FROM documents WHERE kind = 'commit_message' AND pr IN (SELECT bug_id FROM bug_history)) QUALIFY row_number() OVER (PARTITION BY pr ORDER BY created_at NULLS LAST, doc_id) = 1",
    "j13_untracked": "SELECT DISTINCT bug_id FROM bug_history WHERE bug_id NOT IN (SELECT pr FROM pr_status WHERE pr IS NOT NULL)",
    "j16_new_failures": r"WITH t AS (SELECT created_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AS late, regexp_extract(line, '^FAIL: (\S+)', 1) AS test FROM (SELECT created_at, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT doc_id, text, created_at FROM documents)) WHERE starts_with(line, 'FAIL: ')) SELECT DISTINCT test FROM t WHERE late AND test NOT IN (SELECT test FROM t WHERE NOT late)",
}
