"""Nested status records: child tables, latest state, branch matrix, checks (problem 3, inventory 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.nested import backport_rows, child_rows
from ..operators.similarity import first_of
from ..session import table

BRANCHES = ("gcc-13", "gcc-14", "gcc-15", "gcc-16")


def p3_found(spark, sf):
    return child_rows(table(spark, sf, "pr_status"), table(spark, sf, "source_findings")).select("record_table", "record_id", "child_key", "item_no", "child_value")


def p3_notes(spark, sf):
    """Every note with its record, branch and number."""
    return backport_rows(table(spark, sf, "pr_status")).where("item_no > 0").select("record_id", "branch", "item_no", "note")


def a11_branch_matrix(spark, sf):
    """One row for each record: how many notes each of the known branches has, null without it, and the others together."""
    rows = backport_rows(table(spark, sf, "pr_status"))
    known = F.col("branch").isin(*BRANCHES)
    wide = rows.groupBy("record_id").agg(*(F.sum(F.when(F.col("branch") == b, F.col("note").isNotNull().cast("bigint"))).alias(b.replace("-", "_")) for b in BRANCHES), F.sum(F.when(~known, F.col("note").isNotNull().cast("bigint"))).alias("others"))
    return wide.select("record_id", *(b.replace("-", "_") for b in BRANCHES), "others")


def o2_branch_fill(spark, sf):
    """A row for each record and each of the known branches, and one for any other branch of a record; those that it lacks say so."""
    rows = backport_rows(table(spark, sf, "pr_status")).select("record_id", "branch", "branch_commit").distinct()
    every = table(spark, sf, "pr_status").select(F.col("status_id").alias("record_id")).where("record_id is not null").distinct().withColumn("branch", F.explode(F.array(*(F.lit(b) for b in BRANCHES))))
    return every.join(rows, ["record_id", "branch"], "full_outer").select("record_id", "branch", F.when(F.col("branch_commit").isNull(), "absent").when(F.col("branch_commit") == "", "no-commit").otherwise("committed").alias("state"))


def _status(spark, sf, *columns):
    return table(spark, sf, "pr_status").dropDuplicates(["status_id"]).select("status_id", *columns)


def s14_status_fields(spark, sf):
    return _status(spark, sf, "pr", "fix_status", F.col("bugzilla.id").alias("bug"), F.col("bugzilla.resolution").alias("resolution"), F.size("bugzilla.keywords").cast("bigint").alias("keywords"), F.lower("classification.severity").alias("severity"), F.col("trunk.commit_sha").alias("commit_sha"))


def o1_latest_status(spark, sf):
    """The record of each bug that was updated last; of equals the one received last, then the greatest id."""
    s = _status(spark, sf, "pr", "fix_status", "updated_at", "received_at").where("pr is not null")
    return first_of(s, ["pr"], [F.col("updated_at").desc_nulls_last(), F.col("received_at").desc_nulls_last(), F.col("status_id").desc()]).select("pr", "status_id", "fix_status")


def a11_status_pivot(spark, sf):
    s = _status(spark, sf, "fix_status", F.lower("classification.severity").alias("severity"))
    wide = s.groupBy("fix_status").pivot("severity", ["ice-on-valid", "ice-on-invalid", "runtime-crash", "wrong-code"]).agg(F.count(F.lit(1)))
    return wide.select("fix_status", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c.replace("-", "_")) for c in ("ice-on-valid", "ice-on-invalid", "runtime-crash", "wrong-code")))


def a12_validation(spark, sf):
    """Records that fail a check: ids that disagree, a commit that is no hash, a title that is missing."""
    s = _status(spark, sf, "pr", "title", F.col("bugzilla.id").alias("bug"), F.col("trunk.commit_sha").alias("sha"))
    bad = F.array_compact(F.array(F.when(F.col("pr") != F.col("bug"), "ids-disagree"), F.when(~F.col("sha").rlike("^[0-9a-f]{7,40}$"), "no-hash"), F.when(F.trim("title") == "", "no-title")))
    return s.select("status_id", F.explode(bad).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("records"))


def s17_stale_records(spark, sf):
    """Records received more than thirty days after their last update."""
    s = _status(spark, sf, "updated_at", "received_at")
    days = F.datediff("received_at", "updated_at")
    return s.where(days > 30).select("status_id", days.cast("bigint").alias("days"))


def x21_day_parts(spark, sf):
    return _status(spark, sf, F.date_format("updated_at", "yyyy-MM").alias("month")).groupBy("month").agg(F.count(F.lit(1)).alias("records"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_notes, a11_branch_matrix, o2_branch_fill, s14_status_fields, o1_latest_status, a11_status_pivot, a12_validation, s17_stale_records, x21_day_parts)
}

_S = "s AS (SELECT DISTINCT ON (status_id) * FROM pr_status)"
#: The leaves of every record's backports with their steps: names, ordinals, whether they are elements; then the branches and notes.
_BACKPORTS = r"""WITH RECURSIVE t AS (SELECT DISTINCT status_id AS r, backports AS x FROM pr_status WHERE status_id IS NOT NULL AND backports IS NOT NULL AND json_valid(backports)),
        u AS (SELECT r, CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE x END AS x FROM t),
        n AS (SELECT u.r, j.key, j.id, j.parent, j.type, j.atom FROM (SELECT * FROM u WHERE json_valid(x)) u, json_tree(u.x::JSON) j),
        k AS (SELECT n.*, coalesce(p.type = 'ARRAY', false) AS element, row_number() OVER (PARTITION BY n.r, n.parent ORDER BY n.id) AS place FROM n LEFT JOIN n p ON p.r = n.r AND p.id = n.parent),
        w AS (SELECT r, id, type, atom, []::VARCHAR[] AS names, []::BIGINT[] AS nos, []::BOOLEAN[] AS els FROM k WHERE parent IS NULL
            UNION ALL SELECT k.r, k.id, k.type, k.atom, w.names || CASE WHEN k.element THEN [''] WHEN regexp_matches(k.key, '[^.]\.[A-Za-z_][^.]*$') THEN [regexp_replace(k.key, '\.[^.]*$', ''), regexp_extract(k.key, '[^.]*$')] ELSE [k.key] END,
                w.nos || CASE WHEN NOT k.element AND regexp_matches(k.key, '[^.]\.[A-Za-z_][^.]*$') THEN [k.place, k.place] WHEN NOT k.element AND regexp_full_match(k.key, '[0-9]{1,18}') THEN [k.key::BIGINT] ELSE [k.place] END,
                w.els || CASE WHEN NOT k.element AND regexp_matches(k.key, '[^.]\.[A-Za-z_][^.]*$') THEN [false, false] ELSE [k.element] END FROM k JOIN w ON w.r = k.r AND w.id = k.parent),
        l AS (SELECT *, list_position(list_transform(range(1, len(names) + 1), lambda i: els[i] OR names[i] NOT IN ('branches', 'open', 'closed')), true) AS top FROM w WHERE type NOT IN ('OBJECT', 'ARRAY') OR NOT EXISTS (SELECT 1 FROM k c WHERE c.r = w.r AND c.parent = w.id)),
        m AS (SELECT *, list_max(list_filter(range(1, len(names) + 1), lambda i: els[i] OR regexp_full_match(names[i], '[0-9]+') OR i = top)) AS last FROM l WHERE top > 0),
        o AS (SELECT r, nos[1:top] AS top_row, CASE WHEN NOT els[top] THEN names[top] END AS top_key, nos[1:last] AS row, last = top AS own, names[top + 1] AS member, array_to_string(names[last + 1:], '.') AS field, CASE WHEN type = 'VARCHAR' THEN atom ->> '$' END AS v FROM m),
        b AS (SELECT r, top_row, coalesce(max(CASE WHEN own AND field = 'branch' THEN trim(v) END), max(top_key)) AS branch, coalesce(max(CASE WHEN own AND field IN ('branch_commit', 'branch_commit.sha') THEN trim(v) END), '') AS commit FROM o GROUP BY r, top_row),
        x AS (SELECT r, top_row, row, max(v) AS note FROM o WHERE (own AND field IN ('notes', 'notes.text') OR NOT own AND member = 'notes' AND field IN ('', 'text')) AND trim(v) <> '' GROUP BY r, top_row, row)"""
_BRANCHES = ", ".join(f"('{b}')" for b in BRANCHES)

SQL = {
    "p3_notes": f"{_BACKPORTS} SELECT r AS record_id, branch, row_number() OVER (PARTITION BY r, branch ORDER BY top_row, row) AS item_no, note FROM x JOIN b USING (r, top_row) WHERE branch IS NOT NULL",
    "p3_found": f"""{_BACKPORTS}, y AS (SELECT r, branch, max(commit) AS commit FROM b WHERE branch IS NOT NULL GROUP BY r, branch), z AS (SELECT r, branch, row_number() OVER (PARTITION BY r, branch ORDER BY top_row, row) AS i FROM x JOIN b USING (r, top_row))
        SELECT 'pr_status' AS record_table, r AS record_id, branch AS child_key, coalesce(i, 0) AS item_no, commit AS child_value FROM y LEFT JOIN z USING (r, branch)
        UNION ALL SELECT 'source_findings', finding_id, m.project, i, m.relpath FROM (SELECT finding_id, unnest(matches) AS m, unnest(range(1, len(matches) + 1)) AS i FROM (SELECT DISTINCT ON (finding_id) finding_id, matches FROM source_findings WHERE finding_id IS NOT NULL)) WHERE m IS NOT NULL""",
    "a11_branch_matrix": f"""{_BACKPORTS}, c AS (SELECT r, branch, count(note) AS n FROM b LEFT JOIN x USING (r, top_row) WHERE branch IS NOT NULL GROUP BY r, branch)
        SELECT r AS record_id, {", ".join(f"max(CASE WHEN branch = '{b}' THEN n END)::BIGINT AS {b.replace('-', '_')}" for b in BRANCHES)}, sum(CASE WHEN branch NOT IN ({", ".join(f"'{b}'" for b in BRANCHES)}) THEN n END)::BIGINT AS others FROM c GROUP BY r""",
    "o2_branch_fill": f"""{_BACKPORTS}, c AS (SELECT r, branch, max(commit) AS commit FROM b WHERE branch IS NOT NULL GROUP BY r, branch), e AS (SELECT DISTINCT status_id AS r, branch FROM pr_status, (VALUES {_BRANCHES}) v(branch) WHERE status_id IS NOT NULL)
        SELECT coalesce(e.r, c.r) AS record_id, coalesce(e.branch, c.branch) AS branch, CASE WHEN commit IS NULL THEN 'absent' WHEN commit = '' THEN 'no-commit' ELSE 'committed' END AS state FROM e FULL JOIN c ON e.r = c.r AND e.branch = c.branch""",
    "s14_status_fields": f"WITH {_S} SELECT status_id, pr, fix_status, bugzilla.id AS bug, bugzilla.resolution AS resolution, len(bugzilla.keywords)::BIGINT AS keywords, lower(classification.severity) AS severity, trunk.commit_sha AS commit_sha FROM s",
    "o1_latest_status": f"WITH {_S} SELECT pr, status_id, fix_status FROM s WHERE pr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pr ORDER BY updated_at DESC NULLS LAST, received_at DESC NULLS LAST, status_id DESC) = 1",
    "a11_status_pivot": f"WITH {_S} SELECT fix_status, " + ", ".join(f"count(*) FILTER (lower(classification.severity) = '{c}')::BIGINT AS {c.replace('-', '_')}" for c in ("ice-on-valid", "ice-on-invalid", "runtime-crash", "wrong-code")) + " FROM s GROUP BY fix_status",
    "a12_validation": f"WITH {_S} SELECT problem, count(*)::BIGINT AS records FROM (SELECT unnest([CASE WHEN pr <> bugzilla.id THEN 'ids-disagree' END, CASE WHEN NOT regexp_matches(trunk.commit_sha, '^[0-9a-f]{{7,40}}$') THEN 'no-hash' END, CASE WHEN trim(title) = '' THEN 'no-title' END]) AS problem FROM s) WHERE problem IS NOT NULL GROUP BY problem",
    "s17_stale_records": f"WITH {_S}, d AS (SELECT status_id, date_diff('day', CAST(updated_at AT TIME ZONE 'UTC' AS DATE), CAST(received_at AT TIME ZONE 'UTC' AS DATE)) AS days FROM s) SELECT status_id, days FROM d WHERE days > 30",
    "x21_day_parts": f"WITH {_S} SELECT strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*)::BIGINT AS records FROM s GROUP BY 1",
}
