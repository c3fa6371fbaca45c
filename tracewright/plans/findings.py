"""Scoring, ranking, suppression and joins of findings (inventory 2.5, 2.8, 2.10 and sinks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.headers import LICENSE_NAMES, is_text_candidate
from ..functions.text import file_name, glob_pattern
from ..operators.reports import json_lines
from ..operators.scoring import FILE_RANK, SCAN_RANK, classify_pair, classify_source, directionality, rank, severity_of_score
from ..operators.similarity import first_of, one_row_a_file, top_k
from ..operators.upsert import changes
from ..session import table
from .common import IS_TEXT, quoted
from .scan import _ONE_FILE

SINCE = "2024-10-01"
#: Review registry of the queries: path globs that are looked at already.
REVIEWED = ("*/third_party/*", "*/vendor/*", "*/node_modules/*", "larkcc/p00/testsuite/*")
#: Pairs of patterns (upstream path, own path) that are known to be no findings.
FALSE_PAIRS = (("^tests/", "testsuite/"), ("^lib/.*\\.hpp$", "^libgo2/"), ("^core/depth/", "\\.f90$"))


def findings(spark, sf, *columns):
    return table(spark, sf, "source_findings").dropDuplicates(["finding_id"]).select("finding_id", *columns)


def pairs(spark, sf, *columns):
    return table(spark, sf, "downstream_findings").dropDuplicates(["finding_id"]).select("finding_id", *columns)


def _matches(spark, sf):
    m = findings(spark, sf, "header_class", F.posexplode("matches").alias("place", "m")).where("m is not null")
    by = F.col("m.winnow_density") + F.col("m.shingle_jaccard") + F.col("m.longest_run") / 200
    return m.select("finding_id", "header_class", F.col("place").cast("bigint").alias("place"), F.coalesce(by, F.lit(0.0)).alias("weight"), "m")


def w5_top_matches(spark, sf):
    top = top_k(_matches(spark, sf), ["finding_id"], [F.col("weight").desc(), F.col("place")], 3)
    return top.select("finding_id", F.col("rank").cast("bigint").alias("rank"), "place", F.round("weight", 6).alias("weight"))


def w6_prefilter(spark, sf):
    few = _matches(spark, sf).where("m.matched_winnows > 0 and m.winnow_density >= 0.10")
    top = top_k(few, ["finding_id"], [F.col("m.winnow_density").desc(), F.col("place")], 6)
    return top.select("finding_id", F.col("rank").cast("bigint").alias("rank"), "place")


def x8_classified_sources(spark, sf):
    best = top_k(_matches(spark, sf), ["finding_id"], [F.col("weight").desc(), F.col("place")], 1)
    best = best.select("finding_id", F.round("m.winnow_density", 4).alias("d"), F.round("m.shingle_jaccard", 4).alias("s"), F.round("m.line_jaccard", 4).alias("l"), F.col("m.longest_run").alias("run"))
    every = findings(spark, sf, (F.lower("header_class") == "silent").alias("silent")).where("silent is not null").join(best, "finding_id", "left")
    severity, score = classify_source(*(F.col(c) for c in ("silent", "d", "s", "l", "run")))
    return every.select("finding_id", severity.alias("severity"), F.coalesce(score, F.lit(0.0)).alias("score"))


def x9_classified_pairs(spark, sf):
    p = pairs(spark, sf, "winnow_density", "shingle_jaccard", directionality(F.col("gcc_intro_date"), F.col("upstream_intro_date")).alias("direction"))
    severity = classify_pair(F.coalesce("winnow_density", F.lit(0.0)), F.coalesce("shingle_jaccard", F.lit(0.0)), F.col("direction") == "gcc_first")
    return p.select("finding_id", "direction", severity.alias("severity"))


def x11_score_severity(spark, sf):
    f = findings(spark, sf, "score", "severity")
    return f.select("finding_id", severity_of_score(F.col("score")).alias("by_score"), rank(F.col("severity"), SCAN_RANK).cast("bigint").alias("scan_rank"), rank(F.col("severity"), FILE_RANK).cast("bigint").alias("file_rank"))


def j17_directions(spark, sf):
    p = pairs(spark, sf, "directionality", directionality(F.col("gcc_intro_date"), F.col("upstream_intro_date")).alias("direction"))
    return p.groupBy("direction", "directionality").agg(F.count(F.lit(1)).alias("pairs"))


def k5_ranked_report(spark, sf):
    """The forty findings that come first in the scanners' order."""
    f = findings(spark, sf, "path", "severity", "score").withColumn("rank", rank(F.col("severity"), SCAN_RANK))
    return f.orderBy(F.col("rank").desc_nulls_last(), F.col("score").desc_nulls_last(), "path", "finding_id").limit(40).select("finding_id", "path", "severity", "score")


def a6_project_worst(spark, sf):
    f = findings(spark, sf, F.regexp_extract("path", r"^(?:\./)*([^/]+)/", 1).alias("project"), rank(F.col("severity"), SCAN_RANK).alias("r"), "score", "header_class")
    return f.groupBy("project").agg(F.max("r").cast("bigint").alias("worst"), F.max("score").alias("score"), F.count(F.lit(1)).alias("scanned"), F.count_if(F.lower("header_class") == "silent").alias("silent"))


def a10_kept(spark, sf):
    kept = (F.col("score") >= 40) | (rank(F.col("severity"), SCAN_RANK) >= 2)
    return findings(spark, sf, "score", "severity").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


def a13_first_by_path(spark, sf):
    """One finding for each path: the first in the filers' order."""
    f = findings(spark, sf, F.regexp_replace("path", r"^(\./)+", "").alias("path"), "severity", "score")
    first = first_of(f.where("path is not null"), ["path"], [rank(F.col("severity"), FILE_RANK).desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("finding_id")])
    return first.select("path", "finding_id")


def j4_reviewed_globs(spark, sf):
    """Files that a glob of the review registry covers, with the glob. The registry is part of the plan, so nothing is joined."""
    path = F.concat_ws("/", "project", "relpath")
    hits = F.array_compact(F.array(*(F.when(path.rlike(glob_pattern(g)), g) for g in REVIEWED)))
    return table(spark, sf, "corpus_files", ["file_id", "project", "relpath"]).distinct().select("file_id", F.explode(hits).alias("pattern_text"))


def j6_rule_suppression(spark, sf):
    """Pairs that no false-positive rule, a pattern for each side, covers."""
    covered = F.lit(False)
    for theirs, ours in FALSE_PAIRS:
        covered = covered | F.coalesce(F.col("upstream_relpath").rlike(theirs) & F.col("gcc_path").rlike(ours), F.lit(False))
    return pairs(spark, sf, "gcc_path", "upstream_relpath").where(~covered).select("finding_id")


def j7_new_paths(spark, sf):
    """Findings of the latest scans whose path no earlier scan has."""
    f = findings(spark, sf, F.regexp_replace("path", r"^(\./)+", "").alias("path"), "scanned_at")
    late = f.where(F.col("scanned_at") >= F.lit(SINCE).cast("timestamp"))
    early = f.where(F.col("scanned_at") < F.lit(SINCE).cast("timestamp"))
    return late.join(early, "path", "left_anti").select("finding_id")


def j8_not_yet_filed(spark, sf):
    """Serious pairs, one for each upstream file, whose file isn't among those filed before."""
    p = pairs(spark, sf, F.lower(F.trim("upstream_project")).alias("project"), "upstream_relpath", "severity", "found_at")
    filed = p.where((F.col("severity") == "high") & (F.col("found_at") < F.lit("2025-08-01").cast("timestamp"))).select("project", "upstream_relpath").distinct()
    open_ = p.where(F.col("severity").isin("medium", "high")).join(filed, ["project", "upstream_relpath"], "left_anti").where("project is not null and upstream_relpath is not null")
    return first_of(open_, ["project", "upstream_relpath"], [F.col("finding_id")]).select("project", "upstream_relpath", "finding_id")


def j9_origins(spark, sf):
    """Pairs by the origin of their upstream project; unknown projects stay."""
    known = first_of(table(spark, sf, "corpus_sources", ["project", "origin_class"]).distinct().where("project is not null"), ["project"], [F.col("origin_class").asc_nulls_last()])
    p = pairs(spark, sf, F.lower(F.trim("upstream_project")).alias("project"))
    return p.join(known, "project", "left").groupBy(F.coalesce("origin_class", F.lit("unknown")).alias("origin")).agg(F.count(F.lit(1)).alias("pairs"))


def j10_before_after(spark, sf):
    """Severity and score of each path before and since a day, and the jump between them."""
    f = findings(spark, sf, F.regexp_replace("path", r"^(\./)+", "").alias("path"), "scanned_at", rank(F.col("severity"), SCAN_RANK).alias("r"), "score").where("scanned_at is not null")
    day = F.lit(SINCE).cast("timestamp")
    before = f.where(F.col("scanned_at") < day).groupBy("path").agg(F.max("r").alias("before"), F.max("score").alias("score_before"))
    after = f.where(F.col("scanned_at") >= day).groupBy("path").agg(F.max("r").alias("after"), F.max("score").alias("score_after"))
    both = before.join(after, "path", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("path", F.col("before").cast("bigint").alias("before"), F.col("after").cast("bigint").alias("after"), (zero("after") - zero("before")).cast("bigint").alias("jump"), F.round(zero("score_after") - zero("score_before"), 6).alias("delta"))


def j18_ancestor_licenses(spark, sf):
    """Licence files in the folder of each source file or above it, and the nearest folder with one."""
    files = table(spark, sf, "corpus_files", ["file_id", "project", "relpath"]).distinct()
    folder = F.regexp_replace("relpath", "/?[^/]*$", "")
    licence = files.where(file_name(F.col("relpath")).isin(*LICENSE_NAMES)).groupBy("project", folder.alias("up")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("folder", "/")
    ups = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    # Ancestors once for each folder, not for each file.
    source = files.where(is_text_candidate(F.col("relpath"))).select("file_id", "project", folder.alias("folder"))
    found = source.select("project", "folder").distinct().select("project", "folder", F.explode(ups).alias("up")).join(licence, ["project", "up"]).groupBy("project", "folder").agg(F.sum("n").alias("licences"), F.max_by("up", F.length("up")).alias("nearest"))
    return source.join(found, ["project", "folder"], "left").select("file_id", F.coalesce("licences", F.lit(0)).cast("bigint").alias("licences"), "nearest")


def k1_index_changes(spark, sf):
    """What an incremental upsert of the scanned corpus would do to the index, by project."""
    scan = table(spark, sf, "corpus_files").where(is_text_candidate(F.col("relpath"))).select("project", "relpath", F.sha2("bytes", 256).alias("sha256")).distinct()
    index = one_row_a_file(table(spark, sf, "files", ["file_id", "project", "relpath", "sha256", "indexed_at"])).select("project", "relpath", "sha256")
    return changes(index, scan).groupBy("project", "change").agg(F.count(F.lit(1)).alias("files"))


def k4_report_rows(spark, sf):
    """Findings as lines of a JSON report, escaped, nulls left in, by digest of the line."""
    n = F.size(F.coalesce("matches", F.array().cast(dict(table(spark, sf, "source_findings").dtypes)["matches"])))
    f = findings(spark, sf, "path", "severity", "header_class", "header_excerpt", "score", n.alias("matches"))
    line = json_lines(f)
    return line.select(F.get_json_object("value", "$.finding_id").cast("bigint").alias("finding_id"), F.md5("value").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        w5_top_matches, w6_prefilter, x8_classified_sources, x9_classified_pairs, x11_score_severity, j17_directions, k5_ranked_report, a6_project_worst,
        a10_kept, a13_first_by_path, j4_reviewed_globs, j6_rule_suppression, j7_new_paths, j8_not_yet_filed, j9_origins, j10_before_after,
        j18_ancestor_licenses, k1_index_changes, k4_report_rows,
    )
}

_F = "f AS (SELECT DISTINCT ON (finding_id) * FROM source_findings)"
_P = "p AS (SELECT DISTINCT ON (finding_id) * FROM downstream_findings)"
_M = f"""{_F}, m AS (SELECT finding_id, header_class, place - 1 AS place, m, coalesce(m.winnow_density + m.shingle_jaccard + m.longest_run / 200, 0) AS weight FROM (SELECT finding_id, header_class, unnest(matches) AS m, unnest(range(1, len(matches) + 1)) AS place FROM f) WHERE m IS NOT NULL)"""
_RANK = "CASE {c} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 WHEN 'review' THEN 2 END"
_FRANK = "CASE {c} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'review' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"
_DIRECTION = "CASE WHEN gcc_intro_date IS NULL OR upstream_intro_date IS NULL OR trim(gcc_intro_date) = '' OR trim(upstream_intro_date) = '' THEN 'unknown' WHEN gcc_intro_date < upstream_intro_date THEN 'gcc_first' WHEN gcc_intro_date > upstream_intro_date THEN 'upstream_first' ELSE 'contemporaneous' END"
_PATH = r"regexp_replace(path, '^(\./)+', '')"
_FOLDER = "regexp_replace(relpath, '/?[^/]*$', '')"

SQL = {
    "w5_top_matches": f"WITH {_M} SELECT finding_id, rank, place, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY weight DESC, place) AS rank FROM m) WHERE rank <= 3",
    "w6_prefilter": f"WITH {_M} SELECT finding_id, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY m.winnow_density DESC, place) AS rank FROM m WHERE m.matched_winnows > 0 AND m.winnow_density >= 0.10) WHERE rank <= 6",
    "x8_classified_sources": f"""WITH {_M}, best AS (SELECT finding_id, round(m.winnow_density, 4) AS d, round(m.shingle_jaccard, 4) AS s, round(m.line_jaccard, 4) AS l, m.longest_run AS run FROM m QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY weight DESC, place) = 1),
        a AS (SELECT finding_id, lower(header_class) = 'silent' AS silent, d, s, l, 100 * d + 60 * s + 0.25 * run AS v FROM f LEFT JOIN best USING (finding_id) WHERE header_class IS NOT NULL),
        b AS (SELECT *, CASE WHEN d IS NULL THEN 'none' WHEN silent AND l < 0.06 THEN (CASE WHEN d >= .25 AND s >= .20 THEN 'weak-medium' ELSE 'weak-low' END)
            WHEN NOT silent THEN (CASE WHEN d >= .85 OR s >= .85 THEN 'strong' WHEN d >= .60 OR s >= .70 THEN 'fair' ELSE 'poor' END)
            WHEN (d >= .60 AND s >= .45) OR s >= .70 THEN 'critical' WHEN (d >= .35 AND s >= .30) OR s >= .45 THEN 'high' WHEN (d >= .25 AND s >= .20) OR s >= .30 THEN 'medium' ELSE 'low' END AS c FROM a)
        SELECT finding_id, CASE c WHEN 'none' THEN 'low' WHEN 'weak-medium' THEN 'medium' WHEN 'weak-low' THEN 'low' WHEN 'strong' THEN 'review' WHEN 'fair' THEN 'review' WHEN 'poor' THEN 'low' ELSE c END AS severity,
            coalesce(round(CASE c WHEN 'none' THEN 0 WHEN 'weak-medium' THEN v * 0.6 WHEN 'weak-low' THEN v * 0.3 WHEN 'fair' THEN v * 0.8 WHEN 'poor' THEN v * 0.5 WHEN 'critical' THEN v + 50 WHEN 'high' THEN v + 20 ELSE v END, 2), 0) AS score FROM b""",
    "x9_classified_pairs": f"""WITH {_P}, a AS (SELECT finding_id, {_DIRECTION} AS direction, CASE WHEN winnow_density >= .8 AND shingle_jaccard >= .7 THEN 2 WHEN winnow_density >= .6 AND shingle_jaccard >= .45 THEN 1 ELSE 0 END AS b FROM p)
        SELECT finding_id, direction, CASE least(b + (CASE WHEN direction = 'gcc_first' THEN 1 ELSE 0 END), 2) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM a""",
    "x11_score_severity": f"WITH {_F} SELECT finding_id, CASE WHEN score >= 100 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS by_score, ({_RANK.format(c='severity')})::BIGINT AS scan_rank, ({_FRANK.format(c='severity')})::BIGINT AS file_rank FROM f",
    "j17_directions": f"WITH {_P} SELECT {_DIRECTION} AS direction, directionality, count(*)::BIGINT AS pairs FROM p GROUP BY ALL",
    "k5_ranked_report": f"WITH {_F} SELECT finding_id, path, severity, score FROM f ORDER BY {_RANK.format(c='severity')} DESC NULLS LAST, score DESC NULLS LAST, path, finding_id LIMIT 40",
    "a6_project_worst": rf"WITH {_F} SELECT regexp_extract(path, '^(?:\./)*([^/]+)/', 1) AS project, max({_RANK.format(c='severity')})::BIGINT AS worst, max(score) AS score, count(*)::BIGINT AS scanned, count(*) FILTER (lower(header_class) = 'silent')::BIGINT AS silent FROM f GROUP BY 1",
    "a10_kept": f"WITH {_F}, k AS (SELECT score >= 40 OR {_RANK.format(c='severity')} >= 2 AS kept FROM f) SELECT count(*)::BIGINT AS scanned, count(*) FILTER (kept)::BIGINT AS kept, count(*) FILTER (NOT kept)::BIGINT AS dropped FROM k",
    "a13_first_by_path": f"WITH {_F} SELECT path, finding_id FROM (SELECT {_PATH} AS path, finding_id, severity, score FROM f) WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY {_FRANK.format(c='severity')} DESC NULLS LAST, score DESC NULLS LAST, finding_id) = 1",
    "j4_reviewed_globs": f"SELECT file_id, pattern_text FROM (SELECT DISTINCT file_id, project || '/' || relpath AS path FROM corpus_files), (SELECT unnest([{quoted(REVIEWED)}]) AS pattern_text) WHERE path GLOB pattern_text",
    "j6_rule_suppression": f"WITH {_P} SELECT finding_id FROM p WHERE NOT coalesce(" + " OR ".join(f"(regexp_matches(upstream_relpath, '{a}') AND regexp_matches(gcc_path, '{b}'))" for a, b in FALSE_PAIRS) + ", false)",
    "j7_new_paths": f"WITH {_F}, g AS (SELECT finding_id, {_PATH} AS path, scanned_at >= TIMESTAMPTZ '{SINCE} 00:00:00+00' AS late FROM f) SELECT finding_id FROM g WHERE late AND NOT EXISTS (SELECT 1 FROM g e WHERE NOT e.late AND e.path = g.path)",
    "j8_not_yet_filed": f"""WITH {_P}, q AS (SELECT finding_id, lower(trim(upstream_project)) AS project, upstream_relpath, severity, found_at FROM p WHERE upstream_project IS NOT NULL AND upstream_relpath IS NOT NULL),
        filed AS (SELECT DISTINCT project, upstream_relpath FROM q WHERE severity = 'high' AND found_at < TIMESTAMPTZ '2025-08-01 00:00:00+00')
        SELECT project, upstream_relpath, min(finding_id) AS finding_id FROM q WHERE severity IN ('medium', 'high') AND NOT EXISTS (SELECT 1 FROM filed WHERE filed.project = q.project AND filed.upstream_relpath = q.upstream_relpath) GROUP BY 1, 2""",
    "j9_origins": f"WITH {_P} SELECT coalesce(origin_class, 'unknown') AS origin, count(*)::BIGINT AS pairs FROM (SELECT lower(trim(upstream_project)) AS project FROM p) LEFT JOIN (SELECT project, min(origin_class) AS origin_class FROM corpus_sources GROUP BY project) USING (project) GROUP BY 1",
    "j10_before_after": f"""WITH {_F}, g AS (SELECT {_PATH} AS path, scanned_at < TIMESTAMPTZ '{SINCE} 00:00:00+00' AS early, {_RANK.format(c='severity')} AS r, score FROM f WHERE scanned_at IS NOT NULL),
        b AS (SELECT path, max(r) AS before, max(score) AS sb FROM g WHERE early GROUP BY path), a AS (SELECT path, max(r) AS after, max(score) AS sa FROM g WHERE NOT early GROUP BY path)
        SELECT path, before::BIGINT AS before, after::BIGINT AS after, (coalesce(after, 0) - coalesce(before, 0))::BIGINT AS jump, round(coalesce(sa, 0) - coalesce(sb, 0), 6) AS delta FROM b FULL JOIN a USING (path)""",
    "j18_ancestor_licenses": f"""WITH c AS (SELECT DISTINCT file_id, project, relpath, {_FOLDER} AS folder FROM corpus_files), l AS (SELECT project, folder AS up, count(*) AS n FROM c WHERE split_part(relpath, '/', -1) IN ({quoted(LICENSE_NAMES)}) GROUP BY ALL),
        s AS (SELECT file_id, project, folder FROM c WHERE {IS_TEXT})
        SELECT s.file_id, coalesce(sum(n), 0)::BIGINT AS licences, max(up) AS nearest FROM s LEFT JOIN l ON l.project = s.project AND (up = '' OR up = folder OR starts_with(folder, up || '/')) GROUP BY s.file_id""",
    "k1_index_changes": f"""WITH now AS (SELECT DISTINCT project, relpath, sha256(bytes) AS sha FROM corpus_files WHERE {IS_TEXT}), old AS (SELECT project, relpath, sha256 FROM {_ONE_FILE})
        SELECT project, CASE WHEN sha256 IS NULL THEN 'insert' WHEN sha256 = sha THEN 'keep' ELSE 'update' END AS change, count(*)::BIGINT AS files FROM now LEFT JOIN old USING (project, relpath) GROUP BY ALL""",
    "k4_report_rows": f"WITH {_F} SELECT finding_id, md5(to_json({{'finding_id': finding_id, 'header_class': header_class, 'header_excerpt': header_excerpt, 'matches': coalesce(len(matches), 0), 'path': path, 'score': score, 'severity': severity}})) AS digest FROM f",
}
