"""Scans, filters and predicates (inventory 2.1 and 2.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import CANDIDATE_MARKERS, HEADER_LIKE, SCRAPED, SECRETS, STATUS_LIKE, TOOL_MENTION, has_candidate_marker, is_text_candidate
from ..functions.text import ascii_text, file_name, first_lines, glob_pattern
from ..operators.similarity import first_of, once, one_row_a_file
from ..session import table
from .common import CORPUS, IS_TEXT, NAME, quoted

LEAST, MOST = 256, 2 << 20
INCLUDE, EXCLUDE = ("p00/", "lib/", "src/", "core/"), ("*/third_party/*", "*/vendor/*", "*.min.js")
ONLY = ("*.c", "*.h", "*.f90")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus files with their ASCII text. Repeated rows are still there: queries drop them from
    their narrow results, so that no text is moved for it."""
    return table(spark, sf, "corpus_files").withColumn("text", ascii_text(F.col("bytes")))


def corpus_once(spark: SparkSession, sf: str) -> DataFrame:
    """The same without repeated rows, for queries that explode texts. Only texts of repeated files move."""
    return once(table(spark, sf, "corpus_files", ["file_id", "relpath", "bytes"]), "file_id").withColumn("text", ascii_text(F.col("bytes")))


def s1_corpus_files(spark, sf):
    files = table(spark, sf, "corpus_files", ["project", "relpath", "size"]).distinct()
    return files.where(is_text_candidate(F.col("relpath")) & F.col("size").between(LEAST, MOST))


def s2_scan_files(spark, sf):
    files = table(spark, sf, "corpus_files", ["project", "relpath", "size"]).distinct()
    return files.where(is_text_candidate(F.col("relpath")) & (F.col("size") >= LEAST)).groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def s3_scoped_files(spark, sf):
    files = table(spark, sf, "corpus_files", ["project", "relpath"]).distinct()
    inside, outside, only = F.lit(False), F.lit(False), F.lit(False)
    for p in INCLUDE:
        inside = inside | F.col("relpath").startswith(p)
    for g in EXCLUDE:
        outside = outside | F.col("relpath").rlike(glob_pattern(g))
    for g in ONLY:
        only = only | F.col("relpath").rlike(glob_pattern(g))
    return files.where(inside & ~outside & only)


def s5_marked_files(spark, sf):
    return corpus(spark, sf).where(is_text_candidate(F.col("relpath")) & has_candidate_marker(F.col("text"))).select("file_id", "project", "relpath").distinct()


def s6_changed_files(spark, sf):
    """Files that differ from the index: changed content, not yet indexed, indexed but gone."""
    now = table(spark, sf, "corpus_files").where(is_text_candidate(F.col("relpath"))).select("project", "relpath", F.sha2("bytes", 256).alias("sha")).distinct()
    old = one_row_a_file(table(spark, sf, "files")).select("project", "relpath", "sha256").distinct()
    both = now.join(old, ["project", "relpath"], "full_outer")
    state = F.when(F.col("sha256").isNull(), "new").when(F.col("sha").isNull(), "gone").when(F.col("sha") != F.col("sha256"), "changed")
    return both.select("project", "relpath", state.alias("state")).where("state is not null")


def s7_header_read(spark, sf):
    head = corpus(spark, sf).select("file_id", first_lines(F.col("text"), 80).alias("head"))
    return head.select("file_id", F.length("head").cast("bigint").alias("chars"), F.md5("head").alias("digest")).distinct()


def s10_header_rename(spark, sf):
    """Extensionless files below include/ or inc/ that begin like C++ headers get a suffix."""
    looks = F.substring("text", 1, 4096).rlike(HEADER_LIKE)
    below = F.col("relpath").rlike("(^|/)(include|inc)/")
    bare = ~file_name(F.col("relpath")).contains(".")
    keep = ~file_name(F.col("relpath")).rlike(r"(?i)^(license|copying|copyright|readme|authors|news|makefile)")
    return corpus(spark, sf).select("file_id", F.when(below & bare & keep & looks, F.concat("relpath", F.lit(".hpp"))).otherwise(F.col("relpath")).alias("name")).distinct()


def s11_index_read(spark, sf):
    """Point lookups by id in the index: the files that matches of findings name."""
    index = one_row_a_file(table(spark, sf, "files", ["file_id", "project", "relpath", "tokens", "kgrams", "sha256", "indexed_at"]))
    wanted = table(spark, sf, "source_findings").select(F.explode("matches").alias("m")).select("m.project", "m.relpath").distinct()
    return index.join(wanted, ["project", "relpath"]).select("file_id", "project", "relpath", "tokens", "kgrams")


def s13_report_matches(spark, sf):
    rows = table(spark, sf, "source_findings").dropDuplicates(["finding_id"]).select("finding_id", F.posexplode("matches").alias("place", "m")).where("m is not null")
    return rows.select("finding_id", F.col("place").cast("bigint").alias("place"), "m.project", "m.relpath", F.col("m.tokens").cast("bigint").alias("tokens"), F.round("m.winnow_density", 6).alias("density"), F.round("m.shingle_jaccard", 6).alias("shingle"))


def s20_commit_names(spark, sf):
    """Commit names in texts: release commits and hash-like words with a digit."""
    found = F.regexp_extract_all("text", F.lit(r"r[0-9]{1,2}-[0-9]{1,5}"), F.lit(0))
    return table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.explode(F.array_distinct(found)).alias("commit_name"))


def s21_commit_order(spark, sf):
    """Commit names over all sources, each kept where it is first named."""
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"r[0-9]{1,2}-[0-9]{1,5}"), F.lit(0))).alias("at", "commit_name"))
    return found.groupBy("commit_name").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("times"))


def s23_named_paths(spark, sf):
    """Paths named in readmes and commit messages only: the query's SQL is defined over these two kinds.

    Bug comments, list mail, patch notes, pages and source comments name paths too and are not read.
    """
    found = F.regexp_extract_all("text", F.lit(r"[a-z]+_[a-z0-9]+\.(?:c|cc|h|py|f90)"), F.lit(0))
    return table(spark, sf, "documents", ["doc_id", "text", "kind"]).where("kind = 'pr_readme' or kind = 'commit_message'").select("doc_id", F.explode(F.array_distinct(found)).alias("path"))


def s25_test_results(spark, sf):
    """Result lines of test logs in texts, counted by outcome; texts without any have no row."""
    line = table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    outcome = F.regexp_extract("line", r"^(FAIL|XPASS|UNRESOLVED|ERROR): ", 1)
    return line.where(outcome != "").groupBy("doc_id", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("lines"))


def s26_diff_lines(spark, sf):
    """Added and deleted lines of the diffs that texts hold."""
    line = table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    added = F.col("line").rlike(r"^\+[^+]")
    deleted = F.col("line").rlike(r"^-[^-]")
    return line.groupBy("doc_id").agg(F.count_if(added).alias("added"), F.count_if(deleted).alias("deleted")).where("added > 0 or deleted > 0")


def s27_first_years(spark, sf):
    """The first year in a file's first 30 lines."""
    year = F.regexp_extract(first_lines(F.col("text"), 30), r"(?:19|20)[0-9]{2}", 0)
    return corpus(spark, sf).select("file_id", F.when(year != "", year.cast("bigint")).alias("year")).where("year is not null").distinct()


def f2_body_gate(spark, sf):
    return one_row_a_file(table(spark, sf, "files", ["file_id", "tokens", "kgrams", "sha256", "indexed_at"])).where("tokens >= 80 and kgrams >= 40").select("file_id", F.col("tokens").cast("bigint").alias("tokens"), F.col("kgrams").cast("bigint").alias("kgrams"))


def f6_silent_findings(spark, sf):
    rows = table(spark, sf, "source_findings", ["finding_id", "header_class", "severity", "matches"]).dropDuplicates(["finding_id"])
    some = F.size(F.filter(F.coalesce("matches", F.array().cast(dict(rows.dtypes)["matches"])), lambda m: m.isNotNull())) > 0
    return rows.where((F.lower("header_class") == "silent") & F.col("severity").isin("high", "critical", "review") & some).select("finding_id", "severity")


def f8_pair_floor(spark, sf):
    rows = table(spark, sf, "downstream_findings", ["finding_id", "winnow_density", "shingle_jaccard"]).distinct()
    return rows.where("winnow_density >= 0.40 or shingle_jaccard >= 0.30").select("finding_id")


def f10_marker_gate(spark, sf):
    rows = table(spark, sf, "downstream_findings", ["finding_id", "upstream_has_gcc_marker", "severity"]).distinct()
    return rows.where("not upstream_has_gcc_marker").groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def f11_open_bugs(spark, sf):
    rows = table(spark, sf, "bug_history", ["bug_id", "component", "status", "summary"]).distinct()
    return rows.where(F.col("status").isin("UNCONFIRMED", "NEW", "ASSIGNED", "SUSPENDED", "WAITING", "REOPENED") & F.lower("summary").contains("loop")).select("bug_id", "component")


def f14_expectations(spark, sf):
    """Texts that contain any of some phrases, all of others and none of a third set."""
    rows = table(spark, sf, "documents", ["doc_id", "text"])
    has = lambda s: F.contains(F.col("text"), F.lit(s))
    return rows.where((has("regression") | has("crash")) & has("the ") & has("branch") & ~(has("FAIL:") | has("XPASS:"))).select("doc_id")


def f15_status_like(spark, sf):
    rows = table(spark, sf, "documents", ["doc_id", "text", "source"])
    return rows.where(F.col("text").rlike(STATUS_LIKE) & ~F.col("source").rlike("^(wiki|mirror)-")).select("doc_id")


def f16_secrets(spark, sf):
    rows = table(spark, sf, "documents", ["doc_id", "text"])
    return rows.where(F.col("text").rlike(SECRETS)).select("doc_id")


def f18_message_policy(spark, sf):
    """Messages that name no address, run over fifteen lines or don't say that a tool helped."""
    rows = table(spark, sf, "documents", ["doc_id", "text", "kind"]).where("kind = 'commit_message'")
    lines = F.size(F.split("text", "\n"))
    return rows.select("doc_id", F.col("text").rlike("https?://").alias("has_url"), (lines <= 15).alias("short"), F.col("text").rlike(TOOL_MENTION).alias("says_tool")).where("not (has_url and short and says_tool)")


def x13_path_rewrite(spark, sf):
    """Address of each file under its project's address, by the longest matching prefix."""
    files = table(spark, sf, "corpus_files", ["file_id", "project", "relpath"]).distinct()
    home = first_of(table(spark, sf, "corpus_sources", ["project", "url"]).distinct(), ["project"], [F.col("url").asc_nulls_last()])
    tail = F.regexp_replace("relpath", "^/+", "")
    return files.join(home, "project").select("file_id", F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/"), tail).alias("address"))


# Fixed value: files that a pruned clone keeps.
KEPT = r"\.(c|cc|cpp|cxx|c\+\+|C|h|hh|hpp|hxx|H|inc|ipp|tcc|rs|go|d|di|m|mm|py|f|f90|f95|f03|f08|for|fpp|F|F90|S|s|asm)$"


def s9_kept_paths(spark, sf):
    """Files that pruning keeps and drops, by project."""
    files = table(spark, sf, "corpus_files", ["file_id", "project", "relpath"]).distinct()
    return files.groupBy("project").agg(F.count_if(F.col("relpath").rlike(KEPT)).alias("kept"), F.count_if(~F.col("relpath").rlike(KEPT)).alias("dropped"))


def j14_sparse_paths(spark, sf):
    """Files below one of the sparse paths of their project: an equal project and a path prefix."""
    paths = table(spark, sf, "corpus_sources", ["project", "sparse_paths"]).select("project", F.explode("sparse_paths").alias("sparse_path")).distinct()
    files = table(spark, sf, "corpus_files", ["file_id", "project", "relpath"]).distinct()
    return files.join(paths, "project").where(F.col("relpath").startswith(F.concat("sparse_path", F.lit("/")))).select("file_id", "sparse_path")


def f17_scraped_links(spark, sf):
    """Texts with links that only a scraped page has, not counting mirrors."""
    rows = table(spark, sf, "documents", ["doc_id", "text", "source"])
    return rows.where(F.col("text").rlike(SCRAPED) & ~F.col("source").rlike("^mirror-")).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        s1_corpus_files, s2_scan_files, s3_scoped_files, s5_marked_files, s6_changed_files, s7_header_read, s9_kept_paths, s10_header_rename, s11_index_read,
        s13_report_matches, s20_commit_names, s21_commit_order, s23_named_paths, s25_test_results, s26_diff_lines, s27_first_years, f2_body_gate,
        f6_silent_findings, f8_pair_floor, f10_marker_gate, f11_open_bugs, f14_expectations, f15_status_like, f16_secrets, f17_scraped_links, f18_message_policy, j14_sparse_paths, x13_path_rewrite,
    )
}

_ONE_FILE = "(SELECT * FROM files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC NULLS LAST, sha256 DESC NULLS LAST) = 1)"
_HEAD = "array_to_string(string_split(text, chr(10))[1:{n}], chr(10))"

SQL = {
    "s1_corpus_files": f"SELECT DISTINCT project, relpath, size FROM corpus_files WHERE {IS_TEXT} AND size BETWEEN {LEAST} AND {MOST}",
    "s2_scan_files": f"SELECT project, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM (SELECT DISTINCT project, relpath, size FROM corpus_files WHERE {IS_TEXT} AND size >= {LEAST}) GROUP BY project",
    "s3_scoped_files": "SELECT DISTINCT project, relpath FROM corpus_files WHERE (" + " OR ".join(f"starts_with(relpath, '{p}')" for p in INCLUDE) + ") AND NOT (" + " OR ".join(f"relpath GLOB '{g}'" for g in EXCLUDE) + ") AND (" + " OR ".join(f"relpath GLOB '{g}'" for g in ONLY) + ")",
    "s5_marked_files": f"WITH {CORPUS} SELECT file_id, project, relpath FROM corpus WHERE {IS_TEXT} AND (" + " OR ".join(f"contains(text, '{m}')" for m in CANDIDATE_MARKERS) + ")",
    "s6_changed_files": f"""WITH now AS (SELECT DISTINCT project, relpath, sha256(bytes) AS sha FROM corpus_files WHERE {IS_TEXT}), old AS (SELECT DISTINCT project, relpath, sha256 FROM {_ONE_FILE})
        SELECT project, relpath, state FROM (SELECT project, relpath, CASE WHEN sha256 IS NULL THEN 'new' WHEN sha IS NULL THEN 'gone' WHEN sha <> sha256 THEN 'changed' END AS state FROM now FULL JOIN old USING (project, relpath)) WHERE state IS NOT NULL""",
    "s7_header_read": f"WITH {CORPUS} SELECT file_id, length({_HEAD.format(n=80)})::BIGINT AS chars, md5({_HEAD.format(n=80)}) AS digest FROM corpus",
    "s9_kept_paths": f"SELECT project, count(*) FILTER (k)::BIGINT AS kept, count(*) FILTER (NOT k)::BIGINT AS dropped FROM (SELECT DISTINCT file_id, project, regexp_matches(relpath, '{KEPT}') AS k FROM corpus_files) GROUP BY project",
    "f17_scraped_links": rf"SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, '{SCRAPED}') AND NOT regexp_matches(source, '^mirror-')",
    "j14_sparse_paths": "SELECT DISTINCT file_id, sparse_path FROM corpus_files JOIN (SELECT DISTINCT project, unnest(sparse_paths) AS sparse_path FROM corpus_sources) USING (project) WHERE starts_with(relpath, sparse_path || '/')",
    "s10_header_rename": rf"WITH {CORPUS} SELECT file_id, CASE WHEN regexp_matches(relpath, '(^|/)(include|inc)/') AND NOT contains({NAME}, '.') AND NOT regexp_matches({NAME}, '(?i)^(license|copying|copyright|readme|authors|news|makefile)') AND regexp_matches(text[1:4096], '{HEADER_LIKE}') THEN relpath || '.hpp' ELSE relpath END AS name FROM corpus",
    "s11_index_read": f"SELECT file_id, project, relpath, tokens, kgrams FROM {_ONE_FILE} JOIN (SELECT DISTINCT m.project, m.relpath FROM (SELECT unnest(matches) AS m FROM source_findings)) USING (project, relpath)",
    "s13_report_matches": """SELECT finding_id, place - 1 AS place, m.project AS project, m.relpath AS relpath, m.tokens::BIGINT AS tokens, round(m.winnow_density, 6) AS density, round(m.shingle_jaccard, 6) AS shingle
        FROM (SELECT finding_id, unnest(matches) AS m, unnest(range(1, len(matches) + 1)) AS place FROM (SELECT DISTINCT ON (finding_id) * FROM source_findings)) WHERE m IS NOT NULL""",
    "s20_commit_names": "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'r[0-9]{1,2}-[0-9]{1,5}')) AS commit_name FROM documents",
    "s21_commit_order": "SELECT commit_name, min(doc_id) AS first_doc, count(*)::BIGINT AS times FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'r[0-9]{1,2}-[0-9]{1,5}')) AS commit_name FROM (SELECT DISTINCT doc_id, text FROM documents)) GROUP BY 1",
    "s23_named_paths": r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-z]+_[a-z0-9]+\.(?:c|cc|h|py|f90)')) AS path FROM documents WHERE kind IN ('pr_readme', 'commit_message')",
    "s25_test_results": "SELECT doc_id, outcome, count(*)::BIGINT AS lines FROM (SELECT doc_id, regexp_extract(line, '^(FAIL|XPASS|UNRESOLVED|ERROR): ', 1) AS outcome FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT doc_id, text FROM documents))) WHERE outcome <> '' GROUP BY ALL",
    "s26_diff_lines": r"SELECT * FROM (SELECT doc_id, count(*) FILTER (regexp_matches(line, '^\+[^+]'))::BIGINT AS added, count(*) FILTER (regexp_matches(line, '^-[^-]'))::BIGINT AS deleted FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT doc_id, text FROM documents)) GROUP BY doc_id) WHERE added > 0 OR deleted > 0",
    "s27_first_years": f"WITH {CORPUS} SELECT file_id, year FROM (SELECT file_id, TRY_CAST(regexp_extract({_HEAD.format(n=30)}, '(?:19|20)[0-9]{{2}}') AS BIGINT) AS year FROM corpus) WHERE year IS NOT NULL",
    "f2_body_gate": f"SELECT file_id, tokens::BIGINT AS tokens, kgrams::BIGINT AS kgrams FROM {_ONE_FILE} WHERE tokens >= 80 AND kgrams >= 40",
    "f6_silent_findings": "SELECT DISTINCT finding_id, severity FROM source_findings WHERE lower(header_class) = 'silent' AND severity IN ('high', 'critical', 'review') AND len(list_filter(matches, lambda m: m IS NOT NULL)) > 0",
    "f8_pair_floor": "SELECT DISTINCT finding_id FROM downstream_findings WHERE winnow_density >= 0.40 OR shingle_jaccard >= 0.30",
    "f10_marker_gate": "SELECT severity, count(*)::BIGINT AS findings FROM (SELECT DISTINCT finding_id, upstream_has_gcc_marker, severity FROM downstream_findings) WHERE NOT upstream_has_gcc_marker GROUP BY severity",
    "f11_open_bugs": f"SELECT DISTINCT bug_id, component FROM bug_history WHERE status IN ({quoted(('UNCONFIRMED', 'NEW', 'ASSIGNED', 'SUSPENDED', 'WAITING', 'REOPENED'))}) AND contains(lower(summary), 'loop')",
    "f14_expectations": "SELECT DISTINCT doc_id FROM documents WHERE (contains(text, 'regression') OR contains(text, 'crash')) AND contains(text, 'the ') AND contains(text, 'branch') AND NOT (contains(text, 'FAIL:') OR contains(text, 'XPASS:'))",
    "f15_status_like": f"SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, '{STATUS_LIKE}') AND NOT regexp_matches(source, '^(wiki|mirror)-')",
    "f16_secrets": f"SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, '{SECRETS}')",
    "f18_message_policy": f"SELECT * FROM (SELECT DISTINCT doc_id, regexp_matches(text, 'https?://') AS has_url, len(string_split(text, chr(10))) <= 15 AS short, regexp_matches(text, '{TOOL_MENTION}') AS says_tool FROM documents WHERE kind = 'commit_message') WHERE NOT (has_url AND short AND says_tool)",
    "x13_path_rewrite": "SELECT file_id, regexp_replace(url, '/+$', '') || '/' || regexp_replace(relpath, '^/+', '') AS address FROM (SELECT DISTINCT file_id, project, relpath FROM corpus_files) JOIN (SELECT project, min(url) AS url FROM corpus_sources GROUP BY project) USING (project)",
}
