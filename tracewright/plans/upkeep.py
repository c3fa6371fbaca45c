"""Patches, commits, logs, path maps, index upkeep and merged records (inventory 2.1, 2.2, 2.4, 2.7, 2.13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.headers import is_text_candidate
from ..functions.text import first_lines
from ..operators.minhash import FACTORS, OFFSETS, PERMUTATIONS, PRIME, bands, signatures
from ..operators.similarity import first_of, kgrams, one_row_a_file
from ..operators.upsert import changes, upserted
from ..session import table
from ..sources.files import patch_files, shas_of, test_summary
from .common import IS_TEXT
from .scan import _ONE_FILE
from .text import _GRAMS, _tokenised

COMMIT = r"r[0-9]{1,2}-[0-9]{1,5}"
#: Sources of commit names, in the order in which a repeated name counts.
SOURCES = ("commit_message", "mailing_list", "bug_comment")
PATH = r"[a-z]+_[a-z0-9]+\.(?:c|cc|h|py|f90)"


def s20_commit_list(spark, sf):
    """Lines of texts that begin with a commit's hash."""
    return shas_of(table(spark, sf, "documents", ["text"]).select(F.explode(F.split("text", "\n")).alias("value")))


def s21_commit_union(spark, sf):
    """Commit names of three kinds of sources, each where it comes first in their order."""
    docs = table(spark, sf, "documents", ["doc_id", "text", "kind"]).where(F.col("kind").isin(*SOURCES))
    source = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("kind"))
    found = docs.select(source.alias("source"), "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(COMMIT), F.lit(0))).alias("place", "commit_name"))
    return found.groupBy("commit_name").agg(F.min(F.struct("source", "doc_id", "place")).alias("f")).select("commit_name", F.col("f.source").cast("int").alias("source"), "f.doc_id", F.col("f.place").cast("bigint").alias("place"))


def s23_all_paths(spark, sf):
    """Paths named in texts of every kind (``s23_named_paths`` reads two kinds)."""
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATH), F.lit(0)))).alias("path")).distinct()


def s24_introductions(spark, sf):
    """The first commit message that names each path: the earliest, of equals the smallest id."""
    docs = table(spark, sf, "documents", ["doc_id", "text", "kind", "created_at"]).where("kind = 'commit_message'")
    named = docs.select("doc_id", "created_at", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATH), F.lit(0)))).alias("path"))
    return first_of(named, ["path"], [F.col("created_at").asc_nulls_last(), F.col("doc_id")]).select("path", "doc_id")


def _patches(spark, sf):
    return patch_files(table(spark, sf, "documents", ["doc_id", "text"]).distinct().withColumnRenamed("doc_id", "patch"))


def s26_patch_files(spark, sf):
    """Added and deleted lines of every file of the diffs in texts; lines before a file's header don't count."""
    return _patches(spark, sf)


def a9_patch_totals(spark, sf):
    """Changed lines of every diff, those of tests apart."""
    n = lambda c, test: F.sum(F.when(F.col("is_test") == test, F.col(c)).otherwise(0)).alias(f"{'test' if test else 'other'}_{c}")
    return _patches(spark, sf).groupBy("patch").agg(*(n(c, t) for t in (False, True) for c in ("added", "deleted")), F.count_if("is_test").alias("test_files"))


def s25_failing_tests(spark, sf):
    """Failing tests of texts that are whole summaries: a heading and a count of expected passes guard against cut ones."""
    whole = table(spark, sf, "documents", ["doc_id", "text"]).where(F.contains("text", F.lit(" Summary ===")) & F.contains("text", F.lit("# of expected passes")))
    return test_summary(whole.select(F.explode(F.split("text", "\n")).alias("value"))).distinct()


def s27_first_dates(spark, sf):
    """The first date in the first 30 lines of a text; days that don't exist are none."""
    found = F.regexp_extract(first_lines(F.col("text"), 30), r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
    return table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.try_to_timestamp(found, F.lit("yyyy-MM-dd")).cast("date").cast("string").alias("day")).where("day is not null").distinct()


def x13_prefix_map(spark, sf):
    """Address of each file by the longest prefix of the path map that covers it.

    A project's address covers its files, a sparse path's the files below that. A file looks its own
    ancestors up, so the map is joined by equality and may be of any size.
    """
    sources = table(spark, sf, "corpus_sources", ["project", "url", "sparse_paths"]).where("project is not null and url is not null")
    base = F.regexp_replace("url", "/+$", "")
    whole = sources.select(F.col("project").alias("prefix"), base.alias("base"))
    parts = sources.select("project", base.alias("base"), F.explode("sparse_paths").alias("part")).where("part is not null")
    entry = whole.unionByName(parts.select(F.concat_ws("/", "project", "part").alias("prefix"), F.concat_ws("/", "base", "part").alias("base")))
    entry = entry.groupBy("prefix").agg(F.min("base").alias("base"))
    files = table(spark, sf, "corpus_files", ["file_id", "project", "relpath"]).distinct().withColumn("path", F.concat_ws("/", "project", "relpath"))
    steps = F.split("path", "/")
    up = files.select("file_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("prefix"))
    best = up.join(entry, "prefix").groupBy("file_id").agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix", "base", "path")).alias("b"))
    return best.select("file_id", "b.prefix", F.concat("b.base", F.expr("substring(b.path, b.n + 1)")).alias("address"))


def _scan_and_index(spark, sf):
    scan = table(spark, sf, "corpus_files").where(is_text_candidate(F.col("relpath"))).select("project", "relpath", F.sha2("bytes", 256).alias("sha256")).distinct()
    index = one_row_a_file(table(spark, sf, "files", ["file_id", "project", "relpath", "sha256", "indexed_at"])).select("file_id", "project", "relpath", "sha256")
    return scan, index


def k1_index_after(spark, sf):
    """The index after an incremental scan: scanned rows replace those of their path, others stay."""
    scan, index = _scan_and_index(spark, sf)
    return upserted(index.drop("file_id"), scan)


def k1_postings_after(spark, sf):
    """Postings of each project that the scan leaves, and those that go with the old content of updated files."""
    scan, index = _scan_and_index(spark, sf)
    updated = changes(index, scan).where("change = 'update'").select("project", "relpath").distinct().withColumn("gone", F.lit(True))
    size = table(spark, sf, "files", ["file_id", "winnow_hashes"]).select("file_id", F.size(F.array_distinct("winnow_hashes")).alias("n")).distinct()
    each = index.join(updated, ["project", "relpath"], "left").join(size, "file_id").withColumn("gone", F.coalesce("gone", F.lit(False)))
    return each.groupBy("project").agg(F.sum(F.when(~F.col("gone"), F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("gone"), F.col("n")).otherwise(0)).alias("removed"))


def _signed(spark, sf):
    return signatures(kgrams(_tokenised(spark, sf), "file_id"), "file_id")


def a4_signatures(spark, sf):
    """MinHash signatures of all k-grams of every file, as a digest and their first value."""
    return _signed(spark, sf).select("file_id", F.md5(F.array_join("signature", " ")).alias("digest"), F.element_at("signature", 1).alias("first"))


def s12_band_sizes(spark, sf):
    """How many bands of the band table are shared by how many files."""
    crowd = bands(_signed(spark, sf), "file_id").groupBy("band", "value").agg(F.count(F.lit(1)).alias("files"))
    return crowd.groupBy("files").agg(F.count(F.lit(1)).alias("bands"))


def o1_merged_status(spark, sf):
    """Summary and state of each bug: what the tracker has, else what the record's answer said, else its own title."""
    own = Window.partitionBy("pr").orderBy(F.col("updated_at").desc_nulls_last(), F.col("received_at").desc_nulls_last(), F.col("status_id").desc())
    s = table(spark, sf, "pr_status").select("status_id", "pr", "title", "fix_status", "bugzilla", "updated_at", "received_at").where("pr is not null")
    last = s.withColumn("r", F.row_number().over(own)).where("r = 1")
    found = table(spark, sf, "bug_history").select(F.col("bug_id").alias("pr"), F.col("summary").alias("found"), F.col("status").alias("found_status"), "last_change_time").distinct()
    found = first_of(found, ["pr"], [F.col("last_change_time").desc_nulls_last(), F.col("found").asc_nulls_last(), F.col("found_status").asc_nulls_last()])
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    both = last.join(found, "pr", "left")
    return both.select("pr", "status_id", F.coalesce(some(F.col("found")), some(F.col("bugzilla.summary")), some(F.col("title"))).alias("summary"), F.coalesce(some(F.col("found_status")), some(F.col("bugzilla.status")), some(F.col("fix_status"))).alias("state"))


QUERIES = {
    f.__name__: f
    for f in (
        s20_commit_list, s21_commit_union, s23_all_paths, s24_introductions, s26_patch_files, a9_patch_totals, s25_failing_tests, s27_first_dates, x13_prefix_map,
        k1_index_after, k1_postings_after, a4_signatures, s12_band_sizes, o1_merged_status,
    )
}

_PATCH = r"""WITH l AS (SELECT doc_id AS patch, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM (SELECT DISTINCT doc_id, text FROM documents)),
        h AS (SELECT *, nullif(regexp_extract(line, '^diff --git a/\S+ b/(\S+)$', 1), '') AS head FROM l), p AS (SELECT patch, line, last_value(head IGNORE NULLS) OVER (PARTITION BY patch ORDER BY no) AS path FROM h),
        f AS (SELECT patch, path, count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++ '))::BIGINT AS added, count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '--- '))::BIGINT AS deleted,
            list_contains(string_split(path, '/'), 'testsuite') AS is_test FROM p WHERE path IS NOT NULL GROUP BY patch, path)"""
_SCAN = f"scan AS (SELECT DISTINCT project, relpath, sha256(bytes) AS sha256 FROM corpus_files WHERE {IS_TEXT}), idx AS (SELECT file_id, project, relpath, sha256 FROM {_ONE_FILE})"
_KIND = "(" + " OR ".join(f"kind = '{k}'" for k in SOURCES) + ")"
_SIGNED = f"""{_GRAMS}, x AS (SELECT file_id, list_distinct(list(('0x' || substr(hash, 9))::BIGINT & {PRIME})) AS x FROM grams GROUP BY file_id),
        perm AS (SELECT unnest({list(FACTORS)}::BIGINT[]) AS a, unnest({list(OFFSETS)}::BIGINT[]) AS b, unnest(range(0, {PERMUTATIONS})) AS i),
        sig AS (SELECT file_id, i, list_min(list_transform(x, lambda v: (v * a + b) % {PRIME})) AS m FROM x, perm)"""

SQL = {
    "s20_commit_list": "SELECT DISTINCT lower(sha) AS sha FROM (SELECT regexp_extract(trim(line), '^([0-9a-fA-F]{7,40})(?:\\s|$)', 1) AS sha FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE sha <> ''",
    "s21_commit_union": f"""WITH d AS (SELECT DISTINCT doc_id, text, kind FROM documents WHERE {_KIND}), f AS (SELECT list_position({list(SOURCES)}, kind) AS source, doc_id, regexp_extract_all(text, '{COMMIT}') AS n FROM d),
        e AS (SELECT source, doc_id, unnest(n) AS commit_name, unnest(range(0, len(n))) AS place FROM f)
        SELECT commit_name, source::INTEGER AS source, doc_id, place FROM e QUALIFY row_number() OVER (PARTITION BY commit_name ORDER BY source, doc_id, place) = 1""",
    "s23_all_paths": f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{PATH}')) AS path FROM documents",
    "s24_introductions": f"SELECT path, doc_id FROM (SELECT DISTINCT doc_id, created_at, unnest(regexp_extract_all(text, '{PATH}')) AS path FROM documents WHERE kind = 'commit_message') QUALIFY row_number() OVER (PARTITION BY path ORDER BY created_at NULLS LAST, doc_id) = 1",
    "s26_patch_files": f"{_PATCH} SELECT patch, path, added, deleted, is_test FROM f",
    "a9_patch_totals": f"{_PATCH} SELECT patch, " + ", ".join(f"sum(CASE WHEN is_test = {t} THEN {c} ELSE 0 END)::BIGINT AS {'test' if t == 'true' else 'other'}_{c}" for t in ("false", "true") for c in ("added", "deleted")) + ", count(*) FILTER (is_test)::BIGINT AS test_files FROM f GROUP BY patch",
    "s25_failing_tests": "SELECT DISTINCT regexp_extract(line, '^(FAIL|XPASS|UNRESOLVED|ERROR): (.*)$', 1) AS outcome, regexp_extract(line, '^[A-Z]+: (.*)$', 1) AS test FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE contains(text, ' Summary ===') AND contains(text, '# of expected passes')) WHERE regexp_matches(line, '^(FAIL|XPASS|UNRESOLVED|ERROR): ')",
    "s27_first_dates": "SELECT DISTINCT doc_id, day::VARCHAR AS day FROM (SELECT doc_id, TRY_CAST(regexp_extract(array_to_string(string_split(text, chr(10))[1:30], chr(10)), '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS DATE) AS day FROM documents) WHERE day IS NOT NULL",
    "x13_prefix_map": """WITH s AS (SELECT DISTINCT project, regexp_replace(url, '/+$', '') AS base, sparse_paths FROM corpus_sources WHERE project IS NOT NULL AND url IS NOT NULL),
        e AS (SELECT prefix, min(base) AS base FROM (SELECT project AS prefix, base FROM s UNION ALL SELECT project || '/' || part, base || '/' || part FROM (SELECT project, base, unnest(sparse_paths) AS part FROM s) WHERE part IS NOT NULL) GROUP BY prefix),
        f AS (SELECT DISTINCT file_id, project || '/' || relpath AS path FROM corpus_files)
        SELECT file_id, prefix, base || substr(path, length(prefix) + 1) AS address FROM f JOIN e ON starts_with(path, prefix || '/') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY length(prefix) DESC) = 1""",
    "k1_index_after": f"WITH {_SCAN} SELECT project, relpath, sha256 FROM scan UNION ALL SELECT project, relpath, sha256 FROM idx WHERE NOT EXISTS (SELECT 1 FROM scan WHERE scan.project = idx.project AND scan.relpath = idx.relpath)",
    "k1_postings_after": f"""WITH {_SCAN}, one AS (SELECT DISTINCT ON (project, relpath) * FROM idx), gone AS (SELECT DISTINCT project, relpath, true AS gone FROM scan JOIN one USING (project, relpath) WHERE scan.sha256 <> one.sha256),
        n AS (SELECT DISTINCT file_id, len(list_distinct(winnow_hashes)) AS n FROM files)
        SELECT project, sum(CASE WHEN gone IS NULL THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone THEN n ELSE 0 END)::BIGINT AS removed FROM idx LEFT JOIN gone USING (project, relpath) JOIN n USING (file_id) GROUP BY project""",
    "a4_signatures": f"WITH {_SIGNED} SELECT file_id, md5(string_agg(m, ' ' ORDER BY i)) AS digest, min(CASE WHEN i = 0 THEN m END) AS first FROM sig GROUP BY file_id",
    "s12_band_sizes": f"WITH {_SIGNED}, b AS (SELECT file_id, i // 2 AS band, string_agg(m, '-' ORDER BY i) AS value FROM sig GROUP BY file_id, i // 2) SELECT files, count(*) AS bands FROM (SELECT band, value, count(*) AS files FROM b GROUP BY band, value) GROUP BY files",
    "o1_merged_status": """WITH s AS (SELECT status_id, pr, title, fix_status, bugzilla FROM (SELECT DISTINCT status_id, pr, title, fix_status, bugzilla, updated_at, received_at FROM pr_status) WHERE pr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pr ORDER BY updated_at DESC NULLS LAST, received_at DESC NULLS LAST, status_id DESC) = 1),
        b AS (SELECT bug_id AS pr, summary, status FROM (SELECT DISTINCT bug_id, summary, status, last_change_time FROM bug_history) QUALIFY row_number() OVER (PARTITION BY bug_id ORDER BY last_change_time DESC NULLS LAST, summary NULLS LAST, status NULLS LAST) = 1)
        SELECT s.pr, status_id, coalesce(nullif(trim(summary), ''), nullif(trim(bugzilla.summary), ''), nullif(trim(title), '')) AS summary, coalesce(nullif(trim(status), ''), nullif(trim(bugzilla.status), ''), nullif(trim(fix_status), '')) AS state FROM s LEFT JOIN b ON b.pr = s.pr""",
}
