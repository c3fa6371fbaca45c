"""Sources: source trees, registries, reports, status files, lists and logs as data frames.

Every reader has a fixed schema. Missing registries are empty, rows without their key are skipped.
"""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, reviewed boolean, kind string, basis string, risk_adjustment int, notes string, reviewed_on string, reviewed_by string, evidence array<string>"
CORPUS_MAP = "path string, path_prefix string, source_name string, url string, url_prefix string, origin_class string, notes string"
MATCH = (
    "struct<project:string,relpath:string,tokens:int,winnow_density:double,matched_winnows:int,longest_run:int,shingle_jaccard:double,"
    "line_jaccard:double,tlsh_distance:int,cpd_clusters:int,cpd_longest:int>"
)
REPORT = (
    f"scanned long, kept long, findings array<struct<path:string,header_class:string,header_evidence:array<string>,bytes:int,tokens:int,"
    f"severity:string,score:double,matches:array<{MATCH}>,header_excerpt:string>>"
)
BRANCH = "struct<apply_mode:string,full_suite:string,targeted_tests:string,reproduces:boolean,backport_candidate:boolean,branch_commit:string,branch_patch:string,notes:string>"
STATUS = (
    "pr long, title string, github_issue long, fix_status string, notes string, updated_at timestamp, "
    "bugzilla struct<id:long,url:string,summary:string,status:string,resolution:string,keywords:array<string>,last_change_time:timestamp,refreshed_at:timestamp,last_synced_utc:timestamp,lookup_error:string>, "
    "classification struct<regression:boolean,severity:string,validity_class:string>, trunk struct<branch:string,commit:string,patch:string>, "
    f"backports map<string,{BRANCH}>, submission_status struct<on_bugzilla:boolean,on_mailing_list:boolean,sent:boolean>, artifacts map<string,string>"
)
BUGS = "bugs array<struct<id:long,component:string,summary:string,bug_severity:string,creation_time:timestamp,last_change_time:timestamp,resolution:string,status:string>>"


def source_tree(spark: SparkSession, root: str, least: int = 256, most: int | None = 2 << 20) -> DataFrame:
    """project, relpath, bytes, size of the files below ``root``/<project>/; size limits apply at the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    inside = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{re.escape(base)}/", "")
    kept = files.where(F.col("length") >= least)
    if most is not None:
        kept = kept.where(F.col("length") <= most)
    named = kept.select(F.regexp_extract(inside, "^([^/]+)/", 1).alias("project"), F.regexp_replace(inside, "^[^/]+/", "").alias("relpath"), F.col("content").alias("bytes"), F.col("length").alias("size"))
    return named.where("project <> ''").where(~F.col("relpath").rlike(r"(^|/)(\.git/|\.corpus-sha$)"))


def toml_rows(spark: SparkSession, path: str, table: str, schema: str, key: str) -> DataFrame:
    """Rows of an array of tables of a TOML registry; a small file, read by the driver."""
    file = Path(path)
    data = tomllib.loads(file.read_text()) if file.exists() else {}
    names = [f.split()[0] for f in schema.split(", ")]
    rows = [tuple(r.get(n) for n in names) for r in data.get(table, []) if r.get(key)]
    return spark.createDataFrame(rows, schema)


def review_manifest(spark: SparkSession, path: str) -> DataFrame:
    return toml_rows(spark, path, "entry", MANIFEST, "path")


def corpus_map(spark: SparkSession, path: str) -> DataFrame:
    """Entries by path and trees by prefix."""
    return toml_rows(spark, path, "entry", CORPUS_MAP, "path").unionByName(toml_rows(spark, path, "tree", CORPUS_MAP, "path_prefix"))


def scan_report(spark: SparkSession, path: str) -> DataFrame:
    """One row for each finding of JSON scan reports."""
    return spark.read.schema(REPORT).json(path, multiLine=True).select("scanned", "kept", F.explode("findings").alias("f")).select("scanned", "kept", "f.*")


def status_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Workflow records of pr/<number>/status.json files, with the number of the folder."""
    rows = spark.read.schema(STATUS).json(pattern, multiLine=True)
    return rows.withColumn("folder", F.regexp_extract(F.input_file_name(), r"/(\d+)/[^/]*$", 1).cast("bigint"))


def bug_search(spark: SparkSession, path: str) -> DataFrame:
    """Bug records of stored search answers."""
    return spark.read.schema(BUGS).json(path, multiLine=True).select(F.explode("bugs").alias("b")).select("b.*").where("id is not null")


def shas_of(lines: DataFrame) -> DataFrame:
    """sha of every line (column ``value``) that begins with one; comments and other lines are skipped, repeats kept out."""
    sha = F.regexp_extract(F.trim("value"), r"^([0-9a-fA-F]{7,40})(?:\s|$)", 1)
    return lines.select(F.lower(sha).alias("sha")).where("sha <> ''").distinct()


def commit_list(spark: SparkSession, path: str) -> DataFrame:
    """sha of the lines of a commit list."""
    return shas_of(spark.read.text(path))


def tracked_files(spark: SparkSession, path: str) -> DataFrame:
    """path of every line of a listing of tracked files; quoted names lose their quotes, repeats are kept out."""
    name = F.regexp_replace(F.regexp_replace("value", "\r$", ""), '^"(.*)"$', "$1")
    return spark.read.text(path).select(name.alias("path")).where("path <> ''").distinct()


def scope(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Included prefixes, and excluded paths with their reasons."""
    return toml_rows(spark, path, "include", "path_prefix string", "path_prefix"), toml_rows(spark, path, "exclude", "path string, reason string", "path")


def reviewed_paths(spark: SparkSession, path: str) -> DataFrame:
    """Paths that a registry of reviewed files names."""
    return toml_rows(spark, path, "entry", "path string", "path").distinct()


def in_scope(files: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """Files (path) below an included prefix that no exclusion names or covers as a folder. A file looks
    its own ancestors up, so neither list is compared with every file."""
    steps = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    above = files.select("path", F.explode(ups).alias("up"))
    clean = lambda c: F.regexp_replace(c, "/+$", "").alias("up")
    inside = above.join(include.select(clean("path_prefix")).distinct(), "up", "left_semi").select("path").distinct()
    outside = above.join(exclude.select(clean("path")).distinct(), "up", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_semi").join(outside, "path", "left_anti")


def commit_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Commits written one to a line, six fields parted by the unit separator."""
    part = F.split("value", "\u001f")
    names = ("sha", "parent", "author", "author_date", "subject", "body")
    return spark.read.text(path).where(F.size(part) == 6).select(*(part[i].alias(n) for i, n in enumerate(names)))


def name_status(spark: SparkSession, path: str) -> DataFrame:
    """status, path of name-status lines: the first letter, and the last path of a rename."""
    part = F.split("value", "\t")
    return spark.read.text(path).where(F.size(part) >= 2).select(F.substring(part[0], 1, 1).alias("status"), F.element_at(part, -1).alias("path"))


def test_summary(lines: DataFrame) -> DataFrame:
    """outcome, test of the failing lines of test summaries (column ``value``)."""
    outcome = F.regexp_extract("value", r"^(FAIL|XPASS|UNRESOLVED|ERROR): (.*)$", 1)
    return lines.where(outcome != "").select(outcome.alias("outcome"), F.regexp_extract("value", r"^[A-Z]+: (.*)$", 1).alias("test"))


def patch_files(patches: DataFrame) -> DataFrame:
    """patch, path, added, deleted, is_test of every file of unified diffs (columns ``patch``, ``text``).

    Lines count within the file whose header precedes them; header lines themselves don't.
    """
    line = patches.select("patch", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    head = F.regexp_extract("line", r"^diff --git a/\S+ b/(\S+)$", 1)
    from pyspark.sql import Window

    order = Window.partitionBy("patch").orderBy("no")
    placed = line.withColumn("path", F.last(F.when(head != "", head), ignorenulls=True).over(order)).where("path is not null")
    added, deleted = F.col("line").rlike(r"^\+(?!\+\+ )"), F.col("line").rlike(r"^-(?!-- )")
    files = placed.groupBy("patch", "path").agg(F.count_if(added).alias("added"), F.count_if(deleted).alias("deleted"))
    return files.withColumn("is_test", F.array_contains(F.split("path", "/"), "testsuite"))
