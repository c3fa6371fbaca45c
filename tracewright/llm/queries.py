"""Queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.common import ASCII, TOKENS
from ..session import table
from .components import finding_groups
from .handwritten import not_handwritten
from .languages import mislabelled, segments
from .leaks import leaks
from .licenses import licenses
from .near_duplicates import similar_files, similar_groups
from .packing import containers
from .shared_spans import list_classes, pair_passages, shared_shares, spans


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return not_handwritten(table(spark, sf, "corpus_files")).select("file_id")


def p1_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return not_handwritten(table(spark, sf, "corpus_files"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return licenses(table(spark, sf, "corpus_files"), table(spark, sf, "corpus_sources"), table(spark, sf, "license_refs"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return finding_groups(table(spark, sf, "downstream_findings"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans(table(spark, sf, "files")).select("file_id", "first_pos", "last_pos")


def p5_passages(spark: SparkSession, sf: str) -> DataFrame:
    return pair_passages(table(spark, sf, "files"))


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    return list_classes(table(spark, sf, "files"))


def p5_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shared_shares(table(spark, sf, "files"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar_files(table(spark, sf, "files"), table(spark, sf, "corpus_files"))


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return similar_groups(table(spark, sf, "files"), table(spark, sf, "corpus_files"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return containers(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return mislabelled(table(spark, sf, "documents")).select("doc_id", "seg_no", "lang")


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    return segments(table(spark, sf, "documents")).select("doc_id", "seg_no", "lang", "confidence")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_kinds, p2_found, p4_found, p5_found, p5_passages, p5_classes, p5_shares, p6_found, p6_groups, p7_containers, p8_found, p9_found, p9_segments)
}

def _clean(column: str) -> str:
    unix = f"'/' || replace(trim({column}), chr(92), '/') || '/'"
    plain = f"regexp_replace(regexp_replace({unix}, '/(\\./)+', '/', 'g'), '/+', '/', 'g')"
    return f"regexp_replace(regexp_replace({plain}, '/[^/]+/\\.\\./', '/', 'g'), '/[^/]+/\\.\\./', '/', 'g')"


_P5_RUNS = """WITH f AS (SELECT DISTINCT file_id, winnow_hashes AS h, winnow_positions AS p FROM files), w AS (SELECT file_id, unnest(range(1, len(h) - 28)) AS i, h, p FROM f WHERE len(h) >= 30),
        g AS (SELECT file_id, i, md5(array_to_string(h[i:i+29], ',')) AS seed FROM w), s AS (SELECT seed FROM g GROUP BY seed HAVING count(DISTINCT file_id) > 1),
        r AS (SELECT file_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY file_id ORDER BY i) <= 30 THEN 0 ELSE 1 END AS new FROM g WHERE seed IN (FROM s)),
        n AS (SELECT file_id, i, sum(new) OVER (PARTITION BY file_id ORDER BY i) AS run FROM r), b AS (SELECT file_id, min(i) AS a, max(i) + 29 AS z FROM n GROUP BY file_id, run)"""
_P6_SETS = f"""c AS (SELECT DISTINCT file_id, {ASCII} AS text FROM corpus_files WHERE file_id IN (SELECT file_id FROM files)), t AS (SELECT file_id, {TOKENS} AS t FROM c),
        s AS (SELECT DISTINCT file_id, unnest(list_transform(range(1, greatest(len(t) - 4, 1) + 1), lambda i: md5(array_to_string(t[i:i+4], ' ')))) AS s FROM t WHERE len(t) > 0), n AS (SELECT file_id, count(*) AS n FROM s GROUP BY file_id),
        m AS (SELECT a.file_id AS x, b.file_id AS y, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.file_id < b.file_id GROUP BY 1, 2),
        e AS (SELECT x, y, common = a.n AND common = b.n AS same FROM m JOIN n a ON a.file_id = x JOIN n b ON b.file_id = y WHERE common >= 0.6 * (a.n + b.n - common))"""

#: SQL for the problems that it can express; the others are tested against brute force.
SQL = {
    "p4_found": f"""WITH RECURSIVE k AS (SELECT DISTINCT finding_id, 'o' || {_clean('gcc_path')} AS key FROM downstream_findings WHERE trim(gcc_path) <> ''
            UNION SELECT DISTINCT finding_id, 'u' || lower(trim(upstream_project)) || {_clean('upstream_relpath')} FROM downstream_findings WHERE trim(upstream_relpath) <> '' AND trim(upstream_project) <> ''),
        h AS (SELECT key, min(finding_id) AS head FROM k GROUP BY key), e AS (SELECT DISTINCT finding_id AS a, head AS b FROM k JOIN h USING (key) WHERE finding_id <> head),
        twoway AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, b AS other FROM twoway UNION SELECT node, b FROM reach JOIN twoway ON a = other)
        SELECT node AS finding_id, least(node, min(other)) AS group_id FROM reach GROUP BY node""",
    "p5_found": f"{_P5_RUNS} SELECT file_id, p[a] AS first_pos, p[z] AS last_pos FROM b JOIN f USING (file_id)",
    "p5_shares": f"""{_P5_RUNS}, t AS (SELECT file_id, sum(z - a + 1) AS shared, max(z - a + 1) AS longest FROM b GROUP BY file_id)
        SELECT f.file_id, len(h)::INTEGER AS entries, coalesce(shared, 0)::BIGINT AS shared_entries, CASE WHEN len(h) > 0 THEN round(coalesce(shared, 0) / len(h), 6) ELSE 0 END AS shared_share, coalesce(longest, 0)::INTEGER AS longest_run
        FROM f LEFT JOIN t ON t.file_id = f.file_id""",
    "p5_classes": """WITH f AS (SELECT DISTINCT file_id, array_to_string(winnow_hashes, ',') AS list FROM files WHERE len(winnow_hashes) >= 30 AND len(winnow_hashes) = len(winnow_positions))
        SELECT file_id, min(file_id) OVER (PARTITION BY list) AS class, count(*) OVER (PARTITION BY list) AS copies FROM f""",
    "p6_found": f"WITH {_P6_SETS} SELECT x AS file_id_a, y AS file_id_b FROM e",
    "p6_groups": f"""WITH RECURSIVE {_P6_SETS}, twoway AS (SELECT x AS a, y AS b FROM e UNION SELECT y, x FROM e), reach AS (SELECT a AS node, b AS other FROM twoway UNION SELECT node, b FROM reach JOIN twoway ON a = other)
        SELECT n.file_id, least(n.file_id, (SELECT min(x) FROM e WHERE same AND y = n.file_id)) AS class, least(n.file_id, (SELECT min(other) FROM reach WHERE node = n.file_id)) AS group_id FROM n""",
}
