"""Whole scans, composed of the operators: from file contents to ranked findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.headers import evidence
from ..functions.text import SHINGLE, first_lines, hashed, jaccard, runs_of, strip_leading_comment, stripped_lines, tokens
from ..operators.scoring import classify_source
from ..operators.similarity import kgrams, longest_run, top_k, winnow
from ..session import cut_lineage, table
from .common import ASCII, TOKENS, jaccard_sql, runs_sql
from .scan import corpus_once
from .text import SQL as _TEXT_SQL

#: Matches that a finding keeps, candidates that reach the costly metrics, least density of a candidate.
KEEP, CANDIDATES, FLOOR = 3, 6, 0.10


def fingerprints(files: DataFrame) -> DataFrame:
    """file_id, pos, hash: the winnowed k-grams of every file (file_id, text) without its opening comment."""
    return winnow(kgrams(cut_lineage(files.select("file_id", tokens(strip_leading_comment(F.col("text"))).alias("tokens"))), "file_id"), "file_id")


def scan_sources(files: DataFrame, queries: DataFrame, keep: int = KEEP, candidates: int = CANDIDATES, floor: float = FLOOR) -> DataFrame:
    """One finding for each query file: its best match in other projects, severity and score.

    ``files``: file_id, project, text, one row each. ``queries``: file_id. Postings select the
    candidates, the densest few get the costly metrics, the best few of those are ranked, and the
    first decides the severity. A query without a match is a finding of severity low and score 0.
    """
    prints = cut_lineage(fingerprints(files).join(files.select("file_id", "project"), "file_id"))
    own = prints.join(queries, "file_id", "left_semi").select(F.col("file_id").alias("query_id"), F.col("project").alias("own"), "hash").distinct()
    size = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("hashes"))
    hits = prints.join(own, "hash").where("project <> own").select("query_id", "file_id", "hash").distinct().groupBy("query_id", "file_id").agg(F.count(F.lit(1)).alias("matched"))
    dense = hits.join(size, "query_id").select("query_id", "file_id", (F.col("matched") / F.col("hashes")).alias("density")).where(F.col("density") >= floor)
    pairs = cut_lineage(top_k(dense, ["query_id"], [F.col("density").desc(), F.col("file_id")], candidates).drop("rank"))

    used = cut_lineage(pairs.select(F.col("query_id").alias("file_id")).union(pairs.select("file_id")).union(queries.select("file_id")).distinct())
    texts = files.join(used, "file_id", "left_semi")
    plain = cut_lineage(texts.select("file_id", tokens(F.col("text")).alias("t"), hashed(stripped_lines(F.col("text"))).alias("lines"), (F.size(evidence(first_lines(F.col("text"), 80))) == 0).alias("silent")))
    entry = prints.join(used, "file_id", "left_semi").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("e"))  # no larger than a file
    sets = cut_lineage(
        plain.join(entry, "file_id", "left").select("file_id", "silent", "lines", F.array_distinct(hashed(runs_of(F.col("t"), SHINGLE))).alias("shingles"), hashed(F.col("e.hash")).alias("hashes"), F.col("e.pos").alias("positions"))
    )
    a = sets.select(F.col("file_id").alias("query_id"), *(F.col(c).alias(f"{c}_a") for c in ("shingles", "lines", "hashes", "positions")))
    b = sets.select("file_id", *(F.col(c).alias(f"{c}_b") for c in ("shingles", "lines", "hashes")))
    both = pairs.join(a, "query_id").join(b, "file_id")
    run = longest_run(both.select(F.struct("query_id", "file_id").alias("pair"), F.col("hashes_a").alias("hashes"), F.col("positions_a").alias("positions"), F.col("hashes_b").alias("other")), "pair")
    metric = both.select("query_id", "file_id", "density", jaccard(F.col("shingles_a"), F.col("shingles_b")).alias("shingle"), jaccard(F.col("lines_a"), F.col("lines_b")).alias("line"))
    scored = metric.join(run.select("pair.query_id", "pair.file_id", "longest_run"), ["query_id", "file_id"], "left").fillna(0, ["longest_run"])
    best = top_k(scored, ["query_id"], [(F.col("density") + F.col("shingle") + F.col("longest_run") / 200).desc(), F.col("file_id")], keep)
    first = best.where("rank = 1").join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("matches")), "query_id")
    rounded = first.select("query_id", F.col("file_id").alias("match_id"), "matches", *(F.round(c, 4).alias(c) for c in ("density", "shingle", "line")), F.col("longest_run").cast("bigint").alias("longest_run"))
    every = sets.join(queries, "file_id", "left_semi").select(F.col("file_id").alias("query_id"), "silent").join(rounded, "query_id", "left")
    severity, score = classify_source(*(F.col(c) for c in ("silent", "density", "shingle", "line", "longest_run")))
    return every.select("query_id", "match_id", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"), "density", "shingle", "line", "longest_run", severity.alias("severity"), F.coalesce(score, F.lit(0.0)).alias("score"))


def q1_scan_sources(spark, sf):
    """The scan of every file whose id is divisible by 100 against all files of other projects."""
    project = table(spark, sf, "corpus_files", ["file_id", "project"]).distinct()
    files = corpus_once(spark, sf).select("file_id", "text").join(project, "file_id")
    return scan_sources(files, project.where("file_id % 100 = 0").select("file_id"))


QUERIES = {"q1_scan_sources": q1_scan_sources}

_WINNOW = _TEXT_SQL["w1_winnow"]
_EVIDENCE = _TEXT_SQL["x5_evidence"]
SQL = {
    "q1_scan_sources": f"""WITH wi AS ({_WINNOW}), ev AS ({_EVIDENCE}), pr AS (SELECT DISTINCT file_id, project FROM corpus_files), w AS (SELECT wi.*, project FROM wi JOIN pr USING (file_id)),
        own AS (SELECT DISTINCT file_id AS query_id, project AS own, hash FROM w WHERE file_id % 100 = 0), sz AS (SELECT query_id, count(*) AS n FROM own GROUP BY 1),
        hit AS (SELECT query_id, file_id, count(DISTINCT hash) AS m FROM w JOIN own USING (hash) WHERE project <> own GROUP BY 1, 2),
        pair AS (SELECT query_id, file_id, m / n AS density FROM hit JOIN sz USING (query_id) WHERE m / n >= {FLOOR} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY m / n DESC, file_id) <= {CANDIDATES}),
        tx AS (SELECT DISTINCT file_id, bytes FROM corpus_files WHERE file_id IN (SELECT query_id FROM pair UNION SELECT file_id FROM pair)),
        tk AS (SELECT file_id, {TOKENS} AS t, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^[ \\t\\r\\f\\x0b]+|[ \\t\\r\\f\\x0b]+$', '', 'g')), lambda l: l <> '')) AS lines FROM (SELECT file_id, {ASCII} AS text FROM tx)),
        st AS (SELECT file_id, lines, list_distinct({runs_sql('t', SHINGLE)}) AS s, h, p FROM tk LEFT JOIN (SELECT file_id, list(hash ORDER BY pos) AS h, list(pos ORDER BY pos) AS p FROM wi GROUP BY file_id) USING (file_id)),
        two AS (SELECT query_id, pair.file_id, density, {jaccard_sql('a.s', 'b.s')} AS shingle, {jaccard_sql('a.lines', 'b.lines')} AS line, a.h AS ha, a.p AS pa, b.h AS hb FROM pair JOIN st a ON a.file_id = query_id JOIN st b ON b.file_id = pair.file_id),
        en AS (SELECT query_id, file_id, unnest(pa) AS pos, unnest(list_transform(ha, lambda x: list_contains(hb, x))) AS hit FROM two),
        mk AS (SELECT *, (CASE WHEN NOT hit OR NOT coalesce(lag(hit) OVER v, false) OR pos - lag(pos) OVER v > 3 THEN 1 ELSE 0 END) AS new FROM en WINDOW v AS (PARTITION BY query_id, file_id ORDER BY pos)),
        il AS (SELECT *, sum(new) OVER (PARTITION BY query_id, file_id ORDER BY pos) AS i FROM mk), rn AS (SELECT query_id, file_id, max(n) AS run FROM (SELECT query_id, file_id, i, count(*) AS n FROM il WHERE hit GROUP BY ALL) GROUP BY ALL),
        sc AS (SELECT query_id, file_id, density, shingle, line, coalesce(run, 0) AS run, row_number() OVER (PARTITION BY query_id ORDER BY density + shingle + coalesce(run, 0) / 200 DESC, file_id) AS k FROM two LEFT JOIN rn USING (query_id, file_id)),
        bs AS (SELECT query_id, file_id AS match_id, round(density, 4) AS d, round(shingle, 4) AS s, round(line, 4) AS l, run FROM sc WHERE k = 1), ct AS (SELECT query_id, count(*) AS matches FROM sc WHERE k <= {KEEP} GROUP BY 1),
        al AS (SELECT ev.file_id AS query_id, header_class = 'silent' AS silent, match_id, matches, d, s, l, run, 100 * d + 60 * s + 0.25 * run AS v FROM ev LEFT JOIN bs ON bs.query_id = ev.file_id LEFT JOIN ct ON ct.query_id = ev.file_id WHERE ev.file_id % 100 = 0),
        cl AS (SELECT *, CASE WHEN d IS NULL THEN 'none' WHEN silent AND l < 0.06 THEN (CASE WHEN d >= .25 AND s >= .20 THEN 'weak-medium' ELSE 'weak-low' END)
            WHEN NOT silent THEN (CASE WHEN d >= .85 OR s >= .85 THEN 'strong' WHEN d >= .60 OR s >= .70 THEN 'fair' ELSE 'poor' END)
            WHEN (d >= .60 AND s >= .45) OR s >= .70 THEN 'critical' WHEN (d >= .35 AND s >= .30) OR s >= .45 THEN 'high' WHEN (d >= .25 AND s >= .20) OR s >= .30 THEN 'medium' ELSE 'low' END AS c FROM al)
        SELECT query_id, match_id, coalesce(matches, 0)::BIGINT AS matches, d AS density, s AS shingle, l AS line, run::BIGINT AS longest_run,
            CASE c WHEN 'none' THEN 'low' WHEN 'weak-medium' THEN 'medium' WHEN 'weak-low' THEN 'low' WHEN 'strong' THEN 'review' WHEN 'fair' THEN 'review' WHEN 'poor' THEN 'low' ELSE c END AS severity,
            coalesce(round(CASE c WHEN 'none' THEN 0 WHEN 'weak-medium' THEN v * 0.6 WHEN 'weak-low' THEN v * 0.3 WHEN 'fair' THEN v * 0.8 WHEN 'poor' THEN v * 0.5 WHEN 'critical' THEN v + 50 WHEN 'high' THEN v + 20 ELSE v END, 2), 0) AS score FROM cl""",
}
