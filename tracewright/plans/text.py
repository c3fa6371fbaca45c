"""Scalar text functions, winnowing and pair metrics (inventory 2.4, 2.6 and 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.headers import ATTRIBUTIONS, CANONICAL, DOWNSTREAM_ATTRIBUTIONS, EXTERNAL_MARKERS, GNU, HOLDER, HOST_SITES, HOST_TERMS, INLINE_LICENSES, INTERNAL, ORIGIN, ORIGIN_POINTS, PART_OF, SPDX, SUPPRESSING, URL_TAIL, attributed, clone_language, evidence, header_points, snippet_quality
from ..functions.text import KGRAM, SHINGLE, WINDOW, ascii_text, first_lines, glob_pattern, hashed, jaccard, runs_of, strip_leading_comment, stripped_lines, tlsh_distance, tokens
from ..operators.similarity import kgrams, longest_run, once, one_row_a_file, posting_matches, top_k, winnow, winnow_density
from ..session import cut_lineage, table
from .common import ASCII, CORPUS, TOKENS, jaccard_sql, runs_sql
from .findings import SQL as _FINDING_SQL, j18_ancestor_licenses
from .scan import _ONE_FILE, corpus, corpus_once


def x1_tokens(spark, sf):
    t = corpus(spark, sf).select("file_id", tokens(F.col("text")).alias("t"))
    return t.select("file_id", F.size("t").cast("bigint").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest")).distinct()


def x2_stripped(spark, sf):
    s = corpus(spark, sf).select("file_id", strip_leading_comment(F.col("text")).alias("s"))
    return s.select("file_id", F.length("s").cast("bigint").alias("chars"), F.md5("s").alias("digest")).distinct()


def _tokenised(spark, sf):
    # The table keeps the tokens from being computed again inside each later expression.
    return cut_lineage(corpus_once(spark, sf).select("file_id", tokens(strip_leading_comment(F.col("text"))).alias("tokens")))


def x3_kgrams(spark, sf):
    g = kgrams(_tokenised(spark, sf), "file_id")
    return g.select("file_id", F.size("hashes").cast("bigint").alias("kgrams"), F.size(F.array_distinct("hashes")).cast("bigint").alias("distinct_kgrams"), F.array_min("hashes").alias("least"))


def x4_shingles(spark, sf):
    full = cut_lineage(corpus(spark, sf).select("file_id", tokens(F.col("text")).alias("tokens")))
    return full.select("file_id", F.size(F.array_distinct(runs_of(F.col("tokens"), SHINGLE))).cast("bigint").alias("shingles")).distinct()


def w1_winnow(spark, sf):
    return winnow(kgrams(_tokenised(spark, sf), "file_id"), "file_id").select("file_id", F.col("pos").cast("bigint").alias("pos"), "hash")


def x5_evidence(spark, sf):
    e = corpus(spark, sf).select("file_id", evidence(first_lines(F.col("text"), 80)).alias("e"))
    return e.select("file_id", F.array_join("e", "|").alias("evidence"), F.when(F.size("e") > 0, "marked").otherwise("silent").alias("header_class")).distinct()


def x6_attributed(spark, sf):
    """Whether a file names the host project, by the mentions that count upstream and by those that count downstream."""
    t = F.col("text")
    return corpus(spark, sf).select("file_id", attributed(t).alias("attributed"), attributed(t, DOWNSTREAM_ATTRIBUTIONS).alias("downstream")).distinct()


def x12_snippets(spark, sf):
    """The three best search phrases of every file."""
    line = corpus_once(spark, sf).select("file_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda l: F.regexp_replace(l, "\r", "")))).alias("line"))
    scored = line.withColumn("quality", snippet_quality(F.col("line")).cast("bigint")).where("quality >= 0")
    return top_k(scored, ["file_id"], [F.col("quality").desc(), F.col("line")], 3).select("file_id", F.col("rank").cast("bigint").alias("rank"), "quality", F.md5("line").alias("digest"))


def x14_languages(spark, sf):
    return table(spark, sf, "corpus_files", ["file_id", "relpath"]).distinct().groupBy(clone_language(F.col("relpath")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def x15_digests(spark, sf):
    """Files whose stored digest is that of their content."""
    now = table(spark, sf, "corpus_files", ["file_id", "bytes"]).select("file_id", F.sha2("bytes", 256).alias("sha")).distinct()
    index = one_row_a_file(table(spark, sf, "files", ["file_id", "sha256", "indexed_at"]))
    return index.join(now, "file_id").select("file_id", (F.col("sha") == F.col("sha256")).alias("same"))


def _claimed(spark, sf):
    """finding_id, place, own and other file_id of every match that names a file of the index."""
    f = table(spark, sf, "source_findings", ["finding_id", "path", "matches"]).dropDuplicates(["finding_id"])
    path = F.regexp_replace("path", r"^(\./)+", "")
    m = f.select("finding_id", F.regexp_extract(path, "^([^/]+)/", 1).alias("p"), F.regexp_replace(path, "^[^/]+/", "").alias("r"), F.posexplode("matches").alias("place", "m")).where("m is not null")
    files = table(spark, sf, "files", ["file_id", "project", "relpath"]).distinct()
    own = files.select(F.col("file_id").alias("own"), F.col("project").alias("p"), F.col("relpath").alias("r"))
    other = files.select(F.col("file_id").alias("other"), F.col("project").alias("mp"), F.col("relpath").alias("mr"))
    named = m.select("finding_id", F.col("place").cast("bigint").alias("place"), "p", "r", F.col("m.project").alias("mp"), F.col("m.relpath").alias("mr"))
    return named.join(own, ["p", "r"]).join(other, ["mp", "mr"]).select("finding_id", "place", "own", "other")


def _used(pairs, files):
    """The files that occur in pairs, once each."""
    ids = cut_lineage(pairs.select(F.col("own").alias("file_id")).union(pairs.select("other")).distinct())
    return once(files.join(ids, "file_id", "left_semi"), "file_id")


def _with_both(pairs, files, columns):
    """Pairs with columns of both files."""
    a = files.select(F.col("file_id").alias("own"), *(F.col(c).alias(f"{c}_a") for c in columns))
    b = files.select(F.col("file_id").alias("other"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return pairs.join(a, "own").join(b, "other")


def a1_pair_similarity(spark, sf):
    """Shingle and line similarity, recomputed, of every match of a finding."""
    pairs = _claimed(spark, sf)
    text = _used(pairs, table(spark, sf, "corpus_files", ["file_id", "bytes"])).select("file_id", ascii_text(F.col("bytes")).alias("text"))
    tokenised = cut_lineage(text.select("file_id", tokens(F.col("text")).alias("t"), hashed(stripped_lines(F.col("text"))).alias("lines")))
    sets = cut_lineage(tokenised.select("file_id", "lines", F.array_distinct(hashed(runs_of(F.col("t"), SHINGLE))).alias("shingles")))
    both = _with_both(pairs, sets, ["shingles", "lines"])
    return both.select("finding_id", "place", F.round(jaccard(F.col("shingles_a"), F.col("shingles_b")), 6).alias("shingle"), F.round(jaccard(F.col("lines_a"), F.col("lines_b")), 6).alias("line"))


def a3_pair_density(spark, sf):
    files = table(spark, sf, "files", ["file_id", "winnow_hashes"])
    pairs = _claimed(spark, sf)
    both = _with_both(pairs, _used(pairs, files), ["winnow_hashes"])
    return both.select("finding_id", "place", F.size(F.array_intersect("winnow_hashes_a", "winnow_hashes_b")).cast("bigint").alias("matched"), F.round(winnow_density(F.col("winnow_hashes_a"), F.col("winnow_hashes_b")), 6).alias("density"))


def a4_minhash_estimate(spark, sf):
    files = table(spark, sf, "files", ["file_id", "minhash"])
    pairs = _claimed(spark, sf)
    both = _with_both(pairs, _used(pairs, files), ["minhash"])
    same = F.size(F.filter(F.zip_with("minhash_a", "minhash_b", lambda a, b: a == b), lambda x: x))
    return both.select("finding_id", "place", F.round(same / F.size("minhash_a"), 6).alias("estimate"))


def x16_digest_distances(spark, sf):
    pairs = _claimed(spark, sf)
    both = _with_both(pairs, _used(pairs, table(spark, sf, "files", ["file_id", "tlsh"])), ["tlsh"])
    return both.select("finding_id", "place", F.coalesce(tlsh_distance(F.col("tlsh_a"), F.col("tlsh_b")), F.lit(-1)).alias("distance"))


def a5_file_sizes(spark, sf):
    f = one_row_a_file(table(spark, sf, "files", ["file_id", "project", "tokens", "kgrams", "winnow_hashes", "sha256", "indexed_at"]))
    return f.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"), F.sum("kgrams").alias("kgrams"), F.sum(F.size("winnow_hashes")).cast("bigint").alias("winnows"))


def w2_longest_run(spark, sf):
    files = once(table(spark, sf, "files", ["file_id", "winnow_hashes", "winnow_positions"]), "file_id")
    pairs = _claimed(spark, sf)
    used = pairs.select(F.col("own").alias("file_id")).union(pairs.select("other")).distinct()
    files = once(files.join(used, "file_id", "left_semi"), "file_id")
    a = files.select(F.col("file_id").alias("own"), F.col("winnow_hashes").alias("hashes"), F.col("winnow_positions").alias("positions"))
    b = files.select(F.col("file_id").alias("other_id"), F.col("winnow_hashes").alias("other"))
    # Many findings name the same pair; each is worked out once.
    each = pairs.select("own", "other").distinct().withColumnRenamed("other", "other_id").join(a, "own").join(b, "other_id").select(F.struct("own", F.col("other_id").alias("other")).alias("pair"), "hashes", "positions", "other")
    run = longest_run(each, "pair").select("pair.own", "pair.other", "longest_run")
    return pairs.join(run, ["own", "other"], "left").select("finding_id", "place", F.coalesce("longest_run", F.lit(0)).cast("bigint").alias("longest_run"))


def j2_posting_join(spark, sf):
    """Files that share winnow hashes with each file whose id is divisible by 100, against all files."""
    f = table(spark, sf, "files", ["file_id", "winnow_hashes"])
    hits = posting_matches(f.where("file_id % 100 = 0"), f)
    return hits.where("density >= 0.10").select("query_id", "file_id", "matched", F.round("density", 6).alias("density"))


BANDS = 28  # of two rows each: what a threshold of 0.2 over 128 permutations comes to


def j1_band_candidates(spark, sf):
    """For each file whose id is divisible by 100, the ten files that share the most MinHash bands."""
    f = once(table(spark, sf, "files", ["file_id", "minhash"]), "file_id")
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.concat_ws("-", b, F.element_at("minhash", 2 * b + 1), F.element_at("minhash", 2 * b + 2)))
    keyed = f.select("file_id", F.explode(key).alias("band"))
    hits = keyed.where("file_id % 100 = 0").withColumnRenamed("file_id", "query_id").join(keyed, "band").where("query_id <> file_id").groupBy("query_id", "file_id").agg(F.count(F.lit(1)).alias("bands"))
    return top_k(hits, ["query_id"], [F.col("bands").desc(), F.col("file_id")], 10).select("query_id", "file_id", "bands", F.col("rank").cast("bigint").alias("rank"))


#: Review entries of the score: globs over project/relpath with their kinds; the first that matches counts.
REVIEW = (
    ("*/node_modules/*", "false_positive"), ("*/third_party/*", "accepted_external"), ("*/vendor/*", "needs_local_license"), ("larkcc/p00/testsuite/*", "project_policy"),
)
#: Files of this project are added here.
OWN = "larkcc"


def x10_header_scores(spark, sf):
    """Points of every source file's first 80 lines, of the licence files around it and of its review entry, with the reasons."""
    around = j18_ancestor_licenses(spark, sf).withColumn("root", F.col("nearest").isNotNull() & (F.col("nearest") == ""))
    path = F.concat_ws("/", "project", "relpath")
    kind = F.lit(None).cast("string")
    for g, k in reversed(REVIEW):
        kind = F.when(path.rlike(glob_pattern(g)), k).otherwise(kind)
    head = corpus(spark, sf).select("file_id", first_lines(F.col("text"), 80).alias("head"), kind.alias("kind"), (F.col("project") == OWN).alias("local"))
    found = head.join(around, "file_id").select("file_id", header_points(F.col("head"), F.col("licences") > 0, F.coalesce("root", F.lit(False)), F.col("kind"), F.coalesce("local", F.lit(False))).alias("p"))
    score = F.aggregate("p", F.lit(0), lambda acc, x: acc + x["points"])
    return found.select("file_id", score.cast("bigint").alias("score"), F.array_join(F.col("p.reason"), "|").alias("reasons"), F.arrays_overlap(F.col("p.reason"), F.array(*map(F.lit, SUPPRESSING))).alias("suppressed")).distinct()


def m0_document_pairs(spark, sf):
    """For each document whose id is divisible by 100, the three that have most of its winnowed hashes, a quarter at least.

    Documents are fingerprinted row by row; only hashes of the asking documents meet the postings.
    """
    docs = table(spark, sf, "documents", ["doc_id", "text"]).where("doc_id is not null")
    prints = cut_lineage(winnow(kgrams(docs.select("doc_id", tokens(F.col("text")).alias("tokens")), "doc_id"), "doc_id").select("doc_id", "hash"))
    asked = prints.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "hash").distinct()
    size = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("hashes"))
    hits = prints.join(asked, "hash").where("query_id <> doc_id").distinct().groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("matched"))
    dense = hits.join(size, "query_id").withColumn("d", F.col("matched") / F.col("hashes")).where("d >= 0.25")
    top = top_k(dense, ["query_id"], [F.col("d").desc(), F.col("doc_id")], 3)
    return top.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "matched", F.round("d", 6).alias("density"))


def m0_near_duplicates(spark, sf):
    """Every match of every finding with its recomputed density, best first within the finding."""
    d = a3_pair_density(spark, sf).where("density >= 0.25")
    return top_k(d, ["finding_id"], [F.col("density").desc(), F.col("place")], 3).select("finding_id", F.col("rank").cast("bigint").alias("rank"), "place", "density")


QUERIES = {
    f.__name__: f
    for f in (
        x1_tokens, x2_stripped, x3_kgrams, x4_shingles, w1_winnow, x5_evidence, x6_attributed, x12_snippets, x14_languages, x15_digests, x16_digest_distances,
        a1_pair_similarity, a3_pair_density, a4_minhash_estimate, a5_file_sizes, w2_longest_run, j1_band_candidates, j2_posting_join, x10_header_scores, m0_document_pairs, m0_near_duplicates,
    )
}

_STRIP = r"regexp_replace(text, '\A[ \t\r\n]*(?:/\*(?s:.*?)\*/[ \t\r\n]*|//[^\n]*(?:\n|\z)(?:[ \t\r]*(?://[^\n]*)?(?:\n|\z))*|![^\n]*(?:\n|\z)(?:[ \t\r]*(?:![^\n]*)?(?:\n|\z))*)', '')"
_TOKENISED = f"{CORPUS}, tokenised AS (SELECT file_id, {TOKENS} AS t FROM (SELECT file_id, {_STRIP} AS text FROM corpus))"
_GRAMS_OF = f"""grams AS (SELECT file_id, n, unnest(g) AS hash, unnest(range(0, len(g))) AS pos FROM (SELECT file_id, greatest(len(t) - {KGRAM - 1}, 1) AS n, list_transform({runs_sql('t', KGRAM)}, lambda s: substr(md5(s), 1, 16)) AS g FROM tokenised WHERE len(t) > 0))"""
_GRAMS = f"{_TOKENISED}, {_GRAMS_OF}"
_WINNOWED = f"""w AS (SELECT file_id, n, pos, min({{'h': hash, 'b': -pos}}) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS m FROM grams WHERE n > {WINDOW}),
        prints AS (SELECT DISTINCT file_id, m.h AS hash FROM w WHERE pos <= n - {WINDOW} UNION SELECT file_id, min(hash) FROM grams WHERE n <= {WINDOW} GROUP BY file_id)"""
_CLAIMED = f"""named AS (SELECT finding_id, split_part(p, '/', 1) AS p, regexp_replace(p, '^[^/]+/', '') AS r, m, place - 1 AS place FROM (
    SELECT finding_id, regexp_replace(path, '^(\\./)+', '') AS p, unnest(matches) AS m, unnest(range(1, len(matches) + 1)) AS place FROM (SELECT DISTINCT ON (finding_id) * FROM source_findings)) WHERE m IS NOT NULL),
    one_file AS {_ONE_FILE}, f AS (SELECT DISTINCT file_id, project, relpath FROM files),
    claimed AS (SELECT finding_id, place, a.file_id AS own, b.file_id AS other FROM named JOIN f a ON a.project = p AND a.relpath = r JOIN f b ON b.project = m.project AND b.relpath = m.relpath)"""
_DENSITY = f"""{_CLAIMED}, density AS (SELECT finding_id, place, len(list_intersect(a.winnow_hashes, b.winnow_hashes))::BIGINT AS matched,
    round(len(list_intersect(a.winnow_hashes, b.winnow_hashes))::DOUBLE / len(list_distinct(a.winnow_hashes)), 6) AS density FROM claimed JOIN one_file a ON a.file_id = own JOIN one_file b ON b.file_id = other)"""
_HEAD80 = "array_to_string(string_split(text, chr(10))[1:80], chr(10))"
_AROUND = _FINDING_SQL["j18_ancestor_licenses"]
_Q = lambda p: p.replace("'", "''")
_HOLDERS = "list_filter(regexp_extract_all(h, '" + HOLDER + "', 1), lambda x: trim(x) <> '' AND NOT contains(lower(x), 'free software foundation') AND NOT (contains(lower(x), 'gnu') AND contains(lower(x), 'org')))"
_CASES = lambda names: "CASE " + " ".join(f"WHEN contains(lower(h), '{_Q(p)}') THEN '{_Q(n)}'" for p, n in names) + " END"
_PART = f"trim(regexp_extract(h, '{PART_OF}', 1))"
_ANY = lambda phrases: "(" + " OR ".join(f"contains(low, '{_Q(p)}')" for p in phrases) + ")"
#: Reason, points and condition of each term of the score, in order.
_TERMS = [
    ("reviewed", -20, "kind IS NOT NULL"), ("false-positive", -1000, "kind = 'false_positive'"), ("accepted-inherited", -1000, "kind = 'accepted_external' AND NOT own"), ("accepted", -60, "kind = 'accepted_external'"),
    ("policy", -1000, "kind = 'project_policy'"), ("needs-license", 15, "kind = 'needs_local_license'"), ("spdx", -35, "spdx"), ("gnu-header", -30, "gnu"), ("licence-near", -20, "nearby"), ("licence-in-tree", -15, "tree AND NOT nearby"),
    ("origin-inside", -35, "origin AND inside"), ("origin-outside", 55, "origin AND NOT inside"), *((f"marker:{m}", n, f"contains(low, '{m}')") for m, n in ORIGIN_POINTS.items()),
    ("licence-file-there", -35, "lic AND tree"), ("licence-file-missing", 35, "lic AND NOT tree"), ("rights-with-trail", -10, "rights AND trail"), ("rights-reserved", 20, "rights AND NOT trail"), ("bsd-with-trail", -20, "bsd AND tree"), ("bsd-style", 20, "bsd AND NOT tree"),
    ("holder-with-trail", 20, "holder AND trail"), ("holder", 70, "holder AND NOT trail"), ("external-with-trail", -20, "marker AND tree"), ("external", 15, "marker AND NOT tree AND NOT nearby"),
]
_SNIP = (
    "CASE WHEN length(line) < 24 OR length(line) > 180 OR length(regexp_replace(line, '[^A-Za-z]', '', 'g')) < 12 OR "
    + " OR ".join(f"starts_with(bare, '{b}')" for b in ("/*", "*", "//", "#", "! { dg-"))
    + " OR "
    + " OR ".join(f"contains(lower(bare), '{p}')" for p in ("all rights reserved", "redistribution and use in source and binary forms", "this software is provided", "notice, this list of conditions and the following disclaimer", "permission is hereby granted", "the above copyright notice", "without specific prior written permission", "free software foundation"))
    + " THEN -1 ELSE len(list_distinct(string_split(bare, ''))) + length(bare) END"
)

SQL = {
    "x1_tokens": f"WITH {CORPUS} SELECT file_id, len(t)::BIGINT AS tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT file_id, {TOKENS} AS t FROM corpus)",
    "x2_stripped": f"WITH {CORPUS} SELECT file_id, length(s)::BIGINT AS chars, md5(s) AS digest FROM (SELECT file_id, {_STRIP} AS s FROM corpus)",
    "x3_kgrams": f"WITH {_GRAMS} SELECT file_id, count(*)::BIGINT AS kgrams, count(DISTINCT hash)::BIGINT AS distinct_kgrams, min(hash) AS least FROM grams GROUP BY file_id",
    "x4_shingles": f"WITH {CORPUS} SELECT file_id, len(list_distinct({runs_sql('t', SHINGLE)}))::BIGINT AS shingles FROM (SELECT file_id, {TOKENS} AS t FROM corpus)",
    "w1_winnow": f"""WITH {_GRAMS}, w AS (SELECT file_id, n, pos, min({{'h': hash, 'b': -pos}}) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS m FROM grams WHERE n > {WINDOW})
        SELECT DISTINCT file_id, (-m.b)::BIGINT AS pos, m.h AS hash FROM w WHERE pos <= n - {WINDOW} UNION ALL SELECT file_id, min({{'h': hash, 'p': pos}}).p::BIGINT, min(hash) FROM grams WHERE n <= {WINDOW} GROUP BY file_id""",
    "x5_evidence": f"""WITH {CORPUS}, h AS (SELECT file_id, {_HEAD80} AS h FROM corpus), e AS (SELECT file_id, list_filter([CASE WHEN regexp_matches(h, '{SPDX}') THEN 'SPDX' END, CASE WHEN regexp_matches(h, '{ORIGIN}') THEN 'origin-phrase' END,
        CASE WHEN regexp_matches(h, '{CANONICAL}') THEN 'canonical-source' END, CASE WHEN len(list_filter(regexp_extract_all(h, '{URL_TAIL}'), lambda u: NOT regexp_matches(u, '{HOST_SITES}'))) > 0 THEN 'external-url' END,
        {_CASES([(p, 'inline-license:' + p[:24]) for p in INLINE_LICENSES])}, {_CASES([(m.lower(), 'external-marker:' + m) for m in EXTERNAL_MARKERS])}, 'copyright:' || trim(substr(trim({_HOLDERS}[1]), 1, 40)),
        CASE WHEN {_PART} <> '' AND NOT ({" OR ".join(f"contains(lower({_PART}), '{t}')" for t in HOST_TERMS)}) THEN 'part-of:' || substr({_PART}, 1, 48) END], lambda x: x IS NOT NULL) AS e FROM h)
        SELECT file_id, array_to_string(e, '|') AS evidence, CASE WHEN len(e) > 0 THEN 'marked' ELSE 'silent' END AS header_class FROM e""",
    "x10_header_scores": f"""WITH {CORPUS}, around AS ({_AROUND}), h AS (SELECT file_id, {_HEAD80} AS h, licences > 0 AS nearby, coalesce(nearest = '', false) AS tree, coalesce(project = '{OWN}', false) AS own,
            CASE {" ".join(f"WHEN project || '/' || relpath GLOB '{g}' THEN '{k}'" for g, k in REVIEW)} END AS kind FROM corpus JOIN around USING (file_id)),
        f AS (SELECT *, lower(h) AS low, regexp_matches(h, '{SPDX}') AS spdx, regexp_matches(h, '{GNU}') AS gnu, regexp_matches(h, '{ORIGIN}') AS origin, regexp_matches(h, '{_Q(INTERNAL)}') AS inside, len({_HOLDERS}) > 0 AS holder FROM h),
        g AS (SELECT *, spdx OR gnu OR contains(low, 'license') OR nearby OR tree AS trail, contains(low, 'license that can be found in the license file') AS lic, contains(low, 'all rights reserved') AS rights, contains(low, 'bsd-style') AS bsd, {_ANY([m.lower() for m in EXTERNAL_MARKERS])} AS marker, {_ANY(INLINE_LICENSES)} AS inline FROM f),
        p AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, _, c in _TERMS)}], lambda x: x IS NOT NULL) AS r, {" + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for _, n, c in _TERMS)} AS s FROM g),
        q AS (SELECT file_id, list_concat(r, list_filter([CASE WHEN own AND s > 0 THEN 'local' END, CASE WHEN NOT own AND trail AND inline THEN 'inherited' END], lambda x: x IS NOT NULL)) AS r, s + CASE WHEN own AND s > 0 THEN 20 ELSE 0 END + CASE WHEN NOT own AND trail AND inline THEN -1000 ELSE 0 END AS s FROM p)
        SELECT file_id, s::BIGINT AS score, array_to_string(r, '|') AS reasons, list_has_any(r, {list(SUPPRESSING)}) AS suppressed FROM q""",
    "j1_band_candidates": f"""WITH o AS {_ONE_FILE}, k AS (SELECT file_id, b, minhash[2 * b + 1] AS x, minhash[2 * b + 2] AS y FROM (SELECT file_id, minhash, unnest(range(0, {BANDS})) AS b FROM o)),
        h AS (SELECT q.file_id AS query_id, k.file_id, count(*)::BIGINT AS bands FROM k q JOIN k USING (b, x, y) WHERE q.file_id % 100 = 0 AND q.file_id <> k.file_id GROUP BY 1, 2)
        SELECT query_id, file_id, bands, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bands DESC, file_id) AS rank FROM h) WHERE rank <= 10""",
    "x6_attributed": f"WITH {CORPUS} SELECT file_id, {' OR '.join(f"regexp_matches(text, '{p}')" for p in ATTRIBUTIONS)} AS attributed, {' OR '.join(f"regexp_matches(text, '{p}')" for p in DOWNSTREAM_ATTRIBUTIONS)} AS downstream FROM corpus",
    "x12_snippets": rf"""WITH {CORPUS}, lines AS (SELECT DISTINCT file_id, replace(unnest(string_split(text, chr(10))), chr(13), '') AS line FROM corpus), scored AS (SELECT file_id, line, ({_SNIP})::BIGINT AS quality FROM (SELECT *, trim(line) AS bare FROM lines))
        SELECT file_id, rank, quality, md5(line) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY quality DESC, line) AS rank FROM scored WHERE quality >= 0) WHERE rank <= 3""",
    "x14_languages": r"SELECT CASE WHEN s = 'rs' THEN 'rust' WHEN s = 'go' THEN 'go' WHEN s = 'py' THEN 'python' WHEN s IN ('f', 'f90', 'f95', 'f03', 'f08', 'for', 'fpp') THEN 'fortran' ELSE 'cpp' END AS language, count(*)::BIGINT AS files FROM (SELECT DISTINCT file_id, lower(regexp_extract(relpath, '\.([^./]*)$', 1)) AS s FROM corpus_files) GROUP BY 1",
    "x15_digests": f"SELECT o.file_id, o.sha256 = c.sha AS same FROM {_ONE_FILE} o JOIN (SELECT DISTINCT file_id, sha256(bytes) AS sha FROM corpus_files) c USING (file_id)",
    "a1_pair_similarity": f"""WITH {_CLAIMED}, used AS (SELECT own AS file_id FROM claimed UNION SELECT other FROM claimed), texts AS (SELECT DISTINCT file_id, {ASCII} AS text FROM corpus_files WHERE file_id IN (FROM used)),
        toks AS (SELECT file_id, {TOKENS} AS t, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^[ \\t\\r\\f\\x0b]+|[ \\t\\r\\f\\x0b]+$', '', 'g')), lambda l: l <> '')) AS lines FROM texts),
        sets AS (SELECT file_id, lines, list_distinct({runs_sql('t', SHINGLE)}) AS s FROM toks)
        SELECT finding_id, place, round({jaccard_sql('a.s', 'b.s')}, 6) AS shingle, round({jaccard_sql('a.lines', 'b.lines')}, 6) AS line FROM claimed JOIN sets a ON a.file_id = own JOIN sets b ON b.file_id = other""",
    "a3_pair_density": f"WITH {_DENSITY} SELECT * FROM density",
    "a4_minhash_estimate": f"WITH {_CLAIMED} SELECT finding_id, place, round(len(list_filter(list_zip(a.minhash, b.minhash), lambda x: x[1] = x[2]))::DOUBLE / len(a.minhash), 6) AS estimate FROM claimed JOIN one_file a ON a.file_id = own JOIN one_file b ON b.file_id = other",
    "x16_digest_distances": f"""WITH {_CLAIMED}, d AS (SELECT finding_id, place, a.tlsh AS a, b.tlsh AS b FROM claimed JOIN one_file a ON a.file_id = own JOIN one_file b ON b.file_id = other),
        n AS (SELECT finding_id, place, list_transform(string_split(a[3:], ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS x, list_transform(string_split(b[3:], ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS y, a[3:4] <> b[3:4] AS other FROM d WHERE regexp_matches(a, '^T1[0-9A-F]{{70}}$') AND regexp_matches(b, '^T1[0-9A-F]{{70}}$')),
        h AS (SELECT *, abs(16 * x[4] + x[3] - 16 * y[4] - y[3]) AS l, abs(x[5] - y[5]) AS q, abs(x[6] - y[6]) AS r, list_sum(list_transform(range(7, 71), lambda i: (CASE WHEN abs(x[i] // 4 - y[i] // 4) = 3 THEN 6 ELSE abs(x[i] // 4 - y[i] // 4) END) + (CASE WHEN abs(x[i] % 4 - y[i] % 4) = 3 THEN 6 ELSE abs(x[i] % 4 - y[i] % 4) END))) AS body FROM n),
        k AS (SELECT finding_id, place, least(l, 256 - l) AS l, least(q, 16 - q) AS q, least(r, 16 - r) AS r, other, body FROM h)
        SELECT d.finding_id, d.place, coalesce(body + (CASE WHEN l <= 1 THEN l ELSE l * 12 END) + (CASE WHEN q <= 1 THEN q ELSE (q - 1) * 12 END) + (CASE WHEN r <= 1 THEN r ELSE (r - 1) * 12 END) + (CASE WHEN other THEN 1 ELSE 0 END), -1)::BIGINT AS distance FROM d LEFT JOIN k ON k.finding_id = d.finding_id AND k.place = d.place""",
    "a5_file_sizes": f"SELECT project, count(*)::BIGINT AS files, sum(tokens)::BIGINT AS tokens, sum(kgrams)::BIGINT AS kgrams, sum(len(winnow_hashes))::BIGINT AS winnows FROM {_ONE_FILE} GROUP BY project",
    "w2_longest_run": f"""WITH {_CLAIMED}, pairs AS (SELECT DISTINCT own, other FROM claimed), entry AS (SELECT own, other, unnest(range(0, len(a.winnow_hashes))) AS place, unnest(a.winnow_positions) AS pos, unnest(list_transform(a.winnow_hashes, lambda h: list_contains(b.winnow_hashes, h))) AS hit
            FROM pairs JOIN one_file a ON a.file_id = own JOIN one_file b ON b.file_id = other),
        marked AS (SELECT *, (CASE WHEN NOT hit OR NOT coalesce(lag(hit) OVER w, false) OR pos - lag(pos) OVER w > 3 THEN 1 ELSE 0 END) AS new FROM entry WINDOW w AS (PARTITION BY own, other ORDER BY place)),
        island AS (SELECT *, sum(new) OVER (PARTITION BY own, other ORDER BY place) AS i FROM marked),
        best AS (SELECT own, other, max(n) AS run FROM (SELECT own, other, i, count(*) AS n FROM island WHERE hit GROUP BY ALL) GROUP BY own, other)
        SELECT finding_id, place, coalesce(run, 0)::BIGINT AS longest_run FROM claimed LEFT JOIN best USING (own, other)""",
    "j2_posting_join": """WITH p AS (SELECT DISTINCT file_id, unnest(winnow_hashes) AS hash FROM files), q AS (SELECT * FROM p WHERE file_id % 100 = 0), n AS (SELECT file_id AS query_id, count(*) AS n FROM q GROUP BY 1)
        SELECT query_id, file_id, matched, density FROM (SELECT query_id, h.file_id, matched::BIGINT AS matched, round(matched / n, 6) AS density, matched / n AS d FROM (SELECT q.file_id AS query_id, p.file_id, count(*) AS matched FROM q JOIN p USING (hash) WHERE q.file_id <> p.file_id GROUP BY 1, 2) h JOIN n USING (query_id)) WHERE d >= 0.10""",
    "m0_document_pairs": f"""WITH tokenised AS (SELECT doc_id AS file_id, {TOKENS} AS t FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)), {_GRAMS_OF}, {_WINNOWED},
        q AS (SELECT * FROM prints WHERE file_id % 100 = 0), z AS (SELECT file_id AS query_id, count(*) AS z FROM q GROUP BY 1), h AS (SELECT q.file_id AS query_id, p.file_id AS doc_id, count(*) AS matched FROM q JOIN prints p USING (hash) WHERE q.file_id <> p.file_id GROUP BY 1, 2),
        d AS (SELECT query_id, doc_id, matched, matched / z AS d FROM h JOIN z USING (query_id) WHERE matched / z >= 0.25)
        SELECT query_id, rank, doc_id, matched, round(d, 6) AS density FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, doc_id) AS rank FROM d) WHERE rank <= 3""",
    "m0_near_duplicates": f"WITH {_DENSITY} SELECT finding_id, rank, place, density FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY density DESC, place) AS rank FROM density WHERE density >= 0.25) WHERE rank <= 3",
}
