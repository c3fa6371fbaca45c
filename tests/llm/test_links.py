"""Linked groups and shared spans."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm.components import clean_path, components, finding_groups
from tracewright.llm.shared_spans import chain, chained_runs, common, shared_shares, spans

FILES = "file_id long, project string, winnow_hashes array<long>, winnow_positions array<int>, at int, seed string"


def by_union(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_random_graphs_and_chains(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(60)] + [(3000 - i, 2999 - i) for i in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    rows = [*edges, *edges[:5], (7, 7), (None, 3), (3, None)]
    df = spark.createDataFrame(rows, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == by_union(edges)
    assert components(df.limit(0)).count() == 0


def test_clean_path(spark):
    paths = ["./a//b/./c", "a\\b\\c ", "a/x/../b/c", "../a", "", None, " / ", "a/b/.."]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(clean_path(F.col("p"))).collect()]
    assert got == ["a/b/c", "a/b/c", "a/b/c", "a", "", None, "", "a"]


def test_finding_groups(spark):
    rows = [
        (5, "a/x.c", "P", "u.c"),
        (2, "./a//x.c", "q", None),
        (9, "b.c", " p ", "./u.c"),
        (9, "b.c", " p ", "./u.c"),
        (7, "B.c", "p", "U.c"),
        (1, None, None, None),
        (3, "", "", ""),
        (4, " ", None, "u.c"),
        (None, "a/x.c", "p", "u.c"),
    ]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "finding_id long, gcc_path string, upstream_project string, upstream_relpath string, path string, head int")
    assert {tuple(r) for r in finding_groups(df).collect()} == {(5, 2), (2, 2), (9, 2)}
    assert finding_groups(df.limit(0)).count() == 0


def brute(files, length=30):
    where = defaultdict(set)
    for f, h, _ in files:
        for i in range(len(h) - length + 1):
            where[tuple(h[i : i + length])].add(f)
    out = set()
    for f, h, p in files:
        hit = [False] * len(h)
        for i in range(len(h) - length + 1):
            if len(where[tuple(h[i : i + length])]) > 1:
                hit[i : i + length] = [True] * length
        i = 0
        while i < len(h):
            j = i
            while j < len(h) and hit[j]:
                j += 1
            if j > i:
                out.add((f, p[i], p[j - 1]))
            i = j + 1
    return out


def test_spans_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)]
    files = []
    for f in range(1, 13):
        h = []
        while len(h) < 150:
            a = rng.randrange(200)
            h += pool[a : a + rng.choice((10, 29, 30, 31, 45, 60))] + [rng.randrange(1 << 60) for _ in range(rng.choice((0, 1, 6)))]
        files.append((f, h, [3 * i + rng.randrange(3) for i in range(len(h))]))
    alone = pool[:40]
    files.append((50, alone * 1 + [1, 2] + [9], list(range(43))))
    rows = [(f, "p", h, p, 0, "s") for f, h, p in files] + [(1, "p", files[0][1], files[0][2], 0, "s"), (60, "p", None, None, 0, "s"), (61, "p", [], [], 0, "s"), (62, "p", [1] * 40, [1], 0, "s"), (None, "p", pool[:50], list(range(50)), 0, "s")]
    df = spark.createDataFrame(rows, FILES)
    got = [(r.file_id, r.first_pos, r.last_pos) for r in spans(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(files)
    share = {r.file_id: r for r in shared_shares(df).collect()}
    assert share[60].entries == 0 and share[60].shared_share == 0.0 and 0 < share[1].shared_share <= 1
    assert spans(df.limit(0)).count() == 0


def test_a_stretch_within_one_file_is_not_shared(spark):
    h = list(range(100, 140)) * 2
    df = spark.createDataFrame([(1, "p", h, list(range(80)), 0, "s"), (2, "p", [5] * 50, list(range(50)), 0, "s")], FILES)
    assert spans(df).count() == 0


def test_chain_takes_the_collinear_runs():
    x0 = np.array([0, 40, 90, 50])
    x1, y0 = x0 + 9, np.array([5, 45, 96, 300])
    number = chain(x0, x1, y0, y0 + 9, np.full(4, 20.0), 0.1)
    assert number[0] == number[1] == number[2] == 0 and number[3] == 1


def test_chain_equals_quadratic_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(2, 12))
        x0, y0 = np.sort(rng.choice(200, n, replace=False)), rng.integers(0, 200, n)
        length = rng.integers(1, 15, n)
        x1, y1, w = x0 + length, y0 + length, length.astype(float) + 3
        best = np.array(w)
        for k in range(n):
            for p in range(n):
                if x1[p] < x0[k] and y1[p] < y0[k]:
                    best[k] = max(best[k], w[k] + best[p] - 0.2 * (x0[k] - x1[p] + y0[k] - y1[p]))
        number = chain(x0, x1, y0, y1, w, 0.2)
        first = np.flatnonzero(number == 0)
        total, last = 0.0, None
        for k in first[np.argsort(x0[first])]:
            total += w[k] - (0 if last is None else 0.2 * (x0[k] - x1[last] + y0[k] - y1[last]))
            last = k
        assert abs(total - best.max()) < 1e-9


def test_a_third_of_all_rows_share_one_file(spark):
    rows = [(i, "same.c" if i % 3 == 0 else f"f{i}.c", "p", f"u{i}.c") for i in range(3000)]
    df = spark.createDataFrame(rows, "finding_id long, gcc_path string, upstream_project string, upstream_relpath string")
    got = finding_groups(df).collect()
    assert len(got) == 1000 and {r.group_id for r in got} == {0}


def test_all_files_share_one_stretch(spark):
    common = list(range(500, 545))
    rows = [(i, "p", [10_000 * i + k for k in range(i % 7)] + common + [-i - 1], list(range(46 + i % 7)), 0, "s") for i in range(1, 301)]
    got = spans(spark.createDataFrame(rows, FILES)).collect()
    assert {(r.file_id, r.first_pos, r.last_pos) for r in got} == {(i, i % 7, i % 7 + 44) for i in range(1, 301)}
    assert chained_runs(spark.createDataFrame(rows, FILES)).count() == 300  # linear in the files, not a row for each pair


def test_hot_seeds_are_dealt_over_tasks(spark, monkeypatch):
    from tracewright.llm import shared_spans as module

    common_ = list(range(500, 545))
    rows = [(i, "p", [10_000 * i + k for k in range(i % 7)] + common_ + [-i - 1], list(range(46 + i % 7)), 0, "s") for i in range(1, 60)]
    df = spark.createDataFrame(rows, FILES)
    want = {tuple(r) for r in spans(df).collect()}
    monkeypatch.setattr(module, "HOT", 0.05)
    assert {tuple(r) for r in spans(df).collect()} == want and len(want) == 59


def test_null_entries_are_like_no_other(spark):
    h = list(range(100, 120)) + [None] + list(range(120, 140))
    rows = [(1, "p", h, list(range(41)), 0, "s"), (2, "p", h, list(range(41)), 0, "s"), (3, "p", [None] * 40 + list(range(30)), list(range(70)), 0, "s"), (4, "p", [None] * 40 + list(range(30)), list(range(70)), 0, "s")]
    assert {(r.file_id, r.first_pos, r.last_pos) for r in spans(spark.createDataFrame(rows, FILES)).collect()} == {(3, 40, 69), (4, 40, 69)}


def test_common_equals_the_longest_common_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(50):
        x, y = rng.integers(0, 6, int(rng.integers(0, 40))), rng.integers(0, 6, int(rng.integers(0, 40)))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        assert common(x, y) == table[-1, -1]


def test_chaining_is_near_linear():
    import time

    def crossing(n):
        x0 = np.arange(n) * 40
        return x0, x0 + 9, x0[::-1].copy(), x0[::-1] + 9, np.full(n, 40.0)

    took = []
    for n in (1000, 8000):
        began = time.process_time()
        assert len(set(chain(*crossing(n), 0.1).tolist())) == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)  # eight times the runs; quadratic would be 64


def test_every_pair_that_shares_a_stretch_has_its_passages(spark, monkeypatch):
    from tracewright.llm import shared_spans as module

    monkeypatch.setattr(module, "TILE", 2)
    common, more = list(range(500, 545)), list(range(900, 940))
    # File 1 has the smallest id and all that 2, 3 and 4 share; 3 and 5 have equal lists; 6 has a stretch twice.
    lists = {1: common + [1] + more, 2: [2] * 3 + common + [20, 21] + more, 3: common + [30] + more, 4: [4] + more, 5: common + [30] + more, 6: more + [60, 61] + more, 7: list(range(50))}
    rows = [(i, "p", h, [10 * k for k in range(len(h))], 0, "s") for i, h in lists.items()]
    rows += [rows[0], (8, "p", common, [1], 0, "s"), (None, "p", common, list(range(45)), 0, "s"), (9, "p", None, None, 0, "s")]
    df = spark.createDataFrame(rows, FILES)
    got = module.pair_passages(df).collect()
    # 3 and 5 are one class, whose two files share all with each other.
    assert {(r.file_id, r.partner) for r in got} == {(a, b) for a in (1, 2, 3, 4, 6) for b in (1, 2, 3, 4, 6) if a != b} | {(3, 3)}
    of = lambda a, b: sorted((r.first_pos, r.last_pos, r.partner_first, r.partner_last, r.runs, r.exact_entries, r.matched_entries) for r in got if (r.file_id, r.partner) == (a, b))
    assert of(2, 3) == [(30, 890, 0, 85, 2, 85, 85)] and of(3, 2) == [(0, 850, 3, 89, 2, 85, 85)]
    assert of(3, 3) == [(0, 850, 0, 85, 1, 86, 86)]
    assert of(4, 6) == [(10, 400, 0, 39, 1, 40, 40), (10, 400, 42, 81, 1, 40, 40)]
    assert all(0 < r.similarity <= 1 for r in got) and module.pair_passages(df.limit(0)).count() == 0
    assert {(r["file_id"], r["class"], r.copies) for r in module.list_classes(df).collect()} >= {(3, 3, 2), (5, 3, 2), (1, 1, 1)}


def test_what_lies_between_runs_is_aligned(spark):
    from tracewright.llm.shared_spans import pair_passages

    one = list(range(100, 140)) + [1, 2, 3, 4, 5] + list(range(200, 240))
    two = list(range(100, 140)) + [1, 9, 3, 5] + list(range(200, 240))
    rows = [(1, "p", one, list(range(85)), 0, "s"), (2, "p", two, list(range(84)), 0, "s")]
    got = {r.file_id: r for r in pair_passages(spark.createDataFrame(rows, FILES)).collect()}
    assert (got[1].runs, got[1].exact_entries, got[1].matched_entries, got[1].similarity) == (2, 82, 83, round(83 / 85, 6))
    assert got[2].matched_entries == 83
