"""Nested records, series, scoring, upserts, readers, reports and the stream."""

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.operators.nested import Malformed, backport_rows, child_rows, child_tables, match_rows, parse, triples, typed_triples
from tracewright.operators.reports import json_lines, markdown_issue, markdown_row, ranked_text
from tracewright.operators.scoring import classify_pair, classify_source, directionality, severity_of_score
from tracewright.operators.series import backlog, first_resolution
from tracewright.operators.upsert import changes, upserted, write_index
from tracewright.sources import files as sources
from tracewright.streaming.index import daily_arrivals, follow

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=4), v, max_size=3), max_leaves=12)


def leaves(v, path=()):
    if isinstance(v, dict) and v:
        for k, (name, x) in enumerate(v.items()):
            yield from leaves(x, (*path, name))
    elif isinstance(v, list) and v:
        for k, x in enumerate(v):
            yield from leaves(x, (*path, k + 1))
    else:
        yield path, v


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUES, max_size=3) | st.dictionaries(st.text(max_size=4), VALUES, max_size=3), st.sampled_from([None, 2]))
def test_parse_yields_every_leaf(value, indent):
    got = [(tuple(s[1] if s[2] else s[0] for s in steps), text, kind) for steps, text, kind in parse(json.dumps(value, indent=indent), split_dots=False) if kind not in ("object", "array") or True]
    got = [(p, t, k) for p, t, k in got]
    want = []
    for path, v in leaves(value):
        kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array"
        want.append((path, v.encode("utf-8", "replace").decode() if isinstance(v, str) else json.dumps(v) if kind in ("number", "boolean") else None, kind))
    assert got == want


@pytest.mark.parametrize("text", ["", "{", '{"a":1', '{"a":1}}', '{"a":}', "{'a':1}", '{"a":01}', '{"a":NaN}', '{"a":1,}', "[1 2]", '{"a" 1}', '"\n"', '{"a":"\\x"}', "nul", '["a":1]', "[,]", '{"k":tru}'])
def test_parse_refuses_what_is_no_json(text):
    with pytest.raises(Malformed):
        list(parse(text))
    with pytest.raises(ValueError):
        json.loads(text, parse_constant=lambda _: int("x"))


def test_deep_nesting_needs_no_recursion():
    assert len(list(parse("[" * 20_000 + "1" + "]" * 20_000))[0][0]) == 20_000


STATUS = "status_id long, backports string, branch string, record_id int"


def test_backports_in_all_shapes(spark):
    note = {"text": "one", "by": "x", "replies": ["two", {"by": "y", "text": "three", "replies": ["four"]}]}
    rows = [
        (1, json.dumps({"gcc-13": {"notes": [note, "five", "", " "], "branch_commit": {"sha": "abc", "url": "u"}}, "gcc-14": {"notes": None}})),
        (2, json.dumps([{"branch": "gcc-13", "notes": "n", "branch_commit": "c1"}, {"branch": "gcc-15", "notes": {}}])),
        (3, json.dumps({"gcc-13.notes": {"1": "a", "2": {"text": "b"}, "10": "c"}, "gcc-13.branch_commit": None, "gcc-14.apply_mode": "unknown"})),
        (4, json.dumps({"branches": {"closed": {"gcc-14": {"notes": "x", "branch_commit": ""}}, "open": [{"branch": "gcc-16", "notes": ["y"]}]}})),
        (5, json.dumps(json.dumps({"gcc-13": {"notes": {"10": "k", "2": "j"}, "branch_commit": "zz"}}, sort_keys=True))),
        (6, '{"gcc-13": {"notes": "cut'), (7, None), (8, "{}"), (9, "[]"), (10, ""), (1, None), (11, '{"gcc-13": {}}'), (None, '{"gcc-13": {"notes": "n"}}'),
    ]
    rows.append(rows[1])
    df = spark.createDataFrame([(*r, "b", 0) for r in rows], STATUS)
    got = {(r.record_id, r.branch, r.item_no, r.note, r.branch_commit) for r in backport_rows(df).collect()}
    assert got == {
        (1, "gcc-13", 1, "one", "abc"), (1, "gcc-13", 2, "two", "abc"), (1, "gcc-13", 3, "three", "abc"), (1, "gcc-13", 4, "four", "abc"), (1, "gcc-13", 5, "five", "abc"), (1, "gcc-14", 0, None, ""),
        (2, "gcc-13", 1, "n", "c1"), (2, "gcc-15", 0, None, ""), (3, "gcc-13", 1, "a", ""), (3, "gcc-13", 2, "b", ""), (3, "gcc-13", 3, "c", ""), (3, "gcc-14", 0, None, ""),
        (4, "gcc-14", 1, "x", ""), (4, "gcc-16", 1, "y", ""), (5, "gcc-13", 1, "j", "zz"), (5, "gcc-13", 2, "k", "zz"), (11, "gcc-13", 0, None, ""),
    }
    assert triples(df.limit(0), "status_id", "backports").count() == 0


def test_matches_keep_their_places(spark):
    m = "struct<project:string,relpath:string>"
    rows = [(1, [("p", "a"), None, ("q", None)]), (1, [("p", "a"), None, ("q", None)]), (2, None), (3, []), (4, [None]), (None, [("z", "z")])]
    df = spark.createDataFrame([(*r, 1, "v") for r in rows], f"finding_id long, matches array<{m}>, no int, value string")
    assert {tuple(r) for r in match_rows(df).collect()} == {(1, 1, "p", "a"), (1, 3, "q", None)}
    empty = spark.createDataFrame([], STATUS)
    assert child_rows(empty, df).columns == ["record_table", "record_id", "child_key", "item_no", "child_value"]


def test_versions_in_keys_are_no_members():
    assert [[x[0] for x in t[0]] for t in parse('{"gcc-4.9": {"notes": "x"}, "gcc-13.notes": "y", "gcc-4.9.notes": "z"}')] == [["gcc-4.9", "notes"], ["gcc-13", "notes"], ["gcc-4.9", "notes"]]


def test_child_tables_keep_every_member_and_parent(spark):
    text = '{"open": {"b": {"mode": "m", "n": {"x": 1}, "notes": [{"text": "t", "by": "u", "replies": ["r", {"text": "s"}]}, "v"], "gone": null}}, "top.deep": true}'
    df = spark.createDataFrame([(1, text, 1), (1, text, 1), (2, "{", 2)], "status_id long, backports string, row int")
    got = {(r.path, tuple(r.row)): r for r in child_tables(triples(df, "status_id", "backports"), ("open",), ("text",)).collect()}
    tables = sorted(k[0] for k in got)
    assert tables == ["*", "open.*", "open.*.notes.*", "open.*.notes.*", "open.*.notes.*.replies.*", "open.*.notes.*.replies.*"]
    members = {k[0]: {m.field: (m.value, m.kind) for m in r.members} for k, r in got.items() if k[0] in ("*", "open.*")}
    assert members == {"*": {"deep": ("true", "boolean")}, "open.*": {"mode": ("m", "string"), "n.x": ("1", "number"), "gone": (None, "null")}}
    rows = sorted((r.row, r.parent, r.plain or r.text) for r in got.values() if "notes" in r.path)
    assert rows == [([1, 1, 3, 1], [1, 1], "t"), ([1, 1, 3, 1, 3, 1], [1, 1, 3, 1], "r"), ([1, 1, 3, 1, 3, 2], [1, 1, 3, 1], "s"), ([1, 1, 3, 2], [1, 1], "v")]
    typed = spark.createDataFrame([(1, [("p", 2, None), None])], "finding_id long, matches array<struct<project:string,n:int,l:array<int>>>")
    row = child_tables(typed_triples(typed, "finding_id", "matches"), ("matches",), ("project",)).first()
    assert (row.path, row.row, row.project) == ("matches.*", [1, 1], "p") and [tuple(m) for m in row.members] == [("l", None, "null"), ("n", "2", "number"), ("project", "p", "string")]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from tracewright.session import _shared_folder

    conf = {}
    made = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None, set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(ValueError):
        _shared_folder(made)
    made.sparkContext.master = "local[2]"
    assert _shared_folder(made).startswith("file://") and "spark.checkpoint.dir" in conf


def test_stored_tables_are_dropped(spark):
    from pathlib import Path

    from tracewright.session import cut_lineage, drop_all_stored, drop_stored

    one, two = cut_lineage(spark.range(5)), cut_lineage(spark.range(3))
    path = lambda df: Path(df.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    first, second = path(one), path(two)
    drop_stored(one)
    assert not first.exists() and second.exists() and two.count() == 3
    drop_all_stored(spark)
    assert not second.exists()


def test_series(spark):
    day = lambda s: dt.datetime.fromisoformat(s + "T12:00:00+00:00")
    change = lambda f, a: [(f, a)]
    rows = [
        (1, [(day("2024-01-05"), change("resolution", "FIXED")), (day("2024-01-03"), change("status", "RESOLVED"))]),
        (2, [(day("2023-12-01"), change("resolution", "FIXED"))]),
        (3, [(day("2024-01-04"), change("resolution", " ")), (day("2024-01-06"), change("cc", "x"))]),
        (4, None), (5, []), (None, [(day("2024-01-04"), change("resolution", "X"))]),
    ]
    h = "array<struct<changed_at:timestamp,changes:array<struct<field_name:string,added:string>>>>"
    got = {r.bug_id: str(r.resolved) for r in first_resolution(spark.createDataFrame(rows, f"bug_id long, history {h}"), "2024-01-01").collect()}
    assert got == {1: "2024-01-03"}
    d = dt.date
    bugs = [("a", d(2024, 1, 1), d(2024, 1, 2), False), ("a", d(2024, 1, 3), None, True), ("a", d(2023, 1, 1), None, True), ("b", d(2025, 1, 1), None, True)]
    rows = backlog(spark.createDataFrame(bugs, "category string, created date, resolved date, is_open boolean"), "2024-01-01", "2024-01-03").orderBy("category", "day").collect()
    assert [(r.category, r.created, r.resolved, r.open_bugs) for r in rows] == [("a", 1, 0, 2), ("a", 0, 1, 1), ("a", 1, 0, 2), ("b", 0, 0, 1), ("b", 0, 0, 1), ("b", 0, 0, 1)]


def test_scoring(spark):
    rows = [(True, None, None, None, None), (True, 0.3, 0.25, 0.01, 10), (True, 0.1, 0.1, 0.01, 0), (False, 0.9, 0.1, 0.5, 4), (False, 0.61, 0.0, 0.5, 0), (False, 0.1, 0.1, 0.5, 0), (True, 0.6, 0.45, 0.5, 8), (True, 0.1, 0.46, 0.5, 0), (True, 0.1, 0.31, 0.5, 0), (True, 0.1, 0.1, 0.5, 0)]
    df = spark.createDataFrame(rows, "silent boolean, d double, s double, l double, run int")
    got = [tuple(r) for r in df.select(*classify_source(*(F.col(c) for c in df.columns))).collect()]
    assert got == [("low", 0.0), ("medium", 28.5), ("low", 4.8), ("review", 97.0), ("review", 48.8), ("low", 8.0), ("critical", 139.0), ("high", 57.6), ("medium", 28.6), ("low", 16.0)]
    p = spark.createDataFrame([(0.8, 0.7, True), (0.6, 0.45, False), (0.6, 0.45, True), (0.1, 0.9, True), (0.1, 0.1, False)], "d double, s double, first boolean")
    assert [r[0] for r in p.select(classify_pair(F.col("d"), F.col("s"), F.col("first"))).collect()] == ["high", "medium", "high", "medium", "low"]
    dates = spark.createDataFrame([("2020-01-01", "2021-01-01"), ("2021-01-01", "2020-01-01"), ("2020-01-01", "2020-01-01"), ("", "2020-01-01"), (None, None)], "a string, b string")
    assert [r[0] for r in dates.select(directionality(F.col("a"), F.col("b"))).collect()] == ["gcc_first", "upstream_first", "contemporaneous", "unknown", "unknown"]
    s = spark.createDataFrame([(100.0,), (70.0,), (40.0,), (39.9,)], "s double")
    assert [r[0] for r in s.select(severity_of_score(F.col("s"))).collect()] == ["critical", "high", "medium", "low"]


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")], "project string, relpath string, sha256 string")
    new = spark.createDataFrame([("p", "a", "1"), ("p", "b", "9"), ("q", "a", "4")], old.schema)
    assert {tuple(r) for r in changes(old, new).collect()} == {("p", "a", "keep"), ("p", "b", "update"), ("q", "a", "insert")}
    assert {tuple(r) for r in upserted(old, new).collect()} == {("p", "a", "1"), ("p", "b", "9"), ("q", "a", "4"), ("p", "c", "3")}
    write_index(upserted(old, new), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 4


def test_readers(spark, tmp_path):
    tree = tmp_path / "corpus"
    for name, data in {"p/a.c": b"x" * 300, "p/.git/b": b"x" * 300, "q/d/e.h": b"y" * 10, "q/d/f.h": b"y" * 400}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(data)
    assert {(r.project, r.relpath, r.size) for r in sources.source_tree(spark, str(tree)).collect()} == {("p", "a.c", 300), ("q", "d/f.h", 400)}
    toml = tmp_path / "m.toml"
    toml.write_text('[[entry]]\npath = "a"\nreviewed = true\n[[entry]]\nkind = "x"\n[[tree]]\npath_prefix = "b/"\nurl_prefix = "u"\n')
    assert [(r.path, r.reviewed) for r in sources.review_manifest(spark, str(toml)).collect()] == [("a", True)]
    assert sources.corpus_map(spark, str(toml)).count() == 2 and sources.review_manifest(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "r.json").write_text(json.dumps({"scanned": 2, "kept": 1, "findings": [{"path": "a", "severity": "low", "matches": [{"project": "p"}]}]}))
    assert [(r.path, r.matches[0].project) for r in sources.scan_report(spark, str(tmp_path / "r.json")).collect()] == [("a", "p")]
    (tmp_path / "pr" / "77").mkdir(parents=True)
    (tmp_path / "pr" / "77" / "status.json").write_text(json.dumps({"pr": 77, "title": "t", "backports": {"gcc-13": {"reproduces": True}}, "more": 1}))
    row = sources.status_files(spark, str(tmp_path / "pr/*/status.json")).first()
    assert row.folder == 77 and row.backports["gcc-13"].reproduces is True
    (tmp_path / "b.json").write_text(json.dumps({"bugs": [{"id": 5, "component": "c"}, {"component": "d"}]}))
    assert [r.id for r in sources.bug_search(spark, str(tmp_path / "b.json")).collect()] == [5]
    (tmp_path / "c.txt").write_text("# note\nABCDEF12 subject\nxyz\nabcdef12\n1234567\n")
    assert {r.sha for r in sources.commit_list(spark, str(tmp_path / "c.txt")).collect()} == {"abcdef12", "1234567"}
    (tmp_path / "t.txt").write_text('a/b.c\n"q r.c"\na/b.c\n\n')
    assert {r.path for r in sources.tracked_files(spark, str(tmp_path / "t.txt")).collect()} == {"a/b.c", "q r.c"}
    (tmp_path / "s.toml").write_text('[[include]]\npath_prefix = "lib/"\n[[exclude]]\npath = "lib/x"\nreason = "r"\n[[exclude]]\npath = "lib/y.c"\n[[entry]]\npath = "lib/z.c"\n')
    include, exclude = sources.scope(spark, str(tmp_path / "s.toml"))
    files = spark.createDataFrame([("lib/a.c",), ("lib/x/b.c",), ("lib/y.c",), ("libz/a.c",), ("c.c",), (None,)], "path string")
    assert [r.path for r in sources.in_scope(files, include, exclude).collect()] == ["lib/a.c"]
    assert [r.path for r in sources.reviewed_paths(spark, str(tmp_path / "s.toml")).collect()] == ["lib/z.c"]
    (tmp_path / "m.txt").write_text("\u001f".join("abcdef") + "\nshort\n")
    assert sources.commit_metadata(spark, str(tmp_path / "m.txt")).first().subject == "e"
    (tmp_path / "n.txt").write_text("M\ta.c\nR100\told\tnew\nx\n")
    assert {tuple(r) for r in sources.name_status(spark, str(tmp_path / "n.txt")).collect()} == {("M", "a.c"), ("R", "new")}
    lines = spark.createDataFrame([("PASS: a",), ("FAIL: b c",), ("XPASS: d",), ("# FAIL: e",)], "value string")
    assert {tuple(r) for r in sources.test_summary(lines).collect()} == {("FAIL", "b c"), ("XPASS", "d")}
    diff = "From x\ndiff --git a/x.c b/x.c\n--- a/x.c\n+++ b/x.c\n+new\n-old\n same\ndiff --git a/t/testsuite/y.c b/t/testsuite/y.c\n+one\n"
    got = {tuple(r) for r in sources.patch_files(spark.createDataFrame([(1, diff), (2, None)], "patch int, text string")).collect()}
    assert got == {(1, "x.c", 1, 1, False), (1, "t/testsuite/y.c", 1, 0, True)}


def test_reports(spark):
    df = spark.createDataFrame([(1, "a|b", None), (2, "c", "x")], "n int, t string, u string")
    assert [json.loads(r.value) for r in json_lines(df).collect()] == [{"n": 1, "t": "a|b", "u": None}, {"n": 2, "t": "c", "u": "x"}]
    assert [r.line for r in ranked_text(df, [F.col("n").desc()], F.col("t"), 1).collect()] == ["  1. c"]
    assert df.select(markdown_row(F.col("n"), F.col("t"), F.col("u"))).first()[0] == "| 1 | a\\|b |  |"
    assert df.select(markdown_issue(F.col("t"), {"u": F.col("u"), "n": F.col("n")}, F.lit("end"))).first()[0] == "# a|b\n\n- **n**: 1\n\nend"


def test_stream_of_scans(spark, tmp_path):
    folder, index, state = (str(tmp_path / x) for x in ("in", "index", "state"))
    schema = "project string, relpath string, bytes binary, size bigint"
    spark.createDataFrame([("p", "a", b"1", 1), ("p", "b", b"2", 1), ("p", None, b"2", 1)], schema).coalesce(1).write.parquet(folder)
    follow(spark, folder, index, state).awaitTermination()
    spark.createDataFrame([("p", "a", b"9", 1), ("q", "a", b"3", 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    follow(spark, folder, index, state).awaitTermination()
    rows = spark.read.parquet(f"{index}/v=1").collect()
    assert {(r.project, r.relpath) for r in rows} == {("p", "a"), ("p", "b"), ("q", "a")} and len(rows) == 3
    days = daily_arrivals(spark.readStream.schema("at timestamp, kind string").parquet(folder), "at", "kind")
    assert days.isStreaming and days.columns == ["day", "kind", "records"]


def test_scan_finds_the_copy_in_another_project(spark):
    from tracewright.plans.pipelines import scan_sources

    body = "\n".join(f"int f{i} (int a, long b{i}) {{ return a * {i} + g{i} (b{i}); }}" for i in range(30))
    other = "\n".join(f"long h{i} = k{i} [{i}] - m (x{i}, {i * 7});" for i in range(30))
    rows = [(1, "p", body), (2, "q", "/* SPDX-License-Identifier: X */\n" + body), (3, "q", other), (4, "p", body + "\nint z;"), (5, "r", ""), (6, "r", "x")]
    files = spark.createDataFrame(rows, "file_id long, project string, text string")
    got = {r.query_id: r for r in scan_sources(files, files.select("file_id")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert (got[1].match_id, got[1].severity, got[1].density) == (2, "critical", 1.0)
    assert (got[2].match_id, got[2].severity, got[2].matches) == (1, "review", 2)
    assert got[3].match_id is None and got[5].severity == "low" and got[6].score == 0.0
