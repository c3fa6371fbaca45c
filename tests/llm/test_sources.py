"""Lexing, licences and files not written by hand."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm.handwritten import KEYWORDS, not_handwritten, origins
from tracewright.llm.lexing import bands, minhash, tokenize, windows
from tracewright.llm.licenses import Reader, licenses, reader, verdict
from tracewright.llm.near_duplicates import fold, near_duplicates, odd_sketch, similar_files, similar_groups
from tracewright.llm.source_text import comment_text, opening_comment

TOKEN = re.compile(r"[A-Za-z_][A-Za-z_0-9]*|[0-9]+|==|!=|<=|>=|->|::|&&|\|\||[-+*/%<>&|^~!?=(){}\[\],.;:]")
FILES = "file_id long, project string, relpath string, bytes binary, size long, key string, n int"


def lexed(texts):
    tokens, buf, _ = tokenize(texts)
    data, borders = buf.tobytes(), tokens.split(len(texts))
    return [[data[s : s + l].decode() for s, l in zip(tokens.start[a:b], tokens.length[a:b])] for a, b in zip(borders, borders[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab_Z09=!<>-:&|+ \n\"é.;", max_size=40), min_size=1, max_size=5))
def test_tokens_equal_the_pattern(texts):
    raw = [t.encode() for t in texts]
    assert lexed(raw) == [TOKEN.findall(t) for t in texts]


def test_equal_tokens_hash_alike_in_any_place():
    tokens, _, _ = tokenize([b"alpha beta alpha", b"  beta"])
    assert tokens.hash[0] == tokens.hash[2] and tokens.hash[1] == tokens.hash[3] != tokens.hash[0]


def test_windows_of_short_lists():
    assert len(windows(np.zeros(0, np.uint64), 5)) == 0
    assert len(windows(np.arange(3, dtype=np.uint64), 5)) == 1
    assert len(windows(np.arange(9, dtype=np.uint64), 5)) == 5


def test_minhash_estimates_jaccard():
    a, b = np.arange(1000, dtype=np.uint64) * 977, np.arange(250, 1250, dtype=np.uint64) * 977
    assert abs((minhash(a, 512) == minhash(b, 512)).mean() - 0.6) < 0.08
    assert len(bands(minhash(a, 12), 3)) == 4


def test_odd_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for size in (0, 3, 90, 700):
        common = rng.integers(0, 1 << 62, size).astype(np.uint64)
        a = np.concatenate([common, rng.integers(0, 1 << 62, 40).astype(np.uint64)])
        b = np.concatenate([common, rng.integers(0, 1 << 62, 25).astype(np.uint64)])
        x, y = odd_sketch(a), odd_sketch(b)
        w = min(len(x), len(y))
        assert np.bitwise_count(fold(x, w) ^ fold(y, w)).sum() <= 65


def test_opening_comment():
    assert opening_comment(b"\xef\xbb\xbf\n/* a */ int x;", "c") == (b"/* a */", 11)
    assert opening_comment(b"/* never closed", "c")[0] == b""
    assert opening_comment(b"#!/bin/x\n# one\n# two\nimport y\n", "py")[0] == b"# one\n# two\n"
    assert opening_comment(b"#include <a>\n", "c")[0] == b""
    assert opening_comment(b"! a\r\n! b\r\nmodule\r\n", "f90")[0].count(b"!") == 2
    assert opening_comment(b"", "c") == (b"", 0)
    assert comment_text(b"/* x\n * y\n */").split() == ["x", "y"]


REFS = [
    ("MIT", "The MIT License", "Anyone who obtains this program from the owner may deal in it freely if this line stays", "Whoever receives this software may run copy alter and sell it"),
    ("GPL-2.0-only", "GNU General Public License, version 2 only", "Distribution is under the second edition alone and a written offer stays valid", "Copies may be spread when the source goes along and nothing else is asked for"),
    ("Apache-2.0", "Apache License, Version 2.0", "", ""),
    ("Zlib", "zlib License", None, None),
]


def said(text, license_file=False):
    rows = [(a, b, c or "", d or "") for a, b, c, d in REFS]
    return sorted(sorted(x) for x in Reader(rows).statements(text, license_file))


def test_statements():
    assert said("SPDX-License-Identifier: (MIT OR gpl-2)") == [["GPL-2.0-only", "MIT"]]
    assert said("SPDX-License-Identifier: MIT AND Zlib") == [["MIT"], ["Zlib"]]
    assert said("License: GPLv2+") == []  # an edition that isn't listed
    assert said("Licensed to you by its authors under the GNU GPL, second version\nand no other.") == [["GPL-2.0-only"]]
    assert said("You may take this file under the zlib licence or under the MIT licence, whichever you prefer.") == [["MIT", "Zlib"]]
    assert said("Not to be confused with the MIT licence tool.") == []
    assert said("An early draft talked about moving to the zlib licence; this grants nothing.") == []
    assert said("ANYONE WHO OBTAINS THIS PROGRAM FROM ACME MAY DEAL IN IT FREELY IF THIS LINE STAYS") == [["MIT"]]
    assert said("Terms of use: see COPYING above.") == []
    assert said("This tree may be used under either of two licences, at your choice:\n * The MIT License\n * zlib License", True) == [["MIT", "Zlib"]]
    assert said("Apache License, Version 2.0\n\nCopyright 2001 X", True) == [["Apache-2.0"]]
    assert verdict([["MIT", "Zlib"], ["MIT"]]) == "MIT" and verdict([["MIT"], ["Zlib"]]) == "conflict" and verdict([]) == "unknown"


def test_a_new_licence_needs_no_code():
    """A row that was never thought of is known by notice, body, id and title, in usual spellings."""
    row = ("QPL-4.2-or-later", "Quokka Public License, version 4.2 or later", "Marsupials may hop over this file whenever the moon is full and its keeper has been asked", "Every hop over the work is counted by its keeper and no hop may be sold without the moon")
    refs = Reader([*((a, b, c or "", d or "") for a, b, c, d in REFS), row])
    said_ = lambda text, f=False: sorted(sorted(x) for x in refs.statements(text, f))
    for text in (
        "SPDX-License-Identifier: qpl-4.2+", "Terms: QPLv4.2+", "This file is distributed under the Quokka Public Licence, 4.2 or any later version.", "Released under the quokka licence.",
        "MARSUPIALS MAY HOP OVER THIS FILE WHENEVER THE MOON IS FULL AND ITS KEEPER HAS BEEN ASKED", "SPDX-License-Identifier: QPL-4.2-or-later OR GPL-2.0-or-later",
    ):
        assert said_(text) == [["QPL-4.2-or-later"]], text
    assert said_("Quokka Public License, version 4.2 or later", True) == [["QPL-4.2-or-later"]] and said_(row[3], True) == [["QPL-4.2-or-later"]]
    for text in ("License: QPL-4.2-only", "License: QPL-3.0", "License: MIT-0", "License: GPL-2.0-or-later", "License: GPL-3.0"):
        assert said_(text) == [], text


def test_names_of_a_choice_far_from_its_lead():
    lead = "This tree may be used under either of the licences which stand here " + "and nowhere else in this long and winding paragraph " * 12
    assert said(lead + ":\n * The MIT License\n * zlib License", True) == [["MIT", "Zlib"]]


def test_licenses_of_files_and_projects(spark):
    rows = [
        (1, "p", "a/b/x.c", b"/* SPDX-License-Identifier: MIT OR Zlib */", 1, "k", 1),
        (1, "p", "a/b/x.c", b"/* SPDX-License-Identifier: MIT OR Zlib */", 1, "k", 1),
        (2, "p", "a/LICENSE", b"The MIT License\n", 1, None, None),
        (3, "p", "a/b/COPYING", b"Ask the owners.\n", 1, None, None),
        (4, "p", "LICENSE", b"zlib License\n", 1, None, None),
        (5, "p", "y.c", None, None, None, None),
        (6, "p", "a/z.py", b"# License: zlib\n", 1, None, None),
        (7, None, "q.c", b"x", 1, None, None),
        (8, "p", None, b"x", 1, None, None),
        (9, "q", "only.js", b"x" * 300_000, 1, None, None),
    ]
    files = spark.createDataFrame(rows, FILES)
    sources = spark.createDataFrame([("p", "u"), ("p", "u"), ("q", "u"), (None, "u")], "project string, url string")
    refs = spark.createDataFrame([(*r, "f") for r in REFS], "license_id string, title string, notice string, body string, family string")
    got = {(r.project, r.relpath): r.license for r in licenses(files, sources, refs).collect()}
    assert got == {("p", "a/b/x.c"): "MIT", ("p", "y.c"): "Zlib", ("p", "a/z.py"): "conflict", ("p", ""): "Zlib", ("q", "only.js"): "unknown", ("q", ""): "unknown"}
    assert licenses(files.limit(0), sources.limit(0), refs.limit(0)).count() == 0
    assert reader(refs.limit(0)).statements("MIT", False) == frozenset()


def code(seed, lines=60):
    rng = np.random.default_rng(seed)
    name = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    forms = ("  {0} = {1} + {2} * 3;", "  if ({0} > {1}) return {2};", "  {0} ({1}, {2} - 4);", "  while ({0} < 9) {1} += {2}[{0}++];", "  {0}->{1} = {2} ? 5 : 7;", "  assert ({0} <= {1} || {2} == 1);", "  switch ({0}) {{ case 2: {1} = {2}; break; default: stop (); }}", "  for ({0} = 0; {0} < {1}; {0} += 2) {2}[{0}] = 1;")
    return "".join(forms[rng.integers(len(forms))].format(name(), name(), name()) + "\n" for _ in range(lines))


def test_not_handwritten(spark):
    own = code(1)
    table = "static const int t[] = {\n" + ",\n".join(str(x) for x in range(1000, 1400)) + "};\n"
    stubs = "".join(f"int wrap_fn_{c} (ctx_t *c) {{ return call_it (c, {c}77, other_{c}); }}\n" for c in range(60))
    small = "(function(a,b){" + "".join(f"while(a<{k})b+=c[a++];d.e=f?{k}:1;" for k in range(200)) + "})();"
    rows = [
        (1, "home", "lib/a.c", b"/* This file is part of home. */\n" + own.encode()),
        (2, "other", "vendor/home/a.c", b"/* x */\n" + own.replace("\n", "\r\n").encode()),
        (3, "other", "src/b.c", code(2).encode()),
        (4, "home", "lib/a_v2.c", (own + code(3, 3)).encode()),
        (5, "home", "gen/w.c", stubs.encode()),
        (6, "home", "lib/t.c", table.encode()),
        (7, "home", "lib/m.js", small.encode()),
        (8, "home", "LICENSE", b"words"),
        (9, None, None, None),
        (10, "home", "lib/empty.c", b""),
        (11, "third", "util/a.c", b"// Imported from home, revision 1.\n" + own.encode()),
        (5, "home", "gen/w.c", stubs.encode()),
    ]
    files = spark.createDataFrame([(*r, 0, "k", 1) for r in rows], FILES)
    got = {r.file_id: r.kind for r in not_handwritten(files).collect()}
    assert got == {2: "copy", 5: "generated", 6: "blob", 7: "minified", 11: "copy"}
    assert not_handwritten(files.limit(0)).count() == 0


def test_origins():
    assert origins("a/third_party/zed/x.c", "") == ["zed"]
    assert origins("a.c", "Copyright 2001 the Foo-bar authors\nThis file is part of baz.") == ["baz", "foo-bar"]
    assert len(set(KEYWORDS)) == len(KEYWORDS)


def test_similar_files_equal_brute_force(spark):
    base = [code(s, 40) for s in range(6)]
    texts = {}
    for k, t in enumerate(base):
        lines = t.split("\n")
        for v in range(5):
            texts[len(texts) + 1] = "\n".join(lines[v * 2 :] + code(100 + k * 7 + v, v * 2).split("\n"))
    texts[90], texts[91], texts[92], texts[93] = base[0], base[0], "", "one two"
    texts[94] = "two three four"
    rows = [(i, "p", f"f{i}.c", t.encode(), 0, "k", 1) for i, t in texts.items()] + [(1, "p", "f1.c", texts[1].encode(), 0, "k", 1), (99, "p", "x", None, 0, "k", 1)]
    files = spark.createDataFrame(rows, FILES)
    index = files.where("file_id <> 2").select("file_id", "size")
    sets = {i: ({tuple(k[j : j + 5]) for j in range(len(k) - 4)} if len(k) > 4 else ({tuple(k)} if k else set())) for i, k in ((i, TOKEN.findall(t)) for i, t in texts.items() if i != 2)}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = [tuple(r) for r in similar_files(index, files).select("file_id_a", "file_id_b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    links, members = near_duplicates(index, files)
    assert members.where("file_id = 91").first()["class"] == 90 or members.where("file_id = 91").first()["class"] == members.where("file_id = 90").first()["class"]
    groups = {r.file_id: r.group_id for r in similar_groups(index, files).collect()}
    parent = {i: i for i, s in sets.items() if s}
    for _ in parent:
        for a, b in want:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert groups == parent
    assert similar_files(index.limit(0), files).count() == 0


def test_blocks_and_bands_find_the_same_pairs(spark, monkeypatch):
    from tracewright.llm import near_duplicates as nd

    base = code(5, 50).split("\n")
    rows = [(i, "p", f"{i}.c", "\n".join(base[i % 9 :] + code(40 + i, 4).split("\n")).encode(), 0, "k", 1) for i in range(1, 25)]
    files = spark.createDataFrame(rows, FILES)
    whole = {tuple(r) for r in nd.similar_files(files, files).collect()}
    sk = nd.sketches(files, banded=True).cache()
    exact, banded = ({tuple(r) for r in nd.candidate_pairs(sk, 0.6, b).collect()} for b in (False, True))
    assert whole <= banded <= exact
    monkeypatch.setattr(nd, "BLOCK", 4)
    assert exact == {tuple(r) for r in nd.candidate_pairs(sk, 0.6).collect()}
    assert whole == {tuple(r) for r in nd.similar_files(files, files).collect()} and len(whole) > 50


def test_tile_pairs_far_apart_are_skipped_and_no_pair_is_lost():
    from tracewright.llm.near_duplicates import compare

    rng = np.random.default_rng(4)
    sets = []
    for size in [*rng.integers(3, 3000, 500), *[400] * 300]:
        s = rng.integers(0, 1 << 62, size).astype(np.uint64)
        sets += [s, np.concatenate([s[: int(size * rng.uniform(0.6, 1))], rng.integers(0, 1 << 62, 2).astype(np.uint64)])]
    sizes, bits = np.array([len(s) for s in sets]), [odd_sketch(s).tobytes() for s in sets]
    near = {(k, k + 1) for k in range(0, len(sets), 2) if len(np.intersect1d(sets[k], sets[k + 1])) >= 0.6 * len(np.union1d(sets[k], sets[k + 1]))}
    i, j, tiles, skipped = compare(sizes, bits, sizes, bits, 0.6, own=True)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert len(got) == len(i) and near <= got and len(near) > 700 and all(a != b for a, b in got)
    assert skipped > tiles / 2  # by their ranges alone
    i, j, _, _ = compare(sizes[:900], bits[:900], sizes[900:], bits[900:], 0.6)
    assert {(a, b + 900) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in got if a < 900 <= b}


def test_copies_between_the_ends_of_a_band_meet_their_home(spark, monkeypatch):
    from tracewright.llm import handwritten as module

    monkeypatch.setattr(module, "TILE", 2)
    own, edited = code(21), code(22, 120)
    changed = lambda k: edited.replace("\n", f"\n  unlike_{k} ();\n", 1 + k)
    rows = [(1, "mmm", "a.c", "/* This file is part of mmm. */\n" + own), (5, "mmm", "b.c", "/* This file is part of mmm. */\n" + edited)]
    rows += [(k, p, "x/a.c", own) for k, p in ((2, "aaa"), (3, "nnn"), (4, "zzz"))]
    rows += [(k, p, "x/b.c", changed(k)) for k, p in ((6, "aaa"), (7, "nnn"), (8, "zzz"), (9, "mmm"))]
    # Where none names a home, equal bodies are copies of the largest project's; with a foreign one, that one is.
    rows += [(k, p, "x/c.c", code(23)) for k, p in ((10, "aaa"), (11, "nnn"), (12, "zzz"))]
    rows += [(13, "aaa", "x/d.c", code(24)), (14, "ppp", "vendor/mmm/d.c", code(24)), (15, "zzz", "x/d.c", code(24)), (16, "ppp", "vendor/mmm/e.c", code(25))]
    files = spark.createDataFrame([(i, p, path, text.encode(), 0, "k", 1) for i, p, path, text in rows], FILES)
    assert {r.file_id: r.kind for r in not_handwritten(files).collect()} == dict.fromkeys((2, 3, 4, 6, 7, 8, 11, 12, 14), "copy")


def test_a_short_member_belongs_to_its_generated_family(spark):
    record = lambda c: f"int wrapped_function_{c} (context_type *context) {{ return delegate_call (context, {c}77, another_symbol_{c}); }}\n"
    texts = {k: "".join(record(100 * k + c) for c in range(60)) for k in (1, 2)} | {3: record(301) + record(302), 4: code(31)}
    files = spark.createDataFrame([(k, "p", f"gen/w{k}.c", t.encode(), 0, "k", 1) for k, t in texts.items()], FILES)
    assert {r.file_id: r.kind for r in not_handwritten(files).collect()} == dict.fromkeys((1, 2, 3), "generated")


def skeleton(seed, pattern=99, lines=40):
    """One text for all seeds but for its names."""
    rng, names = np.random.default_rng(pattern), np.random.default_rng(seed)
    shape = ["int {0} = {1} ({2}, {3});", "if ({0} < {1}) return {2};", "for ({0} = {1}; {0} < {2}; {0}++) {3} ({0});", "{0}->{1} = {2} * {3} - {0};", "while ({0}) {{ {1} ({2} [{3}]); {0}--; }}", "{0} ({1}, {2}) ; {3} &= {0};", "case {0}: {1} = {2}; break;", "{0}.{1} ({2} + {3});"]
    return "\n".join(shape[k].format(*(f"name_{names.integers(0, 1 << 40)}" for _ in range(4))) for k in rng.integers(0, len(shape), lines))


def test_families_decide_where_measures_do_not(spark):
    rows = [(k, "p", f"out/s{k}.c", skeleton(k)) for k in (1, 2, 3)]  # one skeleton, three times in one repository
    rows += [(k, f"q{k}", "s.c", skeleton(k, 5)) for k in (11, 12)]  # only twice, in two
    variant = skeleton(5, 17)
    rows += [(k, "r", f"v{k}.c", variant + f"\nint more_{k};") for k in (21, 22, 23, 24)]  # one text with its names, many times
    table = lambda part: spark.createDataFrame([(i, p, path, t.encode(), 0, "k", 1) for i, p, path, t in part], FILES)
    assert {r.file_id: r.kind for r in not_handwritten(table(rows)).collect()} == dict.fromkeys((1, 2, 3), "generated")
    assert not_handwritten(table(rows[:1])).count() == 0  # the same file alone


def test_families_equal_brute_force(spark):
    """Recall of the bands over all pairs of the files of a small table: members of a family that are found."""
    from tracewright.llm.handwritten import FAMILY, UNLIKE, families, file_traits

    df = spark.read.parquet("/root/testdata/sf0.01/corpus_files.parquet")
    traits = file_traits(df).cache()
    found = {r.file_id for r in families(traits).select("file_id").distinct().collect()}
    rows = [(r.file_id, np.array(r.masked, np.int64), [x >> k & 15 for x in r.plain_signature for k in range(0, 64, 4)]) for r in traits.collect() if r.masked]
    want = set()
    for k, (i, a, x) in enumerate(rows):
        for j, b, y in rows[k + 1 :]:
            if min(len(a), len(b)) >= FAMILY * max(len(a), len(b)) and 1 - sum(p != q for p, q in zip(x, y)) * 16 / 15 / len(x) < UNLIKE:
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common >= FAMILY * (len(a) + len(b) - common):
                    want |= {i, j}
    assert len(want) > 30 and len(found & want) >= 0.97 * len(want) and found <= want


def test_members_of_a_family_meet_though_the_first_file_is_a_variant_of_each(spark):
    lines = [skeleton(k, 61).split("\n") for k in (1, 2, 3, 4)]
    one, two, three, four = lines
    texts = {1: one, 2: one[:24] + two[24:], 3: three[:16] + one[16:], 4: four}  # 2 and 3 have most names of 1, hardly any of each other
    files = spark.createDataFrame([(k, "p", f"s{k}.c", "\n".join(t).encode(), 0, "k", 1) for k, t in texts.items()], FILES)
    assert {r.file_id: r.kind for r in not_handwritten(files).collect()} == dict.fromkeys((1, 2, 3, 4), "generated")


def test_a_large_family_is_dealt_to_bounded_places_and_every_pair_meets_once(spark, monkeypatch):
    from collections import Counter

    from tracewright.llm import handwritten as module

    texts = {k: skeleton(k, 71) for k in range(1, 41)}  # one skeleton with 40 sets of names
    texts[41] = texts[40].replace("name_1", "nom_1")  # a variant of the last
    files = spark.createDataFrame([(k, f"p{k % 3}", f"s{k}.c", t.encode(), 0, "k", 1) for k, t in texts.items()], FILES)
    traits = module.file_traits(files).cache()
    size = {r.file_id: r.shingles for r in traits.collect()}
    whole = {(r.file_id, r.family) for r in module.families(traits, files).collect()}
    assert len(whole) > 39 * 38
    monkeypatch.setattr(module, "LOAD", 8 * max(size.values()))
    places = {}
    for r in module.placed(traits).collect():
        places.setdefault((r.cell, r.tile), []).append(r)
    assert max(sum(size[r.file_id] for r in rows) for rows in places.values()) <= 4 * module.LOAD < sum(size.values())
    met = Counter((x.file_id, y.file_id) for rows in places.values() for x in rows if x.wanted for y in rows if y.held and y.head in x.wanted and x.file_id < y.file_id)
    assert met == Counter((x, y) for x in texts for y in texts if x < y)
    assert {(r.file_id, r.family) for r in module.families(traits, files).collect()} == whole


def test_common_counts_equal_intersections():
    from tracewright.llm.shingles import common_counts

    rng = np.random.default_rng(3)
    frequent = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(frequent, n), rng.integers(0, 1 << 63, 30, dtype=np.uint64), np.arange(k, k + 3, dtype=np.uint64)])) for k, n in enumerate([0, 5, 900, 4000, 1200, 77, 2500] * 9)]
    for asked, held in ((sets[:20], sets), (sets, sets[5:8]), (sets[:1] + [sets[0][:0]], sets[:2]), (sets, []), ([sets[0][:0]], sets)):
        assert common_counts(asked, held).tolist() == [[len(np.intersect1d(a, b)) for b in held] for a in asked]


def test_dense_cells_give_the_pairs_of_others(spark):
    from pyspark.sql import functions as F

    from tracewright.llm.shingles import compared

    rng = np.random.default_rng(5)
    sets = spark.createDataFrame([(k, np.unique(rng.integers(0, 60, 40)).tolist()) for k in range(60)] + [(60, [])], "file_id long, shingles array<bigint>").cache()
    hold = sets.withColumn("cell", F.col("file_id") % 3)
    partners = sets.select(F.col("file_id").alias("a"), F.explode(F.array(*map(F.lit, range(3)))).alias("cell")).withColumn("others", F.expr("filter(sequence(0L, 70L), x -> x % 3 = cell and x > a)"))
    got = [sorted(map(tuple, compared(hold, partners, sets, 3, 0.3, 0.5, dense=d).collect())) for d in (False, True)]
    assert len(got[0]) > 100 and got[0] == got[1]


def test_lists_worked_on_together_give_what_each_gives():
    from tracewright.llm import lexing as lx
    from tracewright.llm.near_duplicates import odd_sketches

    rng = np.random.default_rng(6)
    for sizes in ([0, 1, 4, 5, 6, 0, 300, 2, 24, 25, 0], [3], [0, 0], []):
        lists = [rng.integers(0, 40, n).astype(np.uint64) for n in sizes]
        flat, borders = np.concatenate([*lists, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        cut = lambda values, at: [values[lo:hi].tolist() for lo, hi in zip(at, at[1:])]
        for width in (5, 24):
            assert cut(*lx.windows_each(flat, borders, width)) == [windows(x, width).tolist() for x in lists]
        assert cut(*lx.distinct_each(flat, borders)) == [lx.distinct(x).tolist() for x in lists]
        assert lx.sums_each(flat, borders).tolist() == [int(x.sum()) for x in lists]
        assert lx.minhash_each(flat, borders, 7).tolist() == [minhash(x, 7).tolist() for x in lists]
        sets = [lx.distinct(x) for x in lists]
        assert odd_sketches(*lx.distinct_each(flat, borders)) == [odd_sketch(s).tobytes() for s in sets]


def test_few_pairs_of_unlike_sketches_are_counted_in_full(monkeypatch):
    """Whole sketches are read for the few pairs that shorter ones leave, though every tile has an alike pair."""
    from tracewright.llm import near_duplicates as nd

    rng, left, real = np.random.default_rng(7), [], getattr(nd, "_near", None)
    sets = [rng.integers(0, 1 << 62, 300).astype(np.uint64) for _ in range(600)]
    sets += [np.concatenate([s[:290], s[290:] + np.uint64(1)]) for s in sets]
    sizes, bits = np.array([len(s) for s in sets]), [odd_sketch(s).tobytes() for s in sets]

    def near(a, b, radius):
        found = real(a, b, radius)
        left.append((len(a), len(found[0])))
        return found

    monkeypatch.setattr(nd, "_near", near, raising=False)
    i, j, _, _ = nd.compare(sizes, bits, sizes, bits, 0.8, own=True)
    assert {(min(x), max(x)) for x in zip(i.tolist(), j.tolist())} == {(k, k + 600) for k in range(600)}
    assert max(words for words, _ in left) < len(bits[0]) // 8 and 600 <= sum(n for _, n in left) < 0.02 * len(sets) ** 2
