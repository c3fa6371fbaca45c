"""Packing, leaks and languages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import packing
from tracewright.llm.languages import LANGUAGES, fit, label_code, mislabelled, pieces_of, segments
from tracewright.llm.leaks import RADIUS, HammingIndex, Items, item_words, leaks, words
from tracewright.llm.packing import containers, crossover


def thirds(rng, bins=20):
    """Sizes that fill bins of 128 three by three, which best fit in decreasing order misses."""
    sizes = []
    for _ in range(bins):
        a = rng.randrange(33, 60)
        b = rng.randrange(33, min(62, 94 - a))
        sizes += [a, b, 128 - a - b]
    rng.shuffle(sizes)
    return sizes


def best_fit_decreasing(sizes, capacity):
    bins = packing.Bins(sizes, capacity)
    bins.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]))
    return bins


def test_evolution_beats_its_best_seed():
    rng = random.Random(3)
    for _ in range(3):
        sizes = thirds(rng)
        first = packing.seeds(sizes, 128, rng)
        best = packing.evolve(first, sizes, 128, rng, generations=300, stall=300)[0]
        assert sorted(i for g in best.groups() for i in g) == list(range(len(sizes)))
        assert max(best.fill.values()) <= 128 and len(best.fill) < min(len(b.fill) for b in first)


def test_islands_beat_best_fit_decreasing(spark):
    sizes = thirds(random.Random(7), 24)
    docs = spark.createDataFrame([(i, " ".join(["word"] * n)) for i, n in enumerate(sizes)], "doc_id long, text string")
    out = containers(docs, capacity=128).toPandas()
    assert out.sort_values("doc_id").tokens.tolist() == sizes
    assert out.container.nunique() < len(best_fit_decreasing(sizes, 128).fill)


def test_elites_move_to_the_next_island():
    import pyarrow as pa

    sizes = thirds(random.Random(9), 4)
    items = [{"doc_id": i, "piece": 0, "tokens": n} for i, n in enumerate(sizes)]
    batch = pa.RecordBatch.from_pylist([{"shard": 3, "island": 0, "items": items, "crowd": []}], schema=packing._STATE)
    rows = [r for b in packing._epoch(128, 0, 0)(iter([batch])) for r in b.to_pylist()]
    assert [(r["shard"], r["island"], r["items"] is None) for r in rows] == [(3, 0, False), (3, 1, True)] and rows[1]["crowd"] == rows[0]["crowd"][:1]
    held = list(packing._islands(iter([pa.RecordBatch.from_pylist([rows[0], {**rows[1], "island": 0}], schema=packing._STATE)])))
    assert len(held) == 1 and len(held[0][3]) == len(rows[0]["crowd"]) + 1


def test_no_shard_outgrows_its_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    seen = []
    real = packing.pack
    monkeypatch.setattr(packing, "pack", lambda items, shards, capacity, level=0: seen.append((items.count(), shards)) or real(items, shards, capacity, level))
    # No two of these fit together, so no bin is ever full: packing ends instead of gathering them in one task.
    docs = spark.createDataFrame([(i, "word " * (70 + i % 9)) for i in range(400)], "doc_id long, text string")
    out = containers(docs, capacity=128).toPandas()
    assert out.container.nunique() == 400 and len(seen) == 1 and all(n / k <= 50 for n, k in seen)


def test_crossover_keeps_every_item_once():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 60) for _ in range(120)]
    one, two = (b.groups() for b in packing.seeds(sizes, 100, rng)[:2])
    child = crossover(one, two[::-1], sizes, 100, rng)
    assert sorted(i for g in child.groups() for i in g) == list(range(120))
    assert all(child.fill[b] == sum(sizes[i] for i in g) <= 100 for b, g in child.items.items())


def test_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    rng = random.Random(5)
    rows = [(i, "word " * rng.randrange(1, 60), "x", 1) for i in range(150)] + [(500, "long " * 700, "x", 1), (501, "", "x", 1), (502, None, "x", 1), (None, "a b", "x", 1), (7, "word", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string, tokens int")
    out = containers(df, capacity=128).toPandas()
    assert (out.groupby("container").tokens.sum() == out.groupby("container").container_tokens.first()).all()
    assert out.container_tokens.max() <= 128 and not out.duplicated(["doc_id", "piece"]).any()
    split = out.groupby("doc_id").tokens.sum()
    cut = out[out.doc_id.duplicated(keep=False)].doc_id.unique()
    assert (split[cut] > 128).all() and set(out.doc_id) == set(range(150)) | {500}
    bound = -(-int(out.tokens.sum()) // 128)
    assert out.container.nunique() <= bound * 1.03 + 1
    assert containers(df.limit(0), capacity=128).count() == 0


ITEMS = [
    "Suppose an allocator named turimin sees twenty ranges of which eighteen touch vawarel. No alias of vawarel escapes yet lebozux is read by the handler of daduzon. When turimin is unrolled the count of daduzon shrinks and lebozux becomes dead. Which value of vawarel reaches the exit",
    "Suppose an allocator named kesapir sees forty ranges of which eleven touch royamir. No alias of royamir escapes yet beneron is read by the handler of sunevix. When kesapir is unrolled the count of sunevix shrinks and beneron becomes dead. Which value of royamir reaches the exit",
]


def test_words_lose_their_dress():
    assert words("The ﬁle was unro-\n * lled, Café “x”") == ["the", "file", "was", "unrolled", "cafe", "x"]
    assert words("a​b­c") == ["abc"] and words("") == []


def test_hamming_index_finds_all_within_radius_and_little_else():
    rng = np.random.default_rng(3)
    stored = rng.integers(0, 1 << 63, (40, 4)).astype(np.uint64)
    query = stored[:10].copy()
    for k in range(10):
        for bit in rng.choice(256, 3 * k + 4, replace=False):
            query[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    near = {(q, s) for q in range(10) for s in range(40) if np.bitwise_count(query[q] ^ stored[s]).sum() <= RADIUS}
    index = HammingIndex(stored, RADIUS)
    assert set(zip(*(x.tolist() for x in index.query(query)))) == near and len(near) == 10
    reached = len(index.reached(rng.integers(0, 1 << 63, (2000, 4)).astype(np.uint64))[0]) / 2000 / 40
    assert reached < 0.01  # of the pieces, by a random window


def test_weights_count_over_all_blocks(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta", 3), (2, "alpha beta other words", 3), (3, "one", 3), (3, "one", 3), (4, "- -", 3)], "item_id long, text string, words int")
    got = {r.item_id: (r.words, r.counts) for r in item_words(items).collect()}
    assert got[1] == (["alpha", "beta", "gamma", "delta"], [2, 1, 1]) and got[2][1] == [2, 1, 1] and set(got) == {1, 2, 3} and not got[3][1]
    alone = Items([1], [got[1][0]], [np.array(got[1][1])], 3)
    both = Items([1, 2], [got[1][0], got[2][0]], [np.array(got[k][1]) for k in (1, 2)], 3)
    prints = [x.pieces[0][4].prints[x.pieces[0][1] == 0].tolist() for x in (alone, both)]
    assert prints[0] == prints[1] and alone.weight[alone.features[0]].tolist() == both.weight[both.features[0]].tolist()


def test_short_items(spark):
    items = spark.createDataFrame([(1, "quanpo vumer tihod lasgo"), (2, "Zebraword"), (3, "of the"), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before quanpo vumer tihod after"), (2, "a zebraword; quanpo lasgo"), (3, "the of"), (4, "zebraword")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.part) for r in leaks(docs, items).collect()} == {(1, 1, 0.75), (2, 2, 1.0), (4, 2, 1.0)}


def test_every_planted_half_is_found():
    """Halves of items with one word in ten changed, in one stretch or two: recall against aligning all."""
    rng = np.random.default_rng(11)
    texts = [[f"w{rng.integers(0, 400)}" for _ in range(int(rng.integers(40, 130)))] for _ in range(60)]
    known = Items(list(range(60)), texts)
    hit = 0
    for i, t in enumerate(texts):
        n = len(t)
        cut = int(rng.integers(0, n // 2 - 2))
        first, second = t[cut : cut + n // 4 + 2], t[cut + n // 4 + 4 : cut + n // 2 + 8]
        text = ["x"] * 30 + first + ["y"] * 20 + second + ["z"] * 30
        text = [f"w{rng.integers(0, 400)}" if rng.random() < 0.1 else w for w in text]
        coded = np.array([known.word_id.get(w, 0) for w in text])
        hit += i in {k for k, _ in known.candidates(coded)}
    assert hit >= 57


def test_leaks(spark):
    w = ITEMS[0].split()
    half = " ".join(w[10 : 10 + len(w) // 2 + 3])
    edited = " ".join("changed" if k % 12 == 5 else x for k, x in enumerate(w))
    two = " ".join(w[:14]) + " some other words stand between these two stretches of the text here " + " ".join(w[20:36])
    frame = ITEMS[0].replace("turimin", "aaaa").replace("vawarel", "bbbb").replace("lebozux", "cccc").replace("daduzon", "dddd").replace("twenty", "nine").replace("eighteen", "two")
    docs = [
        (1, "Before. " + ITEMS[0].upper() + " After."), (2, "> " + half.replace(" ", "\n> ")), (3, edited), (4, two), (5, frame), (6, " ".join(w[:12])),
        (7, None), (8, ""), (9, "filler text " * 20000 + ITEMS[1]), (10, ITEMS[0] + " and " + ITEMS[1]), (1, "Before. " + ITEMS[0].upper() + " After."), (None, ITEMS[0]),
    ]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, part int")
    items = spark.createDataFrame([(1, ITEMS[0]), (2, ITEMS[1]), (2, ITEMS[1]), (3, None), (4, ""), (5, "too short"), (None, "x y z w v")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(df, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 2), (10, 1), (10, 2)}
    assert leaks(df.limit(0), items).count() == 0 and leaks(df, items.limit(0)).count() == 0


def test_items_are_taken_in_blocks(spark, monkeypatch):
    from tracewright.llm import leaks as module

    monkeypatch.setattr(module, "BLOCK_CHARS", 10)
    df = spark.createDataFrame([(1, ITEMS[0]), (2, ITEMS[1])], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEMS[0]), (2, ITEMS[1])], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(df, items).collect()} == {(1, 1), (2, 2)}


def test_label_codes():
    assert [label_code(x) for x in ("EN", "en-US", "en_GB", "eng", "German", "ger", "pt-BR", "Brazilian Portuguese", "und", "", None, "xx", "n/a")] == ["en", "en", "en", "en", "de", "de", "pt", "pt", None, None, None, None, None]


def test_forward_sums_all_segmentations():
    model = fit({"ab": np.array([3.0]), "b": np.array([1.0])}, ["▁a", "▁ab", "b"], steps=1)
    p = model.prob[:, 0]
    k = model.index
    total = p[k["▁ab"]] + p[k["▁a"]] * p[k["b"]] + p[k["▁"]] * p[k["a"]] * p[k["b"]]
    assert abs(model.forward(model.lattice("ab"))[0][-1, 0] - total) < 1e-12
    assert len(pieces_of("piece_bpe_32k.model")) > 10_000


def test_long_words_are_read_to_their_end():
    counts = {"a": np.array([9.0, 1.0]), "b": np.array([1.0, 9.0]), "c": np.array([1e-3, 1e-3])}
    model = fit(counts, [], steps=2)
    assert model.score("c" * 99 + "a").argmax() == 0 and model.score("c" * 99 + "b").argmax() == 1
    alpha, scale = model.forward(model.lattice("c" * 3000 + "ab"))
    assert scale[-1] < -1000 and (alpha[-1] > 0).all()  # far below what a double holds
    short, _ = model.forward(model.lattice("cab"))
    step = np.log(model.prob[model.index["c"]]) * 2999
    assert np.allclose(np.log(alpha[-1]) + scale[-1], np.log(short[-1]) + step)
    fit({"c" * 3000 + "a": np.array([1.0, 1.0])}, [], steps=2)
    assert max(map(len, pieces_of("piece_bpe_32k.model"))) > 12


SAYING = {
    "en": "The loop is never used although the warning points to the wrong column.",
    "de": "Die Schleife wird nicht verwendet, obwohl die Warnung auf die falsche Spalte zeigt.",
    "fr": "La boucle n'est jamais utilisée alors que l'avertissement indique la mauvaise colonne.",
    "es": "El bucle nunca se usa aunque el aviso señala la columna equivocada.",
    "pt": "O laço nunca é usado embora o aviso aponte para a coluna errada.",
    "it": "Il ciclo non viene mai usato anche se l'avviso indica la colonna sbagliata.",
    "nl": "De lus wordt nooit gebruikt hoewel de waarschuwing naar de verkeerde kolom wijst.",
    "ru": "Цикл никогда не используется, хотя предупреждение указывает не на тот столбец.",
}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(10 * k + j, SAYING[l] + (" " + SAYING[l]) * j, l) for k, l in enumerate(LANGUAGES) for j in range(6)]
    mixed = SAYING["de"] + "\n\n```\nint x = foo (bar);\nreturn the_loop;\n```\n\n" + SAYING["de"] + "\n\n * " + SAYING["fr"].replace(" ", "\n * ", 3) + "\n\n" + SAYING["en"].upper()
    rows += [(900, mixed, "de"), (901, SAYING["it"], "en"), (902, SAYING["nl"], "Dutch"), (903, SAYING["ru"], None), (904, "", "en"), (905, None, "en"), (906, "```\nx = 1;\n```", "en"), (None, SAYING["en"], "de"), (901, SAYING["it"], "en"), (907, (SAYING["es"] + "\n") * 3000, "es-MX")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, segments string, words int")


def test_segments(labelled):
    got = {}
    for r in segments(labelled, size=1000).orderBy("seg_no").collect():
        got.setdefault(r.doc_id, []).append(r.lang)
        assert 0 < r.confidence <= 1
    assert got[900] == ["de", "fr", "en"] and got[901] == ["it"] and got[907] == ["es"]
    assert all(got[10 * k + j] == [l] for k, l in enumerate(LANGUAGES) for j in range(6))
    assert not {904, 905, 906, None} & set(got)


def test_mislabelled(labelled):
    got = {(r.doc_id, r.seg_no, r.lang) for r in mislabelled(labelled, size=1000).collect()}
    assert got == {(900, 1, "de"), (900, 2, "fr"), (900, 3, "en"), (901, 1, "it"), (903, 1, "ru")}
    assert mislabelled(labelled.limit(0)).count() == 0


def test_held_out_accuracy(spark, sf):
    """Documents whose label names a language, in one language by the model, mostly agree with it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = segments(docs, size=500).where("segments = 1 and label_code is not null")
    agree = found.agg(F.avg((F.col("lang") == F.col("label_code")).cast("double"))).first()[0]
    assert agree > 0.7  # a fifth of the labels are wrong by design


def test_a_stretch_pasted_over_and_over_hides_no_other(spark):
    w = [f"word{k}" for k in range(60)]
    first, second = " ".join(w[:20]), " ".join(w[40:55])
    pasted = " and then some more of it that is new here ".join([first] * 60)
    docs = [(1, pasted + " some other words stand between these two stretches " + second), (2, second + " some other words stand between these " + pasted), (3, pasted)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(df, items).collect()} == {(1, 1)}


def test_the_best_pair_of_stretches_equals_all_pairs():
    rng = np.random.default_rng(5)
    item = [f"w{k:02}" for k in range(40)]
    known = Items([1], [item])
    for _ in range(60):
        text: list[str] = []
        for _ in range(int(rng.integers(1, 9))):
            a = int(rng.integers(0, 34))
            text += item[a : a + int(rng.integers(4, 12))] + ["other"] * int(rng.integers(5, 9))
        coded = np.array([known.word_id.get(x, 0) for x in text])
        # Stretches stand apart from each other, so each is an unbroken diagonal.
        stretches, j = [], 0
        while j < len(text):
            k = j
            while k + 1 < len(text) and coded[j] and coded[k + 1] == coded[k] + 1:
                k += 1
            if coded[j] and k - j >= 3:
                stretches.append((item.index(text[j]), j, item.index(text[k]), k))
            j = k + 1
        most = max((b - a + 1 for a, _, b, _ in stretches), default=0)
        for i0, j0, i1, j1 in stretches:
            for a0, b0, a1, b1 in stretches:
                if i1 < a0 and j1 < b0:
                    most = max(most, i1 - i0 + 1 + a1 - a0 + 1)
        assert abs(known.part(0, coded, np.flatnonzero(coded)) - most / 40) < 1e-9


def test_a_semicolon_makes_no_code_of_prose(labelled):
    rows = [(950, SAYING["fr"] + "\n\n" + SAYING["en"].replace("used although", "used; although"), "fr", "x", 1), (951, SAYING["de"] + "\n\nint x = foo (bar);\nreturn the_loop;", "de", "x", 1)]
    docs = labelled.unionByName(labelled.sparkSession.createDataFrame(rows, labelled.schema))
    got = {}
    for r in segments(docs, size=1000).where("doc_id >= 950").orderBy("seg_no").collect():
        got.setdefault(r.doc_id, []).append(r.lang)
    assert got == {950: ["fr", "en"], 951: ["de"]}


def test_a_short_segment_is_not_lost(labelled):
    rows = [(960, SAYING["fr"] + "\n\nЦикл никогда.\n\n" + SAYING["fr"], "fr", "x", 1)]
    docs = labelled.unionByName(labelled.sparkSession.createDataFrame(rows, labelled.schema))
    assert [r.lang for r in segments(docs, size=1000).where("doc_id = 960").orderBy("seg_no").collect()] == ["fr", "ru", "fr"]
