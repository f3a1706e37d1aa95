"""The operators against brute force, on small tables with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from fiscus.llm import bpe, fm_index, labelled, lsh, packing, quality, search, shuffling, simhash, suffixes, toxicity
from fiscus.llm.components import components, forest

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, k1 string, start int, shard string, fp string"
RNG = np.random.default_rng(11)


def prose(n, words=("alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa")):
    return " ".join(f"{words[i]}{j}" for i, j in zip(RNG.integers(0, len(words), n), RNG.integers(0, 40, n), strict=True))


@pytest.fixture(scope="module")
def texts():
    shared, a, b = prose(120), prose(200), prose(90)
    near = a.split(" ")
    near[50] = "changed"
    rows = [
        (1, a), (2, " ".join(near)), (3, a), (3, a), (4, f"{b} {shared} {prose(30)}"), (5, f"{prose(40)}\n{shared}\t{prose(20)}"),
        (6, None), (7, ""), (8, "  \n\t "), (9, "one"), (10, "one two"), (11, "One TWO three"), (12, "ha " * 700), (13, "a" * 3000),
        (None, a), (None, "no id"), (14, prose(3000)), (15, "<|endoftext|>x <|endoftext|>"), (16, "日本 語'll 😀 x  \n"), (17, shared), (18, "==" * 450 + "\n" + "ab" * 500),
    ]
    return [(i, t, "x", 1, "y", None) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(3).cache()


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def test_bpe_is_the_library(docs, texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.round_trip(docs, VOCABULARY).collect())
    want = Counter()
    for i, t, *_ in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False).encode()] += 1
    assert got == want


def test_bpe_on_random_strings():
    tokenizer, model = Tokenizer.from_file(VOCABULARY), bpe.load(VOCABULARY)
    letters = list("a's  \n\t'dlrevtmABC123.,;½#😀é中  ")
    rows = ["".join(RNG.choice(letters, RNG.integers(0, 40))) for _ in range(1500)] + ["".join(RNG.choice(list("abcdeilnorst"), 2500)), "a" * 1000]
    ids, at = model.encode(rows)
    for i, want in enumerate(tokenizer.encode_batch(rows, add_special_tokens=False)):
        assert ids[at[i]:at[i + 1]].tolist() == want.ids
    data, places = model.decode(ids, at)
    assert [bytes(data[a:b]).decode() for a, b in zip(places, places[1:], strict=False)] == rows


def test_packing_places_everything_once(docs, texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack(docs.where("doc_id IS NULL OR doc_id <> 3"), VOCABULARY).collect()
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in texts if i not in (3, None)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, ids in want.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert k == 0 or r["length"] == 1024
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    room = []  # first-fit, longest first
    for length in sorted((r["length"] for r in rows), reverse=True):
        at = next((i for i, x in enumerate(room) if x >= length), len(room))
        room[at:at + 1] = [(room[at] if at < len(room) else 1024) - length]
    assert len(by_sequence) <= len(room)


def test_plan_holds_the_histogram_and_wastes_little():
    histogram = dict(Counter(RNG.integers(1, 1025, 5000).tolist()))
    made = packing.plan(histogram, rounds=100)
    held = Counter()
    for config, many in made:
        assert sum(a * b for a, b in config) <= 1024
        for length, times in config:
            held[length] += times * many
    assert held == Counter(histogram)
    best = sum(a * b for a, b in histogram.items()) / 1024
    assert sum(many for _, many in made) <= 1.03 * best + 1
    assert packing.plan({}) == []


def test_price_is_the_best_configuration():
    lengths, values = np.array([3, 5, 7]), np.array([2.0, 4.0, 6.5])
    got = packing.price(values, lengths, 22)
    best = max(2 * a + 4 * b + 6.5 * c for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 22)
    assert sum(values[lengths.tolist().index(k)] * n for k, n in got.items()) == best


def test_shuffle_keeps_rows_and_balances(docs, texts, tmp_path):
    own = docs.withColumnRenamed("shard", "label")
    rows = shuffling.shuffle(own, bucket_bytes=4000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((i, t) for i, t, *_ in texts)
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert shuffling.write(own, str(tmp_path / "shards")).count() == len(texts)
    with pytest.raises(ValueError, match="shard"):
        shuffling.shuffle(docs)


def test_shuffle_slots(spark):
    frame = spark.range(1000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    got = shuffling.shuffle(frame, bucket_bytes=5000).toPandas()
    assert sorted(got["doc_id"]) == list(range(1000))
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1
    assert abs(np.corrcoef(got["doc_id"], got["shard"] * 100 + got["slot"])[0, 1]) < 0.2
    assert shuffling.shuffle(frame.limit(0)).count() == 0


def brute_windows(rows, window, smaller):
    """Covered places of each row, by comparing all windows; smaller: only windows in a smaller id count."""
    at = {}
    for i, t in rows:
        for p in range(len(t) - window + 1):
            at.setdefault(tuple(t[p:p + window]), []).append(i)
    out = []
    for i, t in rows:
        keep = [True] * len(t)
        for p in range(len(t) - window + 1):
            ids = at[tuple(t[p:p + window])]
            if min(ids) < i if smaller else len(ids) > 1:
                keep[p:p + window] = [False] * window
        out.append(keep)
    return out


def test_substrings(docs, texts):
    last = 2**63 - 1
    rows = [(last if i is None else i, words(t)) for i, t, *_ in texts]
    want = []
    for (i, t), keep in zip(rows, brute_windows(rows, 50, True), strict=True):
        left = " ".join(w for w, k in zip(t, keep, strict=True) if k)
        want.append((None if i == last else i, len(t), keep.count(False), left.encode()))
    got = [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) for r in fm_index.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_suffixes(docs, texts):
    rows = [(i, (t or "").encode()) for i, t, *_ in texts]
    want = []
    for (i, t), keep in zip(rows, brute_windows([(0, t) for _, t in rows], 400, False), strict=True):
        want.append((i, len(t), keep.count(False), bytes(b for b, k in zip(t, keep, strict=True) if k)))
    got = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in suffixes.remove_repeats(docs).collect():
        for a, b in zip(r["spans"], r["spans"][1:], strict=False):
            assert a["end"] < b["start"]


def test_cut_anchors_give_the_same(docs):
    for module, window, width in ((fm_index, 50, 8), (suffixes, 400, 1)):
        found = module.windows.documents(docs, "doc_id", "text")
        covered = lambda df: sorted((r["k1"], sorted({p for s in r["spans"] for p in range(s["start"], s["end"])})) for r in df.collect())
        assert covered(module.find_repeats(found, window, shard_bytes=1200 * width)) == covered(module.find_repeats(found, window))


def test_a_phrase_that_many_texts_share(spark):
    # A common line amid other words must bring no two texts together, but a passage that holds it must.
    rng = random.Random(5)
    line = [f"line{i}" for i in range(45)]
    passage = [f"p{i}" for i in range(40)] + line + [f"q{i}" for i in range(40)]
    rows = [(i, [f"w{rng.randrange(10**9)}" for _ in range(60)] + (passage if i % 40 == 0 else line) + [f"w{rng.randrange(10**9)}" for _ in range(60)]) for i in range(240)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    found = fm_index.windows.documents(docs, "doc_id", "text")
    small = 4 * 50 * 8 * 8
    plain = fm_index.windows.members(fm_index.windows.runs(found, fm_index.word_hashes, 50, 8), True)
    plain, _ = fm_index.windows.segments(plain, 50, 8, small)
    _, dealt, _ = fm_index.windows.routed(found, fm_index.word_hashes, 50, 8, 8, small, True)
    assert plain.agg({"cells": "max"}).first()[0] > 10
    assert dealt.agg({"cells": "max"}).first()[0] <= 2 and dealt.count() < plain.count() / 4
    got = {r["k1"]: len({p for s in r["spans"] for p in range(s["start"], s["end"])}) for r in fm_index.find_repeats(found, shard_bytes=small).collect()}
    ids = {r["k1"]: r["doc_id"] for r in found.collect()}
    assert {ids[k]: n for k, n in got.items() if n} == {i: len(passage) for i in range(40, 240, 40)}


def test_clean_keeps_columns_and_characters(spark):
    passage = "é" * 300
    frame = spark.createDataFrame([(1, f"a{passage}b", 1), (2, f"xy{passage}", 2), (3, None, 3)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in suffixes.clean(frame).collect()}
    assert got[1]["text"] == "ab" and got[2]["text"] == "xy" and got[3]["text"] is None
    assert suffixes.clean(frame).columns == frame.columns


def brute_fingerprint(text):
    own = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(own[i:i + 3]) for i in range(len(own) - 2)] if len(own) > 2 else [" ".join(own)] * bool(own)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, ids):
    root = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    return [min((x for x, r in zip(ids, root, strict=True) if r == root[i] and x is not None), default=None) for i in range(len(prints))]


@pytest.mark.parametrize("block", [simhash.BLOCK, 1])
def test_simhash(docs, texts, block):
    prints, ids = [brute_fingerprint(t) for _, t, *_ in texts], [i for i, *_ in texts]
    want = sorted(zip(ids, [f"{p:016x}" for p in prints], brute_groups(prints, ids), strict=True), key=str)
    assert sorted_rows(simhash.near_groups(docs, block=block)) == want


def test_near_links_among_close_fingerprints(spark):
    base = [int(x) for x in RNG.integers(-(2**62), 2**62, 6)]
    prints = sorted({b ^ int(np.bitwise_or.reduce(1 << RNG.choice(62, 2))) for b in base for _ in range(30)})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = brute_groups([p & (2**64 - 1) for p in prints], prints)
    for block in (4096, 8):
        found = {r["node"]: r["component"] for r in components(simhash.near_links(frame, block=block)).collect()}
        assert [found.get(p, p) for p in prints] == want


def test_keep_one(docs, texts):
    kept = simhash.keep_one(docs).collect()
    assert Counter(r["doc_id"] for r in kept)[3] == 0 and Counter(r["doc_id"] for r in kept)[1] == 1
    assert {"x"} == {r["k1"] for r in kept}
    twice = simhash.keep_one(docs.where("doc_id = 3")).collect()
    assert len(twice) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 103), (103, 101)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 51)} | {101: 100, 103: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = forest(np.array([5, 4, 9]), np.array([4, 3, 9]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(4, 3), (5, 3)]


def vectors(n=400, dim=8):
    grid = RNG.normal(size=(n, dim))
    grid[n // 2:] = grid[RNG.integers(0, 5, n - n // 2)] + RNG.normal(size=(n - n // 2, dim)) * 0.03
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(grid)]
    odd = [(n, None, 1), (n + 1, [float("nan")] * dim, 1), (n + 2, [None] * dim, 1), (n + 3, [0.0] * dim, 1), (n + 4, [1.0] * 3, 1), (n + 5, [], 0), (n + 6, rows[0][1], None), (None, rows[0][1], 0)]
    return rows + odd + [rows[3], (n + 20, rows[3][1], 1), (n + 40, rows[3][1], 1)]


@pytest.mark.parametrize("block", [lsh.BLOCK, 7])
def test_near_vectors(spark, block):
    rows = vectors()
    got = {}
    for r in lsh.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=block).collect():
        got.setdefault(r["vec_id"], []).append(tuple(r)[1:])
    assert sum(map(len, got.values())) == len(rows)
    fine = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = [sum(a is not b and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt(a[1] @ a[1]) / np.sqrt(b[1] @ b[1]) >= 0.98 for b in fine) for a in fine]
    found = [got[a[0]][0][0] for a in fine]
    assert all(x <= y for x, y in zip(found, want, strict=True)) and sum(found) >= 0.95 * sum(want)
    assert got[400] == got[400] and all(got[400 + k][0][0] == 0 and got[400 + k][0][2] for k in (0, 1, 2, 3, 5, 6))
    assert got[440][0][:2] == got[420][0][:2] and got[3][0][1] == got[420][0][1]


def near_by_id(spark, rows, kind):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lsh.near_vectors(frame).collect()}


def test_near_vectors_of_any_size(spark):
    sizes = [5e-324, 1e-200, 1.0, 1e200, 1.7e308]
    rows = [(i, [x, x / 2 if x > 1e-300 else 0.0], 1) for i, x in enumerate(sizes)] + [(9, [1e-200, -1e-200], 1)]
    got = near_by_id(spark, rows, "int")
    assert all(got[i] == (3, 1, i == 1) for i in (1, 2, 3, 4))
    assert got[0] == (0, 0, True) and got[9] == (0, 9, True)
    fine, values = lsh.scaled(np.array([[3.0, -4.0], [0.0, 0.0], [1e300, 1.0]]))
    assert fine.tolist() == [True, False, True] and values[0].tolist() == [0.375, -0.5] and values.max() < 1


@pytest.mark.parametrize("kind,labels", [
    ("string", ["a", "b", "a ", "", "1"]), ("double", [1.2, 1.9, 0.5, float("nan"), 1.0]), ("boolean", [True, False]),
    ("long", [2**62, 2**62 + 1, -1, 0]),
])
def test_near_vectors_compare_labels_as_they_are(spark, kind, labels):
    rows = [(10 * i + j, [1.0, 2.0], x) for i, x in enumerate(labels) for j in range(2)] + [(99, [1.0, 2.0], None)]
    got = near_by_id(spark, rows, kind)
    want = {10 * i + j: (1, 10 * i, j == 0) for i in range(len(labels)) for j in range(2)}
    assert got == want | {99: (0, 99, True)}


@pytest.mark.parametrize("shard,leaf", [(10_000, 128), (60, 4)])
def test_search_is_exact(spark, shard, leaf, monkeypatch):
    monkeypatch.setattr(search.build, "__defaults__", (leaf,))
    rows = [r for r in vectors() if r[0] is not None]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search.top_k(frame, 20, shard=shard, block=16).where("query_id <> 400").collect())
    grid = [(i, tuple(np.floor(np.array(v) * 64).astype(int))) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for i, v in grid:
        if i % 20 == 0 and i != 400:
            best = sorted((-int(np.dot(v, w)), j) for j, w in grid if j != i and len(w) == len(v))[:20]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_tree_boxes_bound_every_product():
    points = RNG.integers(-100, 100, (500, 6))
    tree = search.Tree(search._pack(**search.build(np.arange(500), points, 8)))
    queries = RNG.integers(-100, 100, (20, 6))
    bounds = tree.bounds(queries)
    for n in range(len(tree.begin)):
        inside = tree.products(slice(tree.begin[n], tree.end[n]), queries)
        assert (inside.max(axis=0) <= bounds[:, n]).all()


def test_marginals_are_those_of_all_paths():
    scores, moves, first = RNG.normal(size=5), RNG.normal(size=(2, 2)), np.array([0, 3, 5])
    got = quality.marginals(scores, first, moves)[0]
    for a, b in zip(first, first[1:], strict=False):
        weight = np.zeros((b - a, 2))
        for path in np.ndindex(*[2] * (b - a)):
            w = np.exp(sum(scores[a + i] * s for i, s in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:], strict=False)))
            for i, s in enumerate(path):
                weight[i, s] += w
        assert np.allclose(got[a:b], weight[:, 1] / weight.sum(axis=1))


@pytest.fixture(scope="module")
def marked(spark):
    good = [(i, f"{prose(30)}.\n{prose(20)}.\n{prose(10)}", 1, int(i % 5 == 0)) for i in range(240)]
    bad = [(i, "\n".join(" ".join(w.upper() + "!!" for w in prose(20).split()) for _ in range(3)), 0, 0) for i in range(240, 320)]
    rows = [(i, t.replace(". ", ". ") + " you wretch" * toxic, q, toxic) for i, t, q, toxic in good + bad]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_classifiers_learn_and_keep_to_their_rows(spark, marked, docs):
    told = marked.select("doc_id", "quality", "toxic")
    for module, label, edge in ((quality, "quality", 0.5), (toxicity, "toxic", 0.7)):
        model = module.train(marked, told)
        held = marked.join(module.score(marked, model), "doc_id").where(labelled.held_out("doc_id")).toPandas()
        assert ((held["score"] >= edge).astype(int) == held[label]).mean() > 0.97
        flipped = told.withColumn(label, labelled.F.when(labelled.held_out("doc_id"), 1 - labelled.F.col(label)).otherwise(labelled.F.col(label)))
        again = module.score(marked, module.train(marked, flipped)).toPandas().sort_values("doc_id")["score"]
        assert np.allclose(again, module.score(marked, model).toPandas().sort_values("doc_id")["score"])
        odd = module.score(docs, model).toPandas()
        assert len(odd) == docs.count() and odd["score"].between(0, 1).all()
        assert module.keep(docs, model).columns == docs.columns
        nothing = module.train(marked, told.limit(0))
        assert module.score(marked, nothing).count() == marked.count()


def test_offending_sentences(spark, marked):
    model = toxicity.train(marked, marked.select("doc_id", "toxic"))
    frame = spark.createDataFrame([(1, "All is well. You wretch! Good day.")], "doc_id long, text string")
    row = toxicity.score(frame, model).first()
    assert [(s["start"], s["end"]) for s in row["offending"]] == [(12, 24)]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert bpe.round_trip(none, VOCABULARY).count() == 0
    assert packing.pack(none, VOCABULARY).count() == 0
    assert fm_index.remove_repeats(none).count() == suffixes.remove_repeats(none).count() == 0
    assert simhash.near_groups(none).count() == simhash.keep_one(none).count() == suffixes.clean(none).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert search.top_k(empty, 20).count() == lsh.near_vectors(empty).count() == 0


def test_digest_columns(spark, folder_of_tables):
    import __spark_entry__ as entry

    got = entry.queries()["op5_bpe"](spark, folder_of_tables).first()
    assert len(got["ids_sha256"]) == len(hashlib.sha256(b"").hexdigest())


@pytest.fixture
def folder_of_tables():
    return "/root/testdata/sf0.001"
