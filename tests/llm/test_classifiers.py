"""The classifiers against sums over all paths, noisy-or by hand, numeric slopes and very long texts."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fiscus.llm import fitting, labelled, quality, toxicity

RNG = np.random.default_rng(5)


def slope_by_differences(f, x, step=1e-5):
    return np.array([(f(x + step * e)[0] - f(x - step * e)[0]) / (2 * step) for e in np.eye(len(x))])


@pytest.mark.parametrize("segment, together", [(1, 2), (3, 4), (256, 4096)])
def test_segments_carry_the_messages(monkeypatch, segment, together):
    monkeypatch.setattr(quality, "SEGMENT", segment)
    monkeypatch.setattr(quality, "SEGMENTS", together)
    sizes = [1, 2, 3, 4, 7, 9, 1, 10]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores, moves = RNG.normal(0, 2, first[-1]), RNG.normal(size=(2, 2))
    good, expected, total = quality.marginals(scores, first, moves)
    every, pairs, logs = np.zeros(len(scores)), np.zeros((2, 2)), 0.0
    for a, b in zip(first, first[1:], strict=False):
        weights = {
            path: np.exp(sum(s * x for s, x in zip(path, scores[a:b], strict=True)) + sum(moves[x, y] for x, y in itertools.pairwise(path)))
            for path in itertools.product((0, 1), repeat=b - a)
        }
        whole = sum(weights.values())
        logs += np.log(whole)
        for path, weight in weights.items():
            every[a:b] += weight / whole * np.array(path)
            for x, y in itertools.pairwise(path):
                pairs[x, y] += weight / whole
    assert np.allclose(good, every) and np.allclose(expected, pairs) and np.isclose(total, logs)


def pieces(texts, labels):
    data, at = quality.joined(pa.array(texts))
    starts, ends, first = quality.lines_of(data, at)
    own = quality.own_features(data, starts, ends, quality.repeated(data, starts, ends, first)).astype("<f4")
    lines = np.diff(first)
    return quality.record(["doc_id", "label", "own", "lines", "of", "sizes"], [
        np.arange(len(texts)), labels, pa.array([own[a:b].tobytes() for a, b in itertools.pairwise(first)], pa.binary()), lines, lines,
        pa.array([b""] * len(texts), pa.binary()),
    ])


def test_slopes_of_the_lines():
    batch = pieces(["a b c\nD! D!\n\nlong line of words", "x", "", "one\none\n"], [1, 0, 1, 0])
    alone = RNG.normal(0, 0.3, quality.N_FEATURES)
    each = np.array([2.0, 0.7])
    assert np.allclose(quality.alone_slope(batch, alone, each)[1], slope_by_differences(lambda w: quality.alone_slope(batch, w, each), alone), atol=1e-6)
    params = RNG.normal(0, 0.3, quality.N_FEATURES + 4)
    assert np.allclose(quality.chain_slope(batch, params, alone)[1], slope_by_differences(lambda w: quality.chain_slope(batch, w, alone), params), atol=1e-6)


def test_blocks_of_lines_change_nothing(monkeypatch):
    texts = pa.array(["a b\nc d\n\na b\n", None, "", "\n", "x y z\n" * 40 + "last", "é è\r\nX|Y|Z\n12 34"])
    field = quality.Field(RNG.normal(size=quality.N_FEATURES), RNG.normal(size=(2, 2)), (3.0, -1.0))
    whole = quality.scores(field, texts)
    assert whole[2].tolist() == [0, 5, 6, 7, 9, 50, 53]
    for lines, segment in ((1, 1), (7, 5)):
        monkeypatch.setattr(quality, "LINES", lines)
        monkeypatch.setattr(quality, "SEGMENT", segment)
        assert all(np.allclose(a, b) for a, b in zip(quality.scores(field, texts), whole, strict=True))


def test_a_text_of_many_line_breaks():
    field = quality.Field(RNG.normal(size=quality.N_FEATURES), RNG.normal(size=(2, 2)), (3.0, -1.0))
    score, good, first = quality.scores(field, pa.array(["\n" * 5_000_000, "a b\nc"]))
    assert first.tolist() == [0, 5_000_001, 5_000_003] and np.isfinite(good).all()
    assert np.isclose(score[1], quality.scores(field, pa.array(["a b\nc"]))[0][0])


def parts_of(word):
    """A word and its beginnings."""
    data = word.encode()
    return [data, *[(data[:n], n) for n in toxicity.BEGINNINGS if len(data) > n]]


def keys_of(words):
    """The hashed feature of each word and beginning, one word at a time."""
    found = {}
    for word in words:
        data, at = toxicity.joined(pa.array([word]))
        found |= {part: None for part in parts_of(word)}
        sums = toxicity.prefix_sums(data)
        for part in parts_of(word):
            size = part[1] if isinstance(part, tuple) else len(data)
            key = int(toxicity.slice_hashes(sums, np.array([0]), np.array([size]))[0] >> np.uint64(64 - toxicity.BITS))
            found[part] = key ^ (size * 0x9E37) if isinstance(part, tuple) else key
    return found


def test_noisy_or_by_hand():
    words = ["wretch", "idiot", "fine", "scoundrel", "été", "go"]
    keys = keys_of(words)
    known = np.array(sorted(set(keys.values())))
    weights = RNG.normal(0, 2, len(known))
    model = toxicity.Words(known, weights, -3.0)
    by_key = dict(zip(known.tolist(), weights.tolist(), strict=True))
    texts = [None, "", "...", "Wretch! You WRETCH wretch.\nfine", "idiot scoundrel. été go", "go\n\ngo?", "nothing of it", "wretched. scoundrels"]
    texts.append("été fine. " * 500_000 + "idiot")  # over one chunk
    got = toxicity.scores(model, pa.array(texts))[0]
    cache = {}
    for text, score in zip(texts, got, strict=True):
        none = 1.0
        for sentence in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$", text or ""):
            if sentence not in cache:
                held = {part for word in re.findall(r"[a-z\u0080-\U0010ffff]+", sentence.lower()) for part in parts_of(word)}
                hashed = {keys.get(part) if part in keys else keys_of([w])[part] for w in re.findall(r"[a-z\u0080-\U0010ffff]+", sentence.lower()) for part in parts_of(w) if part in held}
                z = -3.0 + sum(by_key.get(key, 0.0) for key in hashed)
                cache[sentence] = 1 / (1 + np.exp(z))
            none *= cache[sentence]
        assert np.isclose(score, 1 - none, atol=1e-9), text and text[:40]


def test_slopes_are_summed_over_all_parts(spark):
    rows = spark.range(100).repartition(7)
    goal = np.arange(5.0)

    def evaluate(batch, x):
        n = batch.num_rows
        return n * float((x - goal) @ (x - goal)), n * 2 * (x - goal)

    f = fitting.summed(rows, evaluate, 5)
    loss, slope = f(np.zeros(5))
    assert loss == 100 * goal @ goal and np.allclose(slope, -200 * goal)
    assert np.allclose(fitting.minimum(f, np.zeros(5), 20), goal, atol=1e-3)
    assert fitting.summed(rows.limit(0), evaluate, 5)(np.zeros(5))[0] == 0


def test_labels_that_cannot_be_learned_from(spark):
    ids = [i for i in range(1, 60)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(1, "a"), (None, "x"), (2, None)], "doc_id long, text string")
    rows = [(i, i % 2) for i in ids] + [(3, 0), (3, 1), (4, None), (5, 1), (None, 1), (1000, 1), (6, 7)]
    told = spark.createDataFrame(rows, "doc_id long, toxic int")
    some, counts = labelled.sample(docs, told, "toxic", 100)
    got = {r["doc_id"]: (r["label"], r["text"]) for r in some.collect()}
    held = {r["doc_id"] for r in told.where(labelled.held_out("doc_id")).collect()}
    assert set(got) == {i for i in ids if i not in held and i != 3}
    assert got.get(1, (1, "a")) == (1, "a") and sum(counts.values()) == len(got)
    few, _ = labelled.sample(docs, told, "toxic", 4)
    assert few.groupBy("label").count().agg(F.max("count")).first()[0] == 4
    assert {r["doc_id"] for r in few.collect()} == {r["doc_id"] for r in labelled.sample(docs.orderBy(F.desc("doc_id")), told, "toxic", 4)[0].collect()}
