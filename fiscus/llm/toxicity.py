"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence is toxic with the probability of a logistic model over the words it holds (whole
words and their beginnings, hashed); a document is toxic if any of its sentences is, so the
sentences combine by noisy-or. Weights are fitted to document labels alone, through the noisy-or,
and then tell which sentences offend. Only features that are clearly more frequent in toxic
documents get a weight.

Null and empty texts hold no sentence and score as zero evidence (the noisy-or of nothing, 0).
Repeated rows and null ids are scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import chunks_of, ids_and_texts, joined, prefix_sums, record, slice_hashes, stored
from fiscus.llm.labelled import sample

#: Labelled documents of either label that the fit reads at most, and features that get a weight at most.
SAMPLE, FEATURES = 6000, 40_000
#: Bits of a hashed feature; beginnings of words in bytes.
BITS, BEGINNINGS = 22, (4, 5, 6, 7)
CHUNK = 4 << 20
EPOCHS, RATE, DECAY = 300, 0.1, 1e-4

LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class Words:
    """Sorted hashed features, their weights, and the log-odds of a sentence without any."""

    features: np.ndarray
    weights: np.ndarray
    base: float


def sentences_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all sentences in bytes, and the first sentence of each text; a sentence ends with ``.!?`` or its line."""
    starts = np.zeros(len(data) + 1, bool)
    starts[1:] = ENDS[data]
    starts[at] = True
    starts = np.flatnonzero(starts[:-1])
    return starts, np.searchsorted(starts, at)


def hits(data: np.ndarray, at: np.ndarray, starts: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature) of all words, once each; known: only these (sorted) features, as their places."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    small = LOWER[data]
    solid = LETTERS[small]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    cuts = at[(at > 0) & (at < len(data))]
    begin[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[cuts - 1] = solid[cuts - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    sums = prefix_sums(small)
    if known is not None:
        flags = np.zeros(1 << BITS, bool)
        flags[known] = True
    found = []
    for size in (0, *BEGINNINGS):
        some = np.flatnonzero(end - begin > size) if size else np.arange(len(begin))
        key = (slice_hashes(sums, begin[some], begin[some] + size if size else end[some]) >> np.uint64(64 - BITS)).astype(np.int64)
        if size:
            key ^= size * 0x9E37
        if known is not None:
            hit = flags[key]
            some, key = some[hit], key[hit]
        found.append(np.stack([begin[some], key]))
    where, key = np.concatenate(found, axis=1)
    pair = np.unique((np.searchsorted(starts, where, side="right") - 1) << BITS | key)
    sentence, key = pair >> BITS, pair & ((1 << BITS) - 1)
    return sentence, key if known is None else np.searchsorted(known, key)


def fit(doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, sentences: np.ndarray, labels: np.ndarray, each: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights and base by gradient steps on the likelihood of document labels.

    doc, sentence, feature: one entry for each feature in a sentence; sentences: how many each
    document has; each: weight of each document.
    """
    pairs, at = np.unique(doc << 32 | sentence, return_inverse=True)
    owner = pairs >> 32
    bare = sentences - np.bincount(owner, minlength=len(labels))
    params = np.zeros(n + 1)
    params[:n], params[n] = 1.0, -7.0
    memory = [np.zeros(n + 1), np.zeros(n + 1)]
    total = each.sum()
    for epoch in range(1, EPOCHS + 1):
        z = params[n] + np.bincount(at, params[feature], len(pairs))
        p, base = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-params[n]))
        load = np.bincount(owner, np.logaddexp(0, z), len(labels)) + bare * np.logaddexp(0, params[n])
        load = np.maximum(load, 1e-12)
        push = each * np.where(labels == 1, -1 / np.expm1(np.minimum(load, 700)), 1.0)
        by_pair = push[owner] * p
        slope = np.append(np.bincount(feature, by_pair[at], n), by_pair.sum() + (push * bare * base).sum()) / total
        slope[:n] += DECAY * params[:n]
        memory[0] = 0.9 * memory[0] + 0.1 * slope
        memory[1] = 0.99 * memory[1] + 0.01 * slope**2
        params -= RATE * (memory[0] / (1 - 0.9**epoch)) / (np.sqrt(memory[1] / (1 - 0.99**epoch)) + 1e-10)
    return params[:n], float(params[n])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", each: int = SAMPLE) -> Words:
    """Learn from at most ``each`` documents of either label. Without documents of both labels nothing is toxic."""
    rows, counts = sample(ids_and_texts(docs, id_col, text_col), labels, label_col, each)
    if not all(counts.get(x) for x in (0, 1)):
        return Words(np.zeros(0, np.int64), np.zeros(0), -20.0)
    rows = stored(rows, "toxic-sample")

    def features(batches):
        for chunk in chunks_of(batches, CHUNK):
            data, at = joined(chunk.column(1))
            sentence, key = hits(data, at, at[:-1][np.diff(at) > 0])
            owner = np.flatnonzero(np.diff(at) > 0)[sentence]
            yield record(["label", "feature"], [chunk.column(2).take(pa.array(owner)), key])

    n = {x: min(counts[x], each) for x in (0, 1)}
    shares = rows.mapInArrow(features, "label int, feature long").groupBy("feature").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    ).withColumn("lift", F.col("toxic") / n[1] / ((F.col("clean") + 0.5) / n[0]))
    chosen = shares.where("toxic >= 3 AND lift >= 8").orderBy(F.desc("lift"), "feature").limit(FEATURES)
    known = np.sort(np.array([r["feature"] for r in chosen.select("feature").collect()], np.int64))

    def found(batches):
        for chunk in chunks_of(batches, CHUNK):
            data, at = joined(chunk.column(1))
            starts, first = sentences_of(data, at)
            sentence, key = hits(data, at, starts, known)
            cuts = np.searchsorted(sentence, first).astype(np.int32)
            inside = sentence - np.repeat(first[:-1], np.diff(cuts))
            yield record(["doc_id", "label", "sentences", "sentence", "feature"], [
                chunk.column(0), chunk.column(2), np.diff(first),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(inside)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(key.astype(np.int64))),
            ])

    got = rows.mapInArrow(found, "doc_id long, label int, sentences long, sentence array<long>, feature array<long>").toPandas().sort_values("doc_id")
    sizes = got["sentence"].map(len).to_numpy()
    y = got["label"].to_numpy()
    share = np.array([counts[0], counts[1]], float) / np.maximum(np.bincount(y, minlength=2), 1)
    weights, base = fit(
        np.repeat(np.arange(len(got)), sizes), np.concatenate([*got["sentence"], np.zeros(0, np.int64)]).astype(np.int64),
        np.concatenate([*got["feature"], np.zeros(0, np.int64)]).astype(np.int64), got["sentences"].to_numpy(), y, share[y], len(known),
    )
    return Words(known, weights, base)


def scores(model: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text; log-odds, start and end of all sentences, and the first sentence of each text."""
    data, at = joined(texts)
    starts, first = sentences_of(data, at)
    sentence, feature = hits(data, at, starts, model.features)
    z = model.base + np.bincount(sentence, model.weights[feature], len(starts))
    by_text = np.zeros(len(at) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        by_text[some] = np.add.reduceat(np.logaddexp(0, z), first[some])
    own = np.repeat(np.arange(len(at) - 1), np.diff(first))
    begin = starts - at[own]
    end = np.append(starts[1:], len(data)) - at[own]
    return -np.expm1(-by_text), z, begin, end, first


def score(docs: DataFrame, model: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, offending) of every row; offending: start, end (bytes) and score of sentences over one half."""
    def run(batches):
        for chunk in chunks_of(batches, CHUNK):
            value, z, begin, end, first = scores(model, chunk.column(1))
            bad = np.flatnonzero(z > 0)
            cuts = pa.array(np.searchsorted(bad, first).astype(np.int32))
            spans = pa.StructArray.from_arrays(
                [pa.array(begin[bad]), pa.array(end[bad]), pa.array(1 / (1 + np.exp(-z[bad])))], names=["start", "end", "score"]
            )
            yield record(["doc_id", "score", "offending"], [chunk.column(0), value, pa.ListArray.from_arrays(cuts, spans)])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>"
    )


def keep(docs: DataFrame, model: Words, text_col: str = "text", most: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``most``, with their columns as they are."""
    where = docs.columns.index(text_col)

    def run(batches):
        for chunk in chunks_of(batches, CHUNK, where):
            yield chunk.filter(pa.array(scores(model, chunk.column(where).cast(pa.string()))[0] < most))

    return docs.mapInArrow(run, docs.schema)
