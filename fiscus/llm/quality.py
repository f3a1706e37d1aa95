"""Quality of documents from a linear-chain conditional random field over their lines.

Every line is good or bad. Its evidence are shares of kinds of characters, repeated words and
repeated lines, of itself and of the lines before and after it; transitions couple neighbours.
The field is learned from document labels: lines of good documents are good; in bad documents
a first fit without transitions tells bad lines from good ones, and if it finds none all are bad.
A document's quality is the mean of its lines' forward-backward marginals, weighted by length,
put on a scale of probability by a logistic fit to the document labels.

Lines are worked on in blocks: the features of a block at a time, and long chains in segments whose
2 x 2 products carry the messages from one segment to the next. A text of any number of lines takes
some numbers a line and steps in the square root of it.

An empty or null text is one empty line. A null id is scored like any other; repeated rows are
scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import chunks_of, ids_and_texts, joined, prefix_sums, record, slice_hashes, words_of
from fiscus.llm.fitting import gathered, minimum, summed
from fiscus.llm.labelled import sample

#: Labelled documents of either label that the fit reads at most.
SAMPLE = 2000
CHUNK = 4 << 20
#: Lines whose features are held at a time (a longer learned-from document is learned from in pieces
#: of as many), lines of a segment of a chain, and segments that are worked on at a time.
LINES, SEGMENT, SEGMENTS = 1 << 16, 256, 4096
#: Steps of each fit at most, and the penalty of squared weights.
ROUNDS, DECAY = 40, 1e-3
NEWLINE = 10

KINDS = np.zeros(256, np.uint8)
KINDS[ord("a"):ord("z") + 1] = 1
KINDS[0x80:] = 1
KINDS[ord("A"):ord("Z") + 1] = 2
KINDS[ord("0"):ord("9") + 1] = 3
KINDS[[ord(c) for c in "|"]] = 4
KINDS[[ord(c) for c in "!?"]] = 5
KINDS[[ord(c) for c in "#$%&*@~^_=+<>\\/{}[]`"]] = 6
KINDS[[ord(c) for c in ".,;:'\"()-"]] = 7
KINDS[[9, 10, 11, 12, 13, 32]] = 8
N_KINDS = 9
N_OWN = N_KINDS + 5
N_FEATURES = 3 * N_OWN + 1


@dataclass(frozen=True)
class Field:
    """Weights of the evidence, log weights of transitions, and the scale of the document score."""

    weights: np.ndarray
    moves: np.ndarray
    scale: tuple[float, float]


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the first line of each text (one more entry at the end); every text has a line."""
    breaks = np.flatnonzero(data == NEWLINE)
    first = np.searchsorted(breaks, at) + np.arange(len(at))
    starts = np.empty(first[-1], np.int64)
    later = np.ones(len(starts), bool)
    later[first[:-1]] = False
    starts[first[:-1]] = at[:-1]
    starts[later] = breaks + 1
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = at[1:]
    return starts, ends, first


def repeated(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a line that is not empty stands again in its text."""
    some = np.flatnonzero(ends > starts)
    if not len(some):
        return np.zeros(len(starts), bool)
    owner = (np.searchsorted(first, some, side="right") - 1).astype(np.uint64)
    key = slice_hashes(prefix_sums(data), starts[some], ends[some]) ^ (owner * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    found = np.zeros(len(starts), bool)
    found[some[order[1:][same]]] = True
    found[some[order[:-1][same]]] = True
    return found


def own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, again: np.ndarray) -> np.ndarray:
    """The features that lines have of themselves; starts, ends: lines after one another in ``data``."""
    n, size = len(starts), ends - starts
    own = np.zeros((n, N_OWN))
    low, high = int(starts[0]), int(ends[-1])
    text, begins = data[low:high], starts - low
    if len(text):
        # A line break belongs to the line before it, and is not counted.
        line = np.repeat(np.arange(n), np.diff(np.append(begins, len(text))))
        counts = np.bincount(line * N_KINDS + KINDS[text], minlength=n * N_KINDS).reshape(n, N_KINDS)
        counts[:, KINDS[NEWLINE]] -= np.diff(np.append(begins, len(text))) - size
        own[:, :N_KINDS] = counts / np.maximum(size, 1)[:, None]
        edges = np.append(begins, len(text))
        begin, end, _ = words_of(text, edges)
        at_line = line[begin]
        words = np.bincount(at_line, minlength=n)
        if len(begin) > 1:
            hashes = slice_hashes(prefix_sums(text), begin, end)
            same = np.zeros(len(begin), bool)
            same[1:] = (hashes[1:] == hashes[:-1]) & (at_line[1:] == at_line[:-1])
            own[:, N_KINDS] = np.bincount(at_line, same, n) / np.maximum(words, 1)
        own[:, N_KINDS + 1] = np.minimum(np.bincount(at_line, end - begin, n) / np.maximum(words, 1) / 10, 3)
    own[:, N_KINDS + 2] = np.log1p(size) / 6
    own[:, N_KINDS + 3] = size == 0
    own[:, N_KINDS + 4] = again
    return own


def line_scores(own: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Evidence of each line from its own features and those of its neighbours in the text."""
    parts = own @ weights[:-1].reshape(3, N_OWN).T
    return _beside(parts, first) + weights[-1]


def _beside(parts: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = parts[:, 0].copy()
    before, after = parts[:-1, 1].copy(), parts[1:, 2].copy()
    cut = first[1:-1] - 1
    before[cut] = 0
    after[cut] = 0
    total[1:] += before
    total[:-1] += after
    return total


def line_slopes(own: np.ndarray, first: np.ndarray, push: np.ndarray) -> np.ndarray:
    """Slope of the weights from that of the evidence of each line."""
    later, earlier = np.zeros(len(push)), np.zeros(len(push))
    later[:-1] = push[1:]
    earlier[1:] = push[:-1]
    later[first[1:] - 1] = 0
    earlier[first[:-1]] = 0
    return np.concatenate([own.T @ push, own.T @ later, own.T @ earlier, [push.sum()]])


def text_scores(data: np.ndarray, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evidence of all lines, their lengths, and the first line of each text; one block of lines is described at a time."""
    starts, ends, first = lines_of(data, at)
    again = repeated(data, starts, ends, first)
    parts = np.empty((len(starts), 3))
    matrix = weights[:-1].reshape(3, N_OWN).T
    for a in range(0, len(starts), LINES):
        b = min(a + LINES, len(starts))
        parts[a:b] = own_features(data, starts[a:b], ends[a:b], again[a:b]) @ matrix
    return _beside(parts, first) + weights[-1], ends - starts + 1, first


def _local(scores: np.ndarray) -> np.ndarray:
    good = 1 / (1 + np.exp(-np.clip(scores, -50, 50)))
    return np.stack([1 - good, good], axis=-1) + 1e-30


def _transfers(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For each segment the product of its lines' evidence and the steps between them, up to a factor."""
    out = np.empty((len(begin), 2, 2))
    for a in range(0, len(begin), SEGMENTS):
        at, size = begin[a:a + SEGMENTS], length[a:a + SEGMENTS]
        now = np.zeros((len(at), 2, 2))
        now[:, [0, 1], [0, 1]] = _local(scores[at])
        for t in range(1, int(size.max())):
            some = np.flatnonzero(size > t)
            more = (now[some] @ step) * _local(scores[at[some] + t])[:, None, :]
            now[some] = more / more.sum(axis=(1, 2), keepdims=True)
        out[a:a + SEGMENTS] = now
    return out


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability that each line is good, the expected number of each transition, and the log of the sum over all paths.

    Bad is 0, good is 1. Texts are cut into segments; products of whole segments carry the messages to
    each of them, and then segments advance together, line by line.
    """
    sizes = np.diff(first)
    count = -(-sizes // SEGMENT)
    head = np.cumsum(count) - count
    text = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(text)) - head[text]
    begin = first[:-1][text] + place * SEGMENT
    length = np.minimum(first[1:][text] - begin, SEGMENT)
    top = moves.max()
    step = np.exp(moves - top)
    # What comes in from the line before the segment, and from the line after it.
    before, after = np.ones((len(text), 2)), np.ones((len(text), 2))
    long = np.flatnonzero(count > 1)
    if len(long):
        some = np.flatnonzero(count[text] > 1)
        product = np.empty((len(text), 2, 2))
        product[some] = _transfers(scores, begin[some], length[some], step)
        for k in range(1, int(count.max())):
            at = head[long[count[long] > k]] + k
            v = (before[at - 1] @ step if k > 1 else before[at - 1])[:, None, :] @ product[at - 1]
            before[at] = v[:, 0] / v.sum(axis=2)
        for k in range(1, int(count.max())):
            at = (head + count)[long[count[long] > k]] - 1 - k
            v = after[at + 1] @ step.T if k > 1 else after[at + 1]
            v = (product[at + 1] @ v[:, :, None])[:, :, 0]
            after[at] = v / v.sum(axis=1, keepdims=True)
    good, expected = np.empty(len(scores)), np.zeros((2, 2))
    total = float(np.logaddexp(0, np.clip(scores, -50, 50)).sum()) + top * float((sizes - 1).sum())
    order = np.argsort(-length, kind="stable")
    for a in range(0, len(order), SEGMENTS):
        own = order[a:a + SEGMENTS]
        at, size, opens = begin[own], length[own], place[own] == 0
        closes = place[own] == count[text[own]] - 1
        longest = int(size[0])
        active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        local, ahead, back = np.empty((longest, len(own), 2)), np.empty((longest, len(own), 2)), np.empty((longest, len(own), 2))
        for t in range(longest):
            n = active[t]
            local[t, :n] = _local(scores[at[:n] + t])
            x = local[t, :n] * (ahead[t - 1, :n] @ step if t else np.where(opens[:, None], 1.0, before[own] @ step))
            norm = x.sum(axis=1, keepdims=True)
            total += float(np.log(norm).sum())
            ahead[t, :n] = x / norm
        for t in range(longest - 1, -1, -1):
            n = active[t]
            more = active[t + 1] if t + 1 < longest else 0
            # Evidence from all that follows: the next line here, or what comes in from the next segment.
            follows = np.concatenate([local[t + 1, :more] * back[t + 1, :more] if more else np.empty((0, 2)), after[own[more:n]]])
            x = follows @ step.T
            last = np.arange(n) >= more
            x[last & closes[:n]] = 1.0
            back[t, :n] = x / x.sum(axis=1, keepdims=True)
            inner = np.flatnonzero(~(last & closes[:n]))
            if len(inner):
                pairs = ahead[t, inner][:, :, None] * step[None] * follows[inner][:, None, :]
                expected += (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            both = ahead[t, :n] * back[t, :n]
            good[at[:n] + t] = both[:, 1] / both.sum(axis=1)
    return good, expected, total


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def piece_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines of a batch of pieces, first lines, labels, and the weight of a line for its document."""
    own = np.concatenate([np.frombuffer(x.as_py(), "<f4") for x in batch.column(2)]).reshape(-1, N_OWN).astype(float)
    lines = batch.column(3).to_numpy()
    return own, np.concatenate([[0], np.cumsum(lines)]), batch.column(1).to_numpy(), np.repeat(1 / batch.column(4).to_numpy(), lines)


def alone_slope(batch: pa.RecordBatch, params: np.ndarray, each: np.ndarray) -> tuple[float, np.ndarray]:
    """Lines without transitions: loss of the documents' labels as labels of all their lines, and its slope."""
    own, first, labels, weight = piece_of(batch)
    label = np.repeat(labels, np.diff(first))
    weight = weight * each[label]
    z = line_scores(own, first, params)
    loss = float((weight * (np.logaddexp(0, z) - label * z)).sum())
    return loss, line_slopes(own, first, weight * (0.5 * (1 + np.tanh(z / 2)) - label))


def states_of(own: np.ndarray, first: np.ndarray, labels: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Whether each line counts as good: all of a good document, those that look good of a bad one, none if all do."""
    lines = np.diff(first)
    label = np.repeat(labels, lines)
    state = np.where(label == 1, 1, line_scores(own, first, alone) > 0).astype(int)
    none = (np.add.reduceat(1 - state, first[:-1]) == 0) & (labels == 0)
    state[np.repeat(none, lines)] = 0
    return state


def chain_slope(batch: pa.RecordBatch, params: np.ndarray, alone: np.ndarray) -> tuple[float, np.ndarray]:
    """The chain: loss of the states of all lines, and its slope in weights and transitions."""
    own, first, labels, _ = piece_of(batch)
    state = states_of(own, first, labels, alone)
    moves = params[N_FEATURES:].reshape(2, 2)
    z = np.clip(line_scores(own, first, params[:N_FEATURES]), -50, 50)
    p, expected, total = marginals(z, first, moves)
    inside = np.ones(len(state), bool)
    inside[first[:-1]] = False
    at = np.flatnonzero(inside)
    seen = np.bincount(state[at - 1] * 2 + state[at], minlength=4).reshape(2, 2)
    loss = total - float((state * z).sum()) - float((seen * moves).sum())
    return loss, np.concatenate([line_slopes(own, first, p - state), (expected - seen).ravel()])


def document_means(good: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(good * sizes, first[:-1]) / np.add.reduceat(sizes, first[:-1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", each: int = SAMPLE) -> Field:
    """Learn from at most ``each`` documents of either label.

    Lines stay in the tasks, which sum the slopes; two numbers a document reach the driver. Without
    documents of both labels every document scores as the share of good ones (0.5 if there is no label).
    """
    rows, counts = sample(ids_and_texts(docs, id_col, text_col), labels, label_col, each)
    if not all(counts.get(x) for x in (0, 1)):
        share = counts.get(1, 0) / max(sum(counts.values()), 1) if counts else 0.5
        share = min(max(share, 0.01), 0.99)
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)), (0.0, float(np.log(share / (1 - share)))))

    def run(batches):
        for chunk in chunks_of(batches, CHUNK):
            data, at = joined(chunk.column(1))
            starts, ends, first = lines_of(data, at)
            again = repeated(data, starts, ends, first)
            for i in range(chunk.num_rows):
                for a in range(first[i], first[i + 1], LINES):
                    b = min(a + LINES, first[i + 1])
                    own = own_features(data, starts[a:b], ends[a:b], again[a:b])
                    yield record(["doc_id", "label", "own", "lines", "of", "sizes"], [
                        chunk.column(0)[i:i + 1], chunk.column(2)[i:i + 1], pa.array([own.astype("<f4").tobytes()], pa.binary()),
                        [int(b - a)], [int(first[i + 1] - first[i])], pa.array([(ends[a:b] - starts[a:b] + 1).astype("<i8").tobytes()], pa.binary()),
                    ])

    pieces = gathered(rows.mapInArrow(run, "doc_id long, label int, own binary, lines long, of long, sizes binary"), "quality-lines")
    taken = np.array([min(counts[x], each) for x in (0, 1)], float)
    share = taken.sum() / taken / 2
    data = summed(pieces, lambda batch, w: alone_slope(batch, w, share), N_FEATURES)

    def with_penalty(f, penalty, scale):
        def at(w):
            loss, slope = f(w)
            return loss / scale + penalty / 2 * w @ w, slope / scale + penalty * w
        return at

    alone = minimum(with_penalty(data, 1e-2, 1.0), np.zeros(N_FEATURES), ROUNDS)
    total = float(pieces.agg(F.sum("lines")).first()[0])
    chain = summed(pieces, lambda batch, w: chain_slope(batch, w, alone), N_FEATURES + 4)
    params = minimum(with_penalty(chain, DECAY, total), np.zeros(N_FEATURES + 4), ROUNDS)
    weights, moves = params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2)

    def means(batches):
        for batch in batches:
            if batch.num_rows:
                own, first, label, _ = piece_of(batch)
                good = marginals(line_scores(own, first, weights), first, moves)[0]
                sizes = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in batch.column(5)])
                yield record(["doc_id", "label", "good", "size"], [
                    batch.column(0), batch.column(1), np.add.reduceat(good * sizes, first[:-1]), np.add.reduceat(sizes, first[:-1]).astype(float),
                ])

    told = pieces.mapInArrow(means, "doc_id long, label int, good double, size double").groupBy("doc_id", "label").agg(
        (F.sum("good") / F.sum("size")).alias("raw")).toPandas().sort_values("doc_id")
    y = told["label"].to_numpy()
    each_doc = np.array([counts[0], counts[1]], float) / taken
    scale = logistic(np.stack([told["raw"].to_numpy(), np.ones(len(told))], axis=1), y, each_doc[y], penalty=0.1)
    return Field(weights, moves, (float(scale[0]), float(scale[1])))


def scores(field: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text, the marginals of all lines, and the first line of each text."""
    data, at = joined(texts)
    values, sizes, first = text_scores(data, at, field.weights)
    good = marginals(values, first, field.moves)[0]
    a, b = field.scale
    raw = document_means(good, sizes, first)
    return 1 / (1 + np.exp(-np.clip(a * raw + b, -50, 50))), good, first


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, lines, bad_lines) of every row; bad_lines lists the lines more likely bad than good, from 0."""
    def run(batches):
        for chunk in chunks_of(batches, CHUNK):
            if not chunk.num_rows:
                continue
            value, good, first = scores(field, chunk.column(1))
            bad = np.flatnonzero(good < 0.5)
            cuts = np.searchsorted(bad, first)
            owner = np.repeat(np.arange(len(first) - 1), np.diff(cuts))
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((bad - first[owner]).astype(np.int32)))
            yield record(["doc_id", "score", "lines", "bad_lines"], [chunk.column(0), value, np.diff(first).astype(np.int32), lists])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, lines int, bad_lines array<int>")


def keep(docs: DataFrame, field: Field, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with their columns as they are."""
    where = docs.columns.index(text_col)

    def run(batches):
        for chunk in chunks_of(batches, CHUNK, where):
            if chunk.num_rows:
                yield chunk.filter(pa.array(scores(field, chunk.column(where).cast(pa.string()))[0] >= least))

    return docs.mapInArrow(run, docs.schema)
