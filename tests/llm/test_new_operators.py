"""Token files, hard negatives and source divergence against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fiscus.llm import divergence, fm_index, negatives, suffixes, token_files, windows

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string"


# --- token files --------------------------------------------------------------------------------


def encoded(rows):
    """(doc_id, start, n, crc) of rows of (doc_id, text) in order, by the tokenizers library on whole texts."""
    tokenizer, start, out, flat = Tokenizer.from_file(PATH), 0, [], []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        flat += ids
    return out, flat


TEXTS = [
    (5, "Plain words, don't they'll 123 x1y2"), (1, None), (2, ""), (9, "Ünï ΣΑΣ Σ é a ́b \u0085 c d e"), (7, "<|endoftext|> a<|startoftext|>b <|endof text|>"),
    (11, "Z" * 5000), (12, "\n\t \r\n"), (13, "wörd " * 3000), (14, "日本語のテキスト 🙂🙂 ½ ①"), (-3, "minus"),
]


def test_token_files_equal_the_library_on_whole_texts(spark):
    df = spark.createDataFrame([(i, t, "extra") for i, t in TEXTS], "doc_id long, text string, path string").repartition(3)
    files = token_files.write(df, PATH, file_tokens=64)
    got = sorted(tuple(r) for r in token_files.checksums(token_files.read_documents(files)).collect())
    want, flat = encoded(sorted(TEXTS))
    assert got == want
    assert files.count() > 2
    asked = spark.range(-5, len(flat) + 5).toDF("place")
    found = {r.place: r.id for r in token_files.tokens_at(files, asked, bucket=100).collect()}
    assert found == dict(enumerate(flat))


def test_token_files_keep_repeated_rows_and_null_ids(spark):
    rows = [(None, "none"), (4, "a b"), (4, "a b"), (4, "c"), (None, None)]
    files = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    got = [tuple(r) for r in token_files.checksums(token_files.read_documents(files)).orderBy("start").collect()]
    assert [r[0] for r in got] == [None, None, 4, 4, 4]
    assert sorted(r[2] for r in got) == sorted(encoded(rows)[0][i][2] for i in range(5))
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()


def test_no_documents_give_no_files(spark):
    files = token_files.write(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert files.count() == 0
    assert token_files.read_documents(files).count() == 0
    assert token_files.tokens_at(files, spark.range(3).toDF("place")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_codes_give_any_id(n):
    rng = np.random.default_rng(n)
    ids = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
    content = token_files.file_bytes(ids, np.array([n]), np.array([8]), np.array([False]))
    codes = token_files.TokenFile(content).codes
    places = rng.permutation(n)
    assert (codes.at(places) == ids[places]).all()
    for a, b in ((0, n), (n // 3, n // 2), (n // 2, n // 2)):
        assert (codes.between(a, b) == ids[a:b]).all()


def test_other_content_is_no_token_file():
    with pytest.raises(ValueError, match="not a token file"):
        token_files.TokenFile(b"something else")


# --- hard negatives -----------------------------------------------------------------------------


def mined(rows, every=50, positives=5, count=3):
    """The contract, row by row, in Python's integers."""
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [int(Fraction(x) * 256 // 1) for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for a, va, la in kept:
        if a % every:
            continue
        score = [(sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, v, lab in kept if len(v) == len(va) and i != a]
        same = sorted(((s, i) for s, i, lab in score if lab == la), key=lambda x: (-x[0], x[1]))[:positives]
        for ps, pi in same:
            fit = sorted(((s, i) for s, i, lab in score if lab != la and 50 * ps <= 100 * s <= 95 * ps), key=lambda x: (-x[0], x[1]))[:count]
            out += [(a, pi, k + 1, i, max(min(ps, 2**63 - 1), -(2**63)), max(min(s, 2**63 - 1), -(2**63))) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def clustered(n, dim, seed, spread=0.3, size=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, dim))
    v = (centre[rng.integers(0, 6, n)] + spread * rng.standard_normal((n, dim))) * size
    return [(i, [float(np.float32(x)) for x in v[i]], int(rng.integers(0, 4))) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label long"


@pytest.mark.parametrize("rows", [
    clustered(600, 6, 1), clustered(400, 3, 2, spread=0.02), clustered(300, 5, 3, size=1e7),
    [(i, [1.0, 2.0, 0.0], i % 3) for i in range(200)],
    clustered(200, 4, 5) + [(1000, [1e12, 2e12, 3e12, -1e12], 1), (1050, [5e11, 2e12, 3e12, 1e12], 1), (1051, [4e11, 1e12, 2e12, 1e12], 2), (1100, [2.0**52, 0.0, 0.0, 1.5], 2)],
], ids=["clusters", "tight", "large", "ties", "mixed"])
@pytest.mark.parametrize("shard", [40, 32_768])
def test_negatives_equal_brute_force(spark, rows, shard):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in negatives.mine(df, shard=shard, visitors=5).collect())
    assert got == mined(rows)


def test_negatives_leave_out_what_cannot_take_part(spark):
    odd = [
        (None, [1.0, 1.0], 1), (50, None, 1), (100, [1.0, 2.0], None), (150, [1.0, None], 1), (200, [float("nan"), 1.0], 1), (250, [float("inf"), 1.0], 2),
        (300, [], 1), (350, [0.0, 0.0], 1), (351, [0.0, 0.0], 2), (400, [1.0, 2.0, 3.0], 1), (401, [1.0, 2.0, 2.0], 1), (402, [1.0, 1.0, 2.0], 2),
    ]
    rows = clustered(150, 2, 9) + odd
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in negatives.mine(df).collect()) == mined([r for r in rows if r[1] != []])
    assert negatives.mine(df.limit(0)).count() == 0


def test_bounds_hold_all_scores():
    rng = np.random.default_rng(4)
    values = np.floor(rng.standard_normal((300, 7)) * 300)
    values[5] = 0
    norm, angles = negatives.angles_to(values, negatives.references(values[:50]))
    down, up = negatives.bounds(norm, angles, norm, norm, angles, angles)
    score = values @ values.T
    assert (down <= score).all() and (score <= up).all()


def test_tight_clusters_leave_most_rows_unscored(spark):
    rows = np.array([r[1] for r in clustered(2000, 16, 6, spread=0.05)])
    values = negatives.integers(rows)
    norm, angles = negatives.angles_to(values, negatives.references(rows[:500]))
    down, up = negatives.bounds(norm[:20], angles[:20], norm, norm, angles, angles)
    best = np.sort(values[:20] @ values.T, axis=1)[:, -6]
    meets = (up >= 0.5 * best[:, None]) & (down <= 0.95 * best[:, None])
    assert meets.mean() < 0.5


# --- divergence ---------------------------------------------------------------------------------


def audited(rows, least=3, top=200):
    texts = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {t[0] for t in texts}:
        own = [t for t in texts if t[0] == lang]
        docs = Counter(w for _, _, ws in own for w in set(ws))
        kept = [w for w, n in docs.items() if n >= least]
        by = {s: Counter(w for _, source, ws in own if source == s for w in ws) for s in {t[1] for t in own}}
        whole = Counter(w for _, _, ws in own for w in ws)

        def shares(counts, kept=kept):
            total = sum(counts[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (counts[w] + 1) // total for w in kept}

        p, q = {s: shares(c) for s, c in by.items()}, shares(whole)
        for s in by:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in by if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if by[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, w, v, k + 1) for k, (v, w) in enumerate(found[:most])]
    return sorted(out)


def corpus(seed, docs=120, sources=9, words=60):
    rng = np.random.default_rng(seed)
    pool = [f"W{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(words)]
    out = []
    for i in range(docs):
        source = f"s{rng.integers(0, sources)}"
        text = "  ".join(f"{pool[int(words * rng.random() ** 2)]}," for _ in range(rng.integers(0, 40)))
        out.append((i, text, ("en", "de")[i % 2], source))
    return out


@pytest.mark.parametrize("side,width,chunk", [(32, 16_384, 4 << 20), (2, 4, 300)])
def test_divergence_equals_brute_force(spark, side, width, chunk):
    rows = corpus(1) + [
        (900, None, "en", "s1"), (901, "Alone", None, None), (902, "", "fr", "x"), (903, "", "fr", "y"), (904, "x" * 20_000 + " Wa", "en", "big"), (901, "Alone", None, None), (901, "ALONE", None, "other"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", item int")
    got = sorted(tuple(r) for r in divergence.audit(df, side=side, width=width, chunk_bytes=chunk).collect())
    assert got == audited(rows)


def test_divergence_of_one_source_or_no_rows(spark):
    rows = [(i, "same words here", "en", "only") for i in range(5)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == audited(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_keeps_the_first_terms_only(spark):
    rows = corpus(3)
    got = sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOCS), top=2).collect())
    assert got == audited(rows, top=2)


def test_shares_of_many_occurrences_stay_exact(spark):
    from pyspark.sql import functions as F

    cases = [(10**12, 3 * 10**12 + 7), (9 * 10**13 - 2, 9 * 10**13), (0, 1), (5, 7 * 10**13)]
    df = spark.createDataFrame(cases, "c long, t long").select(divergence.share(F.col("c"), F.col("t")))
    assert [r[0] for r in df.collect()] == [1 + 10**9 * (c + 1) // t for c, t in cases]


# --- passages -----------------------------------------------------------------------------------


def unrepeated(rows, window):
    """Bytes of each text without windows of words that a smaller id has, row by row."""
    words = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in rows]
    least = {}
    for (i, t), spans in zip(rows, words, strict=True):
        data = (t or "").encode()
        for k in range(len(spans) - window + 1):
            key = tuple(data[a:b] for a, b in spans[k:k + window])
            least[key] = min(least.get(key, 2**63 - 1), 2**63 - 1 if i is None else i)
    out = []
    for (i, t), spans in zip(rows, words, strict=True):
        data, keep = (t or "").encode(), np.ones(len((t or "").encode()), bool)
        for k in range(len(spans) - window + 1):
            key = tuple(data[a:b] for a, b in spans[k:k + window])
            if least[key] < (2**63 - 1 if i is None else i):
                keep[spans[k][0]:spans[k + window - 1][1]] = False
        out.append((i, None if t is None else np.frombuffer(data, np.uint8)[keep].tobytes().decode()))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_passages_of_an_earlier_document_go_and_the_first_stays(spark):
    rng = np.random.default_rng(8)
    pool = [f"w{i}é" for i in range(9)]
    rows = [(int(i), "  \n".join(rng.choice(pool, rng.integers(0, 60)))) for i in rng.permutation(80)]
    rows += [(7, rows[3][1]), (None, rows[5][1]), (200, None), (201, ""), (202, rows[0][1]), (202, rows[0][1]), (203, "\t" + rows[1][1] + "\r\n end")]
    rows += [(300, " ".join(f"x{i}" for i in range(40_000))), (301, "first " + " ".join(f"x{i}" for i in range(40_000)) + " last")]
    df = spark.createDataFrame([(t, i, "clash", 5) for i, t in rows], "text string, doc_id long, spans string, k1 int").repartition(5)
    for size in (2**20, 3000):
        found = suffixes.find_passages(windows.documents(df, "doc_id", "text"), 6, 2, size)
        assert found.count() > 0
    got = suffixes.clean_passages(df, window=6, gram=2)
    assert got.columns == df.columns
    assert by_id((r.doc_id, r.text) for r in got.collect()) == by_id(unrepeated(rows, 6))
    assert suffixes.clean_passages(df.limit(0)).count() == 0


def test_passages_by_suffixes_are_those_of_the_index(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = windows.documents(docs, "doc_id", "text")

    def spans_of(found):
        return {(r.k1, r.k2): [x.tolist() for x in windows.merged(pa.array([[s.asDict() for s in r.spans]]))[0]] for r in found.collect()}

    assert spans_of(suffixes.find_passages(plain)) == spans_of(fm_index.find_repeats(plain))


def test_words_are_cut_and_encoded_together_with_the_ids_of_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, plain = token_files.Words(path), Tokenizer.from_file(path)
    given = []

    class Counting:
        def encode_batch_fast(self, texts, **settings):
            given.extend(texts)
            return plain.encode_batch_fast(texts, **settings)

    coder.tokenizer = Counting()
    rng = random.Random(3)
    odd = [*"abAHS0 19\t.,!?=<>|'_-#", "É", "İ", "ß", "̱", "̸", "́", "가", " ", "<|endoftext|>", "'ll", "'s", "😀", "½", "\x1c"]
    texts = [None, "", *("".join(rng.choices(odd, k=rng.randrange(1, 40))) for _ in range(2000))]
    words = ["".join(rng.choices("abcdefghÄé", k=8)) for _ in range(5000)]
    texts += [" ".join(w + rng.choice(["", ".", ",", "%%%"]) for w in rng.choices(words, k=50)) for _ in range(400)]
    ids, sizes = coder.encode(pa.array(texts), 2)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert ids[a:b].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 2]
    # Words of letters go to the tokenizer many at a time, and once however they are punctuated.
    assert sum(t in set(words) for t in given) == 0
    assert sum(len(t.split()) for t in given if set(t.split()) & set(words)) <= 5010
