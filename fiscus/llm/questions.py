"""The registered query of each operator, over the whole of its tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fiscus.llm import bpe, divergence, fm_index, lsh, negatives, packing, quality, search, shuffling, simhash, suffixes, token_files, toxicity
from fiscus.llm.common import table
from fiscus.llm.labelled import held_out

VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_search(spark, folder):
    return search.top_k(table(spark, folder, "embeddings"), 20)


def removed():
    """How much the spans of a document hold."""
    return F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)").alias("n_removed")


def op2_substrings(spark, folder):
    done = fm_index.remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_words", removed(), F.sha2("kept", 256).alias("kept_sha256"))


def op3_suffixes(spark, folder):
    done = suffixes.remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", removed(), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op5_bpe(spark, folder):
    done = bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return done.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_shuffle(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shuffling.shuffle(docs).select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(shuffling.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_quality(spark, folder):
    docs = table(spark, folder, "documents")
    field = quality.train(docs, table(spark, folder, "labels"))
    done = quality.score(docs, field)
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lines", F.size("bad_lines").alias("n_bad_lines"))


def op8_embeddings(spark, folder):
    return lsh.near_vectors(table(spark, folder, "embeddings"))


def op9_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    done = toxicity.score(docs, model)
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op10_simhash(spark, folder):
    return simhash.near_groups(table(spark, folder, "documents"))


def op11_token_files(spark, folder):
    files = token_files.write(table(spark, folder, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return token_files.checksums(token_files.read_documents(files))


def op12_negatives(spark, folder):
    return negatives.mine(table(spark, folder, "embeddings"))


def op13_divergence(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_search, op2_substrings, op3_suffixes, op4_packing, op5_bpe, op6_shuffle, op7_quality, op8_embeddings, op9_toxicity, op10_simhash, op11_token_files, op12_negatives, op13_divergence)}
SQL: dict[str, str] = {
    "op2_substrings": """
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), p AS (
            SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 49), ' ')) AS w
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM d)
        ), f AS (SELECT w, min(doc_id) AS least FROM p GROUP BY w),
        g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM p JOIN f USING (w) WHERE least < doc_id),
        k AS (
            SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS kept, count(*) AS n
            FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d) ANTI JOIN g USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op1_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.p, c.p), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.p) = len(q.p) WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT * FROM r WHERE rank <= 20
    """,
    "op12_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.p, c.p), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.p) = len(a.p) WHERE a.vec_id % 50 = 0
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
    """,
    "op13_divergence": """
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
                   regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents
        ), w AS (
            SELECT lang, source, doc, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
        ), k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
        l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
        n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
        f AS (
            SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
                   CAST(1 + (1000000000 * CAST(coalesce(c.c, 0) + 1 AS HUGEINT)) // (coalesce(n.n, 0) + l.v) AS HUGEINT) AS p,
                   CAST(1 + (1000000000 * CAST(k.total + 1 AS HUGEINT)) // (l.n + l.v) AS HUGEINT) AS q
            FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), s AS (
            SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
            FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM f WHERE c > 0 AND p > q
        ), o AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
        )
        SELECT * FROM o WHERE part = 'pair' OR rank <= 200
    """,
}
