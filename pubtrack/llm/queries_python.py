"""Queries of the operators that run numpy or Arrow code inside Spark tasks, with their SQL where there is any."""

from __future__ import annotations

import public_tokenizers

from pubtrack.llm import bpe, exact, language, near, nearest, passages
from pubtrack.llm.common import LOWER, UPPER
from pubtrack.llm.registry import documents, query

EXACT = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS form FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY form) AS keep_id, count(*) OVER (PARTITION BY form) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY form) AS kept, sha256(form) AS text_sha256 FROM n
"""


@query("op3_exact_dedup", EXACT)
def _(spark, d):
    return exact.exact_groups(documents(spark, d))


@query("op4_byte_bpe")
def _(spark, d):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(documents(spark, d), path, public_tokenizers.PATTERN, keep_ids=False)


@query("op6_language_id")
def _(spark, d):
    rows = documents(spark, d)
    return language.predict(rows, language.fit(rows))


PASSAGES = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
g AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM k) WHERE least < doc_id),
c AS (SELECT doc_id, list(i ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM g) GROUP BY 1),
u AS (SELECT d.doc_id, p, word, list_contains(l, p) AS gone FROM c JOIN d USING (doc_id), LATERAL (SELECT unnest(w) AS word, generate_subscripts(w, 1) AS p)),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM u GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, array_to_string(w, ' '))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""


@query("op9_repeated_passages", PASSAGES)
def _(spark, d):
    return passages.remove_repeats(documents(spark, d))


@query("op5_minhash_near_dedup")
def _(spark, d):
    return near.near_components(documents(spark, d))


@query("op10_nearest_vectors")
def _(spark, d):
    return nearest.nearest(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id % 20 = 0")
