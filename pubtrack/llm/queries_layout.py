"""Queries of shards, manifest and spelling variants, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pubtrack.llm import merkle, shards, spelling
from pubtrack.llm.common import LOWER, UPPER
from pubtrack.llm.registry import documents, query
from pubtrack.session import checkpoint_dir

#: CTE with the table of CRC-32, made from its polynomial, and the checksum of a text by it.
CRC = """crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i))"""


def checksum(text):
    """SQL for the CRC-32 of ``text``; the CTE ``crc`` must be joined."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::BIGINT)),
 lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"""


def drawn(*parts):
    return f"('0x' || md5(concat_ws(':', {', '.join(parts)}))[1:12])::BIGINT"


SHARDS = f"""
WITH {CRC}, d AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, {checksum("coalesce(text, '')")} AS text_crc32, {drawn("'shards'", 'doc_id')} AS draw FROM documents, crc),
b AS (SELECT greatest(1, ceil(count(*) / 1024), ceil(sum(size) / 4194304))::BIGINT AS buckets, count(*) AS total FROM d),
g AS (SELECT draw % buckets AS bucket, list(doc_id ORDER BY doc_id) AS ids, list_transform(ids, lambda x: [x]) AS single FROM d, b GROUP BY 1),
f AS (SELECT bucket, list_reduce(list_prepend([]::BIGINT[], single), lambda a, x:
 list_concat(a[1:{drawn("'shards'", 'bucket', '0', 'len(a)')} % (len(a) + 1)], x, a[{drawn("'shards'", 'bucket', '0', 'len(a)')} % (len(a) + 1) + 2:],
 CASE WHEN {drawn("'shards'", 'bucket', '0', 'len(a)')} % (len(a) + 1) < len(a) THEN [a[{drawn("'shards'", 'bucket', '0', 'len(a)')} % (len(a) + 1) + 1]] ELSE []::BIGINT[] END)) AS ids FROM g),
u AS (SELECT bucket, unnest(ids) AS doc_id, generate_subscripts(ids, 1) AS i FROM f),
p AS (SELECT doc_id, row_number() OVER (ORDER BY bucket, i) - 1 AS position FROM u),
s AS (SELECT doc_id, position, position * 40 // total AS shard, total FROM p, b)
SELECT d.doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (position - (shard * total + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard FROM s JOIN d USING (doc_id)
"""


@query("op11_random_shards", SHARDS)
def _(spark, d):
    written = shards.write_shards(documents(spark, d), f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}")
    text = F.coalesce("record.text", F.lit(""))
    return written.select("record.doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))


def leaf_sql(text):
    parts = [f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256(concat({', '.join(parts)}))"


# Nodes of both trees level by level, every run with its digests, and for every leaf what stands beside it.
MANIFEST = f"""
WITH RECURSIVE {CRC}, d AS (SELECT doc_id, coalesce('=' || lang, '') AS kin, {leaf_sql('text')} AS leaf,
 CASE WHEN {checksum('doc_id::VARCHAR')} % 3 = 0 THEN {leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf_sql('text')} END AS shown FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY kin ORDER BY doc_id) - 1 AS i FROM d),
t AS (SELECT 0 AS level, kin, i, leaf AS digest, count(*) OVER (PARTITION BY kin) AS n FROM l UNION ALL
 SELECT level + 1, kin, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY level, kin, i // 8, n),
s AS (SELECT kin, digest AS subroot, row_number() OVER (ORDER BY encode(kin)) - 1 AS k FROM t WHERE n = 1),
v AS (SELECT 0 AS level, k AS i, subroot AS digest, count(*) OVER () AS n FROM s UNION ALL
 SELECT level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8 FROM v WHERE n > 1 GROUP BY level, i // 8, n),
r AS (SELECT digest AS root FROM v WHERE n = 1),
b AS (SELECT kin, level, i // 8 AS up, list(digest ORDER BY i) AS run FROM t WHERE n > 1 GROUP BY ALL),
c AS (SELECT level, i // 8 AS up, list(digest ORDER BY i) AS run FROM v WHERE n > 1 GROUP BY ALL),
a AS (SELECT doc_id, 0 AS tree, level, run, (i // (8 ** level)::BIGINT) % 8 AS place FROM l JOIN b ON l.kin = b.kin AND up = i // (8 ** (level + 1))::BIGINT UNION ALL
 SELECT doc_id, 1, level, run, (k // (8 ** level)::BIGINT) % 8 FROM l JOIN s USING (kin) JOIN c ON up = k // (8 ** (level + 1))::BIGINT),
p AS (SELECT doc_id, list({{'l': array_to_string(run[1:place], ''), 'r': array_to_string(run[place + 2:], '')}} ORDER BY tree, level) AS proof FROM a GROUP BY 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(proof, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
 list_reduce(list_prepend({{'l': shown, 'r': ''}}, coalesce(proof, [])), lambda x, y: {{'l': sha256(y.l || x.l || y.r), 'r': ''}}).l AS folded_root, folded_root = root AS verified
FROM l JOIN s USING (kin) LEFT JOIN p USING (doc_id), r
"""


@query("op12_merkle_manifest", MANIFEST)
def _(spark, d):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return merkle.manifest(documents(spark, d), tampered)


SPELLING = f"""
WITH RECURSIVE {CRC}, t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
h AS (SELECT run, c, {checksum("concat(doc_id, ':', run)")} AS h FROM (SELECT doc_id, run, count(*) AS c FROM t GROUP BY ALL), crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND n >= 3),
o AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
m AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS one, substr(word, 1, i) || substr(word, i + 2) AS less FROM o),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM m a JOIN m b USING (one) WHERE a.word <> b.word UNION SELECT a.word, a.n, w.word, w.n FROM m a JOIN w ON less = w.word
 UNION SELECT w.word, w.n, a.word, a.n FROM m a JOIN w ON less = w.word),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS best, max(m) AS m FROM p GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN best END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM f UNION ALL SELECT c.word, coalesce(f.form, f.word), f.form IS NULL FROM c JOIN f ON c.root = f.word WHERE NOT done)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN c ON f.word = c.word AND done
"""


@query("op13_spelling_variants", SPELLING)
def _(spark, d):
    return spelling.spelling_groups(documents(spark, d), damage_every=97)
