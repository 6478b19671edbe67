"""Queries of the operators that use DataFrame functions only, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubtrack.llm import chat, mixing, privacy, secrets
from pubtrack.llm.registry import documents, query


@query("op1_personal_data")
def _(spark, d):
    return privacy.spans_digest(privacy.find_personal_data(documents(spark, d)))


MIX = """
WITH RECURSIVE z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(concat('mix:', doc_id)) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM z GROUP BY source),
w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS whole FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (whole - 2 * coalesce(sum(source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM o),
t AS (SELECT *, least(2.0::DOUBLE * source_size, (SELECT arg_min(level, (ratio, place)) FROM l WHERE level <= ratio) * weight) AS target FROM o),
q AS (SELECT z.*, t.source_size, t.target, t.place, sum(size) OVER (PARTITION BY t.place ORDER BY digest, size, doc_id) AS served FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, size, (served + p * source_size)::DOUBLE / target AS finish, place, digest FROM q, (VALUES (0), (1)) v(p) WHERE size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, place, digest, size, doc_id) AS until FROM e),
k AS (SELECT doc_id, count(*) AS times FROM c WHERE until <= (SELECT CAST(floor(1.5 * sum(size)) AS BIGINT) FROM z) GROUP BY 1)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.times, 0) * q.size AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id)
"""


@query("op2_source_mix", MIX)
def _(spark, d):
    return mixing.mix_sources(documents(spark, d)).select("doc_id", "size", "source_size", "target", "taken")


def split_spans(kind, pattern, least):
    """SQL that lists the spans of one kind from the pieces between the matches."""
    return f"""SELECT doc_id, '{kind}' AS kind, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(m[i]) AS n
FROM (SELECT doc_id, m, p, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM documents WHERE regexp_matches(text, '{pattern}')))
WHERE {least}"""


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
VALUE = ASSIGN.replace("[A-Za-z0-9+/_.=-]+", "([A-Za-z0-9+/_.=-]+)")
SECRETS = f"""
WITH f AS ({split_spans('assign', ASSIGN, f"length(regexp_extract(m[i], '{VALUE}', 1)) >= 12")} UNION ALL
{split_spans('access', 'AKIA[A-Z0-9]+', 'length(m[i]) >= 18')} UNION ALL {split_spans('hex', '[0-9a-f]+', 'length(m[i]) >= 16')}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(concat(kind, ':', a, ':', a + n), ',' ORDER BY a, list_position(['assign', 'access', 'hex'], kind)) AS spans FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)
"""


@query("op7_secret_scan", SECRETS)
def _(spark, d):
    # Two scans of a growing table: the second one visits only what the ledger of the first does not list.
    rows = documents(spark, d)
    _, ledger = secrets.scan_secrets(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))
    findings, _ = secrets.scan_secrets(rows, ledger)
    return secrets.findings_digest(findings)


CHAT = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
 VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(replace(replace(text, '\\', '\\s'), '<', '\\l')) + length(replace(replace(role, '\\', '\\s'), '<', '\\l')) + 8 AS n FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS turns,
 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


@query("op8_chat_examples", CHAT)
def _(spark, d):
    given = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    return chat.chat_digest(chat.prefix_examples(given.unionByName(extra)))
