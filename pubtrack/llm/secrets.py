"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of a text is addressed by the hash of its content. The ledger lists the (blob, rule,
rule version) triples already scanned with their findings. A scan visits only the triples that are
missing, once per blob however many paths share it, and joins the findings back to all paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubtrack.llm.common import shared_table, span_array, span_text, texts_of

LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("version", T.IntegerType()),
                       T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


@dataclass(frozen=True)
class Rule:
    """A named, versioned pattern; ``least`` is the least length of the value (``value`` picks it)."""

    name: str
    version: int
    pattern: str
    least: int = 0
    value: str | None = None

    def spans(self, text: Column) -> Column:
        """Spans of the valid matches; failing matches are dropped and not retried."""
        found = span_array(text, self.pattern)
        if self.value:
            found = F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], self.value, 1)) >= self.least)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


# The kinds in their order. A maximal run that is too short fails as a whole, so its
# least length can stand in the pattern of the last two.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""", 12,
         r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$"""),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}+"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{16,}+"),
)


def scan_new(paths: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """New ledger rows for the (blob, rule, version) triples of ``paths`` (blob, text) not in ``ledger``.

    Equal blobs are reduced to one text inside every map task and then per blob, so a text that a third of
    all paths share is scanned once and never gathered.
    """
    wanted = F.array(*[F.lit(rule.name) for rule in rules])
    if ledger is not None:
        names = {rule.name: rule.version for rule in rules}
        current = ledger.where(" OR ".join(f"(rule = '{n}' AND version = {v})" for n, v in names.items()))
        done = current.groupBy("blob").agg(F.collect_set("rule").alias("done"))  # at most one entry per rule
        paths = paths.join(done, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    else:
        paths = paths.withColumn("todo", wanted)
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    found = F.array(*[F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"),
                               F.when(F.array_contains("todo", rule.name), rule.spans(F.col("text"))).alias("spans")) for rule in rules])
    # A blob that is scanned for the first time has a row for every rule, found or not.
    return blobs.select("blob", F.explode(found).alias("f")).select("blob", "f.*").where("spans IS NOT NULL")


def scan_secrets(documents: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, identity: str = "doc_id",
                 text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of every document row, and the grown ledger.

    The findings have ``doc_id``, ``blob`` and ``spans``, an array of (start, rank, kind, end) in code
    points by start and then kind. Null or empty text has no spans; a null identity, repeated rows and
    repeated identities keep one row each; an empty table gives no rows; other columns are not read.

    ``ledger`` is what an earlier call returned (None at first). A rule with a new version is scanned
    again on every blob, all others only on blobs not seen before.
    """
    paths = texts_of(documents, identity, text).withColumn("blob", F.sha2("text", 256))
    fresh = shared_table(scan_new(paths, ledger, rules), "ledger")
    grown = fresh if ledger is None else ledger.select(*LEDGER.names).unionByName(fresh)
    rank = {rule.name: (i, rule.version) for i, rule in enumerate(rules)}
    current = grown.where(" OR ".join(f"(rule = '{n}' AND version = {v})" for n, (_, v) in rank.items())).where(F.size("spans") > 0)
    place = F.element_at(F.create_map(*[F.lit(x) for n, (i, _) in rank.items() for x in (n, i)]), F.col("rule"))
    by_blob = current.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), place.alias("rank"), F.col("rule").alias("kind"), s["end"].alias("end")))))).alias("spans"))
    # Stored first, so that the join with the paths has two plain shuffles and Spark can split a popular blob.
    by_blob = shared_table(by_blob, "findings")
    return paths.select("doc_id", "blob").join(by_blob, "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", F.array().cast(by_blob.schema["spans"].dataType)).alias("spans")), grown


def findings_digest(findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts by kind, digest and text of the spans, per document row."""
    show = F.concat_ws(",", F.transform("spans", lambda s: span_text(s["kind"], s["start"], s["end"])))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return findings.select("doc_id", *[count(rule.name) for rule in rules], F.sha2(show, 256).alias("base_sha256"), show.alias("spans"))
