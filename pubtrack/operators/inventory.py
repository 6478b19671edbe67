"""Reconciliation of discovered documents with reviewed manifests, lineage and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.functions.values import row_text


def reconcile_manifest(reviewed: DataFrame, prior: DataFrame, identity: str, digest: str, supersedes: str) -> DataFrame:
    """Reviewed entries win; changed bytes need the predecessor named; prior-only entries stay."""
    mine = reviewed.select(identity, F.col(digest).alias("_new"), F.col(supersedes).alias("_old"))
    met = mine.join(prior.select(identity, F.col(digest).alias("_prior")), identity, "full")
    outcome = (F.when(F.col("_new").isNull(), "kept_prior").when(F.col("_prior").isNull(), "reviewed")
               .when(F.col("_new") == F.col("_prior"), "unchanged")
               .when(F.col("_old").eqNullSafe(F.col("_prior")), "superseded").otherwise("conflict"))
    return met.select(identity, F.coalesce("_new", "_prior").alias(digest), outcome.alias("outcome"))


def merge_collections(collections: Sequence[DataFrame], identity: str, semantic: Sequence[str],
                      volatile: Sequence[str]) -> DataFrame:
    """Union of collections: entries of one id must agree on all but volatile fields; the later
    collection overrides, and of entries of one collection the largest value. Disagreement is reported as a conflict."""
    parts = []
    for i, collection in enumerate(collections):
        parts.append(collection.select(identity, *semantic, *volatile).withColumn("_at", F.lit(i)))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    text = row_text([F.col(c) for c in semantic])
    # Two equal extremes mean one distinct value: no set is built per id.
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_at", c))).alias(c) for c in [*semantic, *volatile]]
    return union.groupBy(identity).agg(*newest, F.count(F.lit(1)).alias("entries"),
                                       (F.min(text) != F.max(text)).alias("conflict"))


def reviewed_precedence(reviewed: DataFrame, active: DataFrame, identity: str, digest: str, fields: Sequence[str]) -> DataFrame:
    """Reviewed metadata before active metadata; incorporated only with the same hash active."""
    a = active.select(identity, F.col(digest).alias("_a"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    r = reviewed.select(identity, F.col(digest).alias("_r"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    met = r.join(a, identity, "full")
    return met.select(identity, F.coalesce("_r", "_a").alias(digest),
                      *[F.coalesce(f"_r_{f}", f"_a_{f}").alias(f) for f in fields],
                      F.coalesce((F.col("_a") == F.coalesce("_r", "_a")), F.lit(False)).alias("incorporated"))


def upsert_inventory(inventory: DataFrame, observed: DataFrame, identity: str, parent: str, kind: str, seen: str,
                     reviewed_kind: Column | None = None) -> DataFrame:
    """Observed links merged into the known inventory. Returns one row per document; the edges
    live in a bridge table (:func:`merge_edges`), so no parent list grows without bound."""
    # Equal extremes mean a single observed kind.
    fresh = observed.groupBy(identity).agg(
        F.min(kind).alias("_k0"), F.max(kind).alias("_k1"), F.min(seen).alias("_s0"), F.max(seen).alias("_s1"),
        F.bool_or(F.col(kind) == "provisional").alias("_provisional"))
    met = inventory.select(identity, F.col(kind).alias("_old"), "first_seen", "last_seen").join(fresh, identity, "full")
    agreed = F.when(F.col("_k0") == F.col("_k1"), F.col("_k0"))
    merged = (F.when(F.col("_k0").isNull(), F.col("_old")).when(agreed.isNull(), F.lit("unclassified"))
              .when(F.col("_old").isNull() | (F.col("_old") == agreed), agreed).otherwise(F.lit("unclassified")))
    basis = (F.when(F.col("_k0").isNull(), "not_observed").when(merged == "unclassified", "uncertain").otherwise("title_only"))
    if reviewed_kind is not None:
        basis = F.when(reviewed_kind.isNotNull(), "reviewed_metadata").otherwise(basis)
        merged = F.coalesce(reviewed_kind, merged)
    return met.select(identity, merged.alias(kind), basis.alias("classification_status"),
                      F.least("first_seen", "_s0").alias("first_seen"), F.greatest("last_seen", "_s1").alias("last_seen"),
                      F.coalesce("_provisional", F.lit(False)).alias("provisional_observed"))


def merge_edges(known: DataFrame, observed: DataFrame, identity: str, parent: str, seen: str) -> DataFrame:
    """Union of document → parent edges with first and last sighting."""
    return known.select(identity, parent, seen).unionByName(observed.select(identity, parent, seen)).groupBy(
        identity, parent).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def verification_status(fetched: Column, expected: Column, prior: Column, kind: Column, active: Column,
                        prior_status: Column, error: Column) -> Column:
    """State of a document after an attempt to read it. Unknown bytes wait for review."""
    matches = expected.isNotNull() & (fetched == expected)
    provisional = kind == "provisional"
    return (F.when(error == "traversal_limit", "skipped").when(error.isNotNull() | fetched.isNull(), "unavailable")
            .when(matches & F.coalesce(provisional, F.lit(False)), "pending_review")
            .when(matches & F.coalesce(active, F.lit(False)), "incorporated").when(matches, "pending_review")
            .when(expected.isNotNull() | (prior.isNotNull() & (fetched != prior))
                  | (F.coalesce(prior_status, F.lit("")) == "changed"), "changed")
            .otherwise("pending_review"))


def disappeared(known_edges: DataFrame, observed_edges: DataFrame, complete_parents: DataFrame, identity: str,
                parent: str) -> DataFrame:
    """Documents missing from every parent they were known under, provided all those parents were
    read completely. Incomplete parents never prove absence."""
    seen = observed_edges.select(identity, parent).distinct().withColumn("_listed", F.lit(True))
    complete = complete_parents.select(parent).distinct().withColumn("_complete", F.lit(True))
    marked = (known_edges.select(identity, parent).distinct().join(complete, parent, "left")
              .join(seen, [identity, parent], "left"))
    gone = F.col("_complete").isNotNull() & F.col("_listed").isNull()
    per = marked.groupBy(identity).agg(
        F.count(F.lit(1)).alias("parents"), F.count_if(F.col("_complete").isNotNull()).alias("read_parents"),
        F.count_if(gone).alias("missing_parents"))
    still = observed_edges.select(identity).distinct().withColumn("_seen", F.lit(True))
    whole = (F.col("parents") == F.col("read_parents")) & (F.col("missing_parents") == F.col("parents"))
    return per.join(still, identity, "left").select(
        identity, "parents", "read_parents", "missing_parents",
        (whole & F.col("_seen").isNull()).alias("missing_from_index"))


def lineage(edges: Sequence[tuple[DataFrame, str, str]], start: str, end: str) -> DataFrame:
    """Distinct (start, end) pairs over a chain of edge tables ``(table, from, to)``; pairs are
    made distinct after every hop, so a popular parent does not multiply rows."""
    table, source, target = edges[0]
    reached = table.select(F.col(source).alias(start), F.col(target).alias("_at")).distinct()
    for table, source, target in edges[1:]:
        hop = table.select(F.col(source).alias("_at"), F.col(target).alias("_to")).distinct()
        reached = reached.join(hop, "_at").select(start, F.col("_to").alias("_at")).distinct()
    return reached.withColumnRenamed("_at", end)


def expand_frontier(seeds: DataFrame, edges: DataFrame, node: str, source: str, target: str, depth: int) -> DataFrame:
    """Nodes reachable from the seeds within ``depth`` hops with their smallest depth. Each hop
    keeps only nodes not seen before; depth is a small fixed bound."""
    links = edges.select(F.col(source).alias(node), F.col(target).alias("_to")).distinct()
    seen = seeds.select(node).distinct().withColumn("depth", F.lit(0))
    frontier = seen.select(node)
    for level in range(1, depth + 1):
        found = frontier.join(links, node).select(F.col("_to").alias(node)).distinct()
        frontier = found.join(seen.select(node), node, "left_anti")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(level)))
    return seen


def source_coverage(scoped: DataFrame, source: Sequence[str], status: Column, work: Column, reviewed: Column) -> DataFrame:
    """Counts and completeness per source over distinct (source, document) rows."""
    pending = F.count_if(F.coalesce(work != "checked", F.lit(True)))
    unreviewed = F.count_if(~F.coalesce(reviewed, F.lit(False)))
    return scoped.groupBy(*source).agg(
        F.count(F.lit(1)).alias("document_count"), F.count_if(status == "unavailable").alias("failed_documents"),
        F.count_if(status == "skipped").alias("skipped_documents"), pending.alias("pending_documents"),
        unreviewed.alias("unreviewed_documents"), (pending == 0).alias("downloads_complete"),
        ((pending == 0) & (unreviewed == 0)).alias("verification_complete"))


def family_coverage(scoped: DataFrame, registry: DataFrame, family: Sequence[str], source: str, document: str, status: Column,
                    work: Column, reviewed: Column) -> DataFrame:
    """Coverage of every registered family with each document counted once, however many sources of
    the family list it. The distinct step carries only keys and flags, hashes and combines before the
    shuffle; sources are counted on the small registry."""
    flags = scoped.select(*family, document, (status == "unavailable").alias("_f"), (status == "skipped").alias("_s"),
                          F.coalesce(work != "checked", F.lit(True)).alias("_p"),
                          (~F.coalesce(reviewed, F.lit(False))).alias("_u"))
    per_document = flags.groupBy(*family, document).agg(*[F.bool_or(c).alias(c) for c in ("_f", "_s", "_p", "_u")])
    names = {"document_count": F.count(F.lit(1)), "failed_documents": F.count_if("_f"), "skipped_documents": F.count_if("_s"),
             "pending_documents": F.count_if("_p"), "unreviewed_documents": F.count_if("_u")}
    counts = per_document.groupBy(*family).agg(*[c.alias(n) for n, c in names.items()])
    sources = registry.groupBy(*family).agg(F.count(F.lit(1)).alias("source_count"))
    met = sources.join(counts, list(family), "left")
    for name in names:
        met = met.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return met.withColumn("verification_complete", (F.col("pending_documents") == 0) & (F.col("unreviewed_documents") == 0))


def review_complete(documents: DataFrame, announcements: DataFrame, sources: DataFrame, document_ok: Column,
                    announcement_ok: Column, source_ok: Column) -> DataFrame:
    """One row: everything reviewed, only when there is at least one document and nothing is open."""
    def verdict(table: DataFrame, ok: Column, name: str) -> DataFrame:
        return table.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"open_{name}"),
                         F.count(F.lit(1)).alias(f"all_{name}")).withColumn("_one", F.lit(1))

    met = (verdict(documents, document_ok, "documents")
           .join(verdict(announcements, announcement_ok, "announcements"), "_one")
           .join(verdict(sources, source_ok, "sources"), "_one"))
    whole = ((F.col("all_documents") > 0) & (F.col("open_documents") == 0) & (F.col("open_announcements") == 0)
             & (F.col("open_sources") == 0))
    return met.select("open_documents", "open_announcements", "open_sources", whole.alias("review_complete"))


def intake_reason(actual: Column, stated: Column, is_document: Column, matches: Column, pinned_equal: Column) -> Column:
    """Reason a received file stays in quarantine; null when it is validated."""
    return (F.when(actual != stated, "hash_mismatch").when(~is_document, "invalid_document")
            .when(matches > 1, "manifest_conflict").when(matches == 0, "unreviewed_document")
            .when(~F.coalesce(pinned_equal, F.lit(False)), "manifest_mismatch"))


def update_status(kind: Column, reviewed_digest: Column, digest: Column, error: Column) -> Column:
    """Audit status of one observed document against the reviewed list."""
    return (F.when((kind == "provisional") & reviewed_digest.isNotNull(), "classification_conflict")
            .when(kind == "provisional", "not_applicable").when(error.isNotNull(), "unavailable")
            .when(reviewed_digest.isNull(), "pending_review").when(reviewed_digest == digest, "reviewed")
            .otherwise("changed"))


def evidence_status(publications: DataFrame, originals: DataFrame, digest: str, claimed: str) -> DataFrame:
    """Whether the stored original of a publication exists; a false claim is a violation."""
    stored = originals.select(F.col(digest)).distinct().withColumn("_stored", F.lit(True))
    met = publications.join(stored, digest, "left")
    has = F.col("_stored").isNotNull()
    return met.withColumn("evidence_status", F.when(has, "archived").otherwise("original_unavailable")).withColumn(
        "violation", F.coalesce(F.col(claimed), F.lit(False)) & ~has).drop("_stored")


def resolve_provenance(rows: DataFrame, amendment: Column, document: Column, version: Column) -> DataFrame:
    """Source of a fact: its amendment, else its document, else the generation."""
    kind = (F.when(amendment.isNotNull(), "amendment").when(document.isNotNull(), "document").otherwise("version"))
    return rows.withColumn("evidence_kind", kind).withColumn("evidence_id", F.coalesce(amendment, document, version))


def merge_notices(notices: DataFrame, identity: Column, ordinal: str, date: str, pdf: str, title: str) -> DataFrame:
    """One notice per canonical URL: first sighting names it, the first known or first more
    precise date wins, the latest non-empty file list wins."""
    precise = F.length(date) > 10
    date_order = F.struct(F.when(precise, 0).otherwise(1).alias("p"), F.col(ordinal).alias("o"))
    return notices.withColumn("notice_id", identity).groupBy("notice_id").agg(
        F.min_by(title, ordinal).alias(title),
        F.min_by(date, F.when(F.col(date).isNotNull(), date_order)).alias(date),
        F.max_by(pdf, F.when(F.coalesce(F.col(pdf), F.lit("")) != "", F.col(ordinal))).alias(pdf),
        F.count(F.lit(1)).alias("sightings"))
