"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Well-formed identifiers (mail addresses, IP addresses, card and phone numbers) are the seeds. The
words in front of them become lexical patterns. Patterns and the identifier-like values they
introduce form a bipartite graph, on which confidence flows from values to patterns and back for a
fixed number of rounds. Confident patterns then mark values that no seed rule recognises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.llm.common import SPACE, let, shared_table, span_array, span_text, texts_of

# The kinds in their order. Possessive loops find the same matches in linear time and
# constant stack: no character that ends a loop could also continue it.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word with a digit or an at sign: what a pattern may introduce.
VALUE = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: Groups of digits with brackets, hyphens and slashes, a single space or a lone sign between them; letters may lead the first.
GROUP = r"[(\[]?[0-9][0-9()\[\]/.-]*+(?![\p{L}\p{N}@_])"
RUN = rf"(?<![^{SPACE}])(?:[(\[]?[A-Za-z]{{1,4}}+)?+{GROUP}(?:\x20(?:[/-]\x20)?+{GROUP})++"
#: What is cut from the ends of a value; the bracket of a first group in brackets stays.
LEAD = r"^(?![(\[][0-9]++[)\]][^0-9]*+[0-9])[^\p{L}\p{N}+@]+"
EDGE = LEAD + r"|[^\p{L}\p{N}@]+$"
#: A word of a pattern that stands for any identifier: it has a digit or an at sign, or is one itself.
ANY = "#"


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda total, x: total + x) % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    """The condition a match of ``kind`` must meet; failing matches are dropped and not retried."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # A part may have any number of leading zeros.
        return F.forall(F.split(value, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3) & F.forall(
            F.split(value, r"\."), lambda part: F.right(part, F.lit(9)).cast("int") <= 255)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def words_before(left: Column) -> Column:
    """The last two words of what stands before a value, in lower case, whole however long they are; identifiers among them
    are ANY, punctuation next to the value is left out. Empty if there are not two words."""
    text = F.regexp_replace(F.regexp_replace(left, r"[^\p{L}\p{N}@\x01]++$", ""), rf"[{SPACE}]++", " ")
    return let(F.substring_index(text, " ", -2), lambda two: F.when(
        F.instr(two, " ") > 1, F.lower(F.regexp_replace(two, r"[^ 0-9@\x01]*+[0-9@\x01][^ ]*+", ANY))).otherwise(""))


def kind_spans(text: Column, rank: int, kind: str) -> Column:
    """Seed spans of one kind, ``array<struct<rank, kind, start, end, value, pattern>>`` by start; they do not overlap."""
    valid = F.filter(span_array(text, KINDS[kind], left=True), lambda s: is_valid(kind, s["value"]))
    return F.transform(valid, lambda s: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"),
                                                 s["end"].alias("end"), s["value"].alias("value"), words_before(s["left"]).alias("pattern")))


def touched(span, seeds: Column) -> Column:
    """Does one of ``seeds`` (of one kind, by start) overlap the span? The last seed that starts before the span's end is
    found by binary search."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.size(seeds))).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2), e).cast("int"))
    last = F.aggregate(steps, F.lit(0), lambda found, step: F.when(
        (found + step <= F.size(seeds)) & F.coalesce(F.get(seeds, found + step - 1)["start"] < span["end"], F.lit(False)), found + step).otherwise(found))
    return F.when(F.size(seeds) == 0, False).otherwise(F.coalesce(F.get(seeds, last - 1)["end"] > span["start"], F.lit(False)))


def value_spans(text: Column, seeds: list[Column]) -> Column:
    """Identifier-like words and runs of digit groups that no seed touches: an at sign inside or at least six digits."""
    def trimmed(s):
        lead = F.length(F.regexp_extract(s["value"], LEAD, 0))
        value = F.regexp_replace(s["value"], EDGE, "")
        return F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.length(value)).alias("end"), value.alias("value"), s["left"].alias("left"))

    # A word inside a run stays a candidate, as the run may join neighbours that do not belong together.
    words = F.transform(F.concat(span_array(text, VALUE, left=True), span_array(text, RUN, left=True)), trimmed)
    shaped = F.filter(words, lambda s: s["value"].rlike(r".@.") | (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= 6))
    free = F.filter(shaped, lambda s: ~reduce(lambda a, b: a | b, [touched(s, of) for of in seeds]))
    return F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), words_before(s["left"]).alias("pattern")))


def pattern_scores(edges: DataFrame, rounds: int, least_values: int, accept: float) -> DataFrame:
    """Confident (pattern, kind) pairs after ``rounds`` of scoring on the pattern-instance graph.

    ``edges`` holds one row per (pattern, value) with the kind of a seed or null. A pattern's
    confidence in a kind is the mean score of its distinct values for that kind; an unknown value
    scores 1 - prod(1 - confidence) over the accepted patterns that introduce it. Every step is a
    join on the value or the pattern and a sum that combines before the shuffle.
    """
    known = edges.where("kind IS NOT NULL").select("pattern", "value", "kind", F.lit(1.0).alias("score"))
    unknown = edges.where("kind IS NULL").select("pattern", "value")
    sizes = edges.groupBy("pattern").agg(F.count_distinct("value").alias("values"))
    scored, accepted = known, None
    for turn in range(rounds):
        sums = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("support"))
        accepted = (sums.join(sizes, "pattern").withColumn("confidence", F.col("mass") / F.col("values"))
                    .where((F.col("support") >= least_values) & (F.col("confidence") >= accept)).select("pattern", "kind", "confidence"))
        accepted = shared_table(accepted, "patterns")
        if turn + 1 < rounds:
            fresh = unknown.join(accepted, "pattern").groupBy("value", "kind").agg(
                (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
            scored = known.unionByName(unknown.join(fresh, "value").select("pattern", "value", "kind", "score"))
    return accepted


def find_personal_data(documents: DataFrame, identity: str = "doc_id", text: str = "text", rounds: int = 3,
                       least_values: int = 5, accept: float = 0.8) -> DataFrame:
    """One row per document row: ``doc_id``, ``seeds`` and ``found``, arrays of spans
    (``rank, kind, start, end, value``) in code points, end exclusive.

    ``seeds`` are the rule matches; ``found`` are further values that a pattern with at least
    ``least_values`` supporting values and confidence ``accept`` introduces. Null or empty text gives
    empty arrays; a null identity, repeated rows and repeated identities keep one row each; an empty
    table gives no rows; other columns of the input are not read.

    The text is scanned once. What is stored and shuffled afterwards are the spans only.
    """
    rows = texts_of(documents, identity, text).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumns({f"of_{kind}": kind_spans(F.col("text"), rank, kind) for rank, kind in enumerate(KINDS)})
    rows = rows.withColumn("values", value_spans(F.col("text"), [F.col(f"of_{kind}") for kind in KINDS]))
    rows = rows.withColumn("known", F.concat(*[F.col(f"of_{kind}") for kind in KINDS]))
    place = lambda kind: lambda s: F.struct(s["pattern"].alias("pattern"), F.lower(s["value"]).alias("value"), kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    seen = F.concat(F.transform("known", place(lambda s: s["kind"])), F.transform("values", place(lambda s: F.lit(None).cast("string"))))
    seeds = F.transform("known", lambda s: F.struct(*[s[c].alias(c) for c in ("rank", "kind", "start", "end", "value")]))
    stored = shared_table(rows.select("row", "doc_id", seeds.alias("seeds"), seen.alias("seen")), "spans")
    places = stored.select("row", F.inline("seen")).where("pattern <> ''")
    edges = shared_table(places.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "graph")
    accepted = pattern_scores(edges, rounds, least_values, accept)
    rank = reduce(lambda done, k: F.when(F.col("kind") == k[1], k[0]).otherwise(done), enumerate(KINDS), F.lit(len(KINDS)))
    # A pattern accepted for two kinds gives its value the kind it is surer of, then the one listed first.
    best = accepted.withColumn("rank", rank).groupBy("pattern").agg(F.min_by(F.struct("rank", "kind"), F.struct(-F.col("confidence"), "rank")).alias("k"))
    fresh = places.where("kind IS NULL").select("row", "pattern", "value", "start", "end").join(best, "pattern").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("k.rank", "k.kind", "start", "end", "value"))).alias("found"))
    return stored.join(fresh, "row", "left").select(
        "doc_id", "seeds", F.coalesce("found", F.array().cast(fresh.schema["found"].dataType)).alias("found"))


def spans_digest(found: DataFrame) -> DataFrame:
    """The counts, the digest of the seeds and the text of all spans, per document row."""
    show = lambda array: F.concat_ws(",", F.transform(array, lambda s: span_text(s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("seeds", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind in KINDS], F.sha2(show(F.col("seeds")), 256).alias("base_sha256"),
                        show(F.array_sort(F.concat("seeds", "found"))).alias("spans"))
