"""Rows that every operator must survive."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType())])
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(n))


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd white space and characters."""
    long, passage = prose(1, 6000), prose(2, 80)
    return [(1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "en", "a"), (4, long, "en", "a"), (5, long.upper(), "de", "b"), (5, long, "de", "b"),
            (6, passage, "en", "a"), (6, passage, "en", "a"), (7, prose(3, 60) + "\n" + passage + " " + prose(4, 60), "de", "b"),
            (None, passage, None, "c"), (None, None, None, None), (8, prose(5, 40) + "  " + passage, None, "a"), (9, "one two", "en", "b"), (10, "ONE two", "en", "b"),
            (11, "É é ß 漢字 😀 \x1c\x85​ <|endoftext|>", "fr", "é"), (12, passage + " tail", "en", "a"), (13, "a" * 3000, "en", "a"), (14, "12 !!", "en", "a")]
