import random

import pytest
from pyspark.sql import functions as F

from pubtrack.functions import text
from pubtrack.operators import search


def brute(corpus, queries, cap, page):
    hits, outcome = {}, {}
    for number, q in queries:
        words = [w for w in __import__("re").split(r"[^0-9a-z]+", q) if w]
        long_words = {w for w in words if len(w) >= 3}
        candidates = [(i, s) for i, s in corpus if all(w in s for w in long_words)]
        good = sorted(i for i, s in candidates if all(s.count(w) >= words.count(w) for w in words))
        broad = len(candidates) > cap
        outcome[number] = (len(candidates), "too_broad" if broad else "ok", len(good) > page)
        hits[number] = good[:page]
    return hits, outcome


@pytest.mark.parametrize("broadcast_rows, short_list", [(1000, 4096), (1000, 0), (0, 4096)])
def test_all_access_paths_equal_brute_force(table, monkeypatch, broadcast_rows, short_list):
    monkeypatch.setattr(search, "SHORT_LIST", short_list)
    rng = random.Random(5)
    names = ["martinez", "carlos", "lopez", "ana", "garcia", "alvaro", "eva"]
    corpus = [(i, " ".join(rng.choice(names) for _ in range(rng.randrange(1, 5)))) for i in range(300)]
    queries = [(1, "tinez carlos"), (2, "martinez martinez"), (3, "alv"), (4, "zzzzzz"), (5, "ana eva ana"), (6, "garcia"), (7, "lopez an")]
    frame = table(corpus, "id long, t string")
    parsed = search.parse_queries(table(queries, "q long, text string"), "q", "text")
    hits, outcomes = search.search_names(frame, "id", "t", parsed, "q", [F.col("id")], page=10, broad=80, broadcast_rows=broadcast_rows)
    want_hits, want_outcome = brute(corpus, queries, 80, 10)
    got = {n: [] for n, _ in queries}
    for row in hits.orderBy("q", "position").collect():
        got[row["q"]].append(row["id"])
    assert got == want_hits
    assert {r["q"]: (r["candidates"], r["outcome"], r["more"]) for r in outcomes.collect()} == want_outcome
    assert any(o[1] == "too_broad" for o in want_outcome.values()) and any(o[2] for o in want_outcome.values())


def test_query_grammar(table):
    rows = [("ab",), ("a b c",), ("25000020",), ("one two three four five six seven",), ("50% off",), ("ALVAREZ",), ("ab cd",), ("x" * 101,)]
    kinds = [r["kind"] for r in search.parse_queries(table([(i, *r) for i, r in enumerate(rows)], "i int, q string"), "i", "q", 6, 100).orderBy("i").collect()]
    assert kinds == ["invalid", "too_short", "number", "invalid", "invalid", "name", "too_short", "invalid"]
    kinds = [r["kind"] for r in search.parse_queries(table([(i, *r) for i, r in enumerate(rows)], "i int, q string"), "i", "q").orderBy("i").collect()]
    assert kinds == ["invalid", "too_short", "number", "name", "invalid", "name", "too_short", "name"]


def test_rarest_probe_gram(table):
    parsed = search.parse_queries(table([(1, "abcdef xyz")], "q int, t string"), "q", "t")
    assert parsed.first()["grams"] == ["abc", "bcd", "def", "xyz"]
    sizes = table([("abc", 5), ("bcd", 2), ("def", 9), ("xyz", 7)], "gram string, posting_size long")
    assert tuple(search.rarest_gram(parsed, "q", sizes).first()) == (1, "bcd", 2)


def test_trigrams_of_long_and_short_texts(table):
    frame = table([("ab",), ("abc",), ("aaaa",), ("a\nbc",), ("ñandú",)], "t string")
    got = [r[0] for r in frame.select(text.trigrams(F.col("t"))).collect()]
    assert got == [[], ["abc"], ["aaa"], ["a\nb", "\nbc"], ["ñan", "and", "ndú"]]


def test_folding_and_titles(table):
    frame = table([("  Núñez   Ávila\tŁ ",), ("ﬁn ①",)], "t string")
    rows = frame.select(text.fold_upper(F.col("t")), text.fold_exact("t")).collect()
    assert rows[0][0] == "NUNEZ AVILA Ł" and rows[0][1] == "NUNEZ AVILA Ł" and rows[1][1] == "FIN 1"
    titles = table([("IES SAN JUAN DE LA CRUZ",), ("EDUCACION FISICA (INGLES)/FRANCES",), ("CEIP VIRGEN DEL CARMEN II",), ("MUSICA Y DANZA",)], "t string")
    assert [r[0] for r in titles.select(text.display_title(F.col("t"))).collect()] == [
        "IES San Juan de La Cruz", "Educación Física (Inglés)/Francés", "CEIP Virgen del Carmen II", "Música y Danza"]
    split = table([("IES SOL (LORCA) · LORCA",), ("EOI MURCIA",)], "t string").select(text.split_destination(F.col("t")).alias("s")).select("s.*")
    assert [tuple(r) for r in split.collect()] == [("IES Sol", "Lorca"), ("EOI Murcia", "")]


def test_natural_order(table):
    frame = table([("a10",), ("a9",), ("a09b",), ("b1",)], "t string")
    assert [r[0] for r in frame.orderBy(text.natural_key(F.col("t")), "t").collect()] == ["a9", "a09b", "a10", "b1"]


def test_natural_order_has_no_longest_number(table):
    values = ["x" + "9" * 40, "x1" + "0" * 40, "x" + "0" * 50 + "7", "x8"]
    frame = table([(v,) for v in values], "t string")
    assert [r[0] for r in frame.orderBy(text.natural_key(F.col("t"))).collect()] == [values[2], "x8", values[0], values[1]]


def test_spanish_order(table):
    frame = table([(v,) for v in ["Oz", "Ñu", "Nz", "Nuzar", "n\u0303a", "Núa", "nu 10", "nu 9"]], "t string")
    assert [r[0] for r in frame.orderBy(text.spanish_key(F.col("t"))).collect()] == ["nu 9", "nu 10", "Núa", "Nuzar", "Nz", "n\u0303a", "Ñu", "Oz"]


def test_search_form_equals_full_decomposition(table):
    import unicodedata
    covered = [chr(c) for c in [*range(0xA1, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]]
    # Letters that Latin case mapping itself expands or that have no ASCII form stay with the exact function.
    plain = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    rows = [(c,) for c in covered if plain(c).isascii() and plain(c).strip() == plain(c) != ""]
    frame = table(rows, "t string").select("t", text.fold_upper(F.col("t")).alias("a"), text.fold_exact(F.col("t")).alias("b"))
    assert len(rows) > 500 and frame.where("a <> b").count() == 0
    assert table([("Mª 1º ﬁn",)], "t string").select(text.fold_upper(F.col("t"))).first()[0] == "MA 1O FIN"


def test_cursors_get_their_pages_in_one_job(table):
    from pubtrack.operators import filters

    rows = table([(s, i, f"n{i}") for i, s in enumerate("aabbbccdde" * 3)], "seg string, id long, name string")
    order = ["seg", "id"]
    keys = sorted((s, i) for i, s in enumerate("aabbbccdde" * 3))
    # Cursors at rows, between rows, before the first and at the last one.
    asked = [(1, "g2", "q", *keys[3]), (2, "g2", "q", "b", 3_000), (3, "g2", "q", "", 0), (4, "g2", "q", *keys[-1]), (5, "g1", "q", *keys[0]), (6, "g2", "q", *keys[5]), (7, "g2", "q", *keys[3])]
    frame = table(asked, "cursor long, generation string, query string, seg string, id long")
    signed = frame.withColumn("signature", filters.sign_cursor(F.col("generation"), F.when(F.col("cursor") == 6, "other").otherwise(F.col("query")), [F.col(c) for c in order]))
    pages, outcomes = filters.keyset_pages(rows, order, signed, "cursor", "g2", 4)
    got = {}
    for r in pages.orderBy("cursor", "position").collect():
        got.setdefault(r["cursor"], []).append((r["seg"], r["id"]))
    want = {c: [k for k in keys if k > (s, i)][:4] for c, g, _, s, i in asked if c not in (5, 6)}
    assert got == {c: page for c, page in want.items() if page}
    assert {r["cursor"]: (r["outcome"], r["more"]) for r in outcomes.collect()} == {
        c: ("stale", False) if c == 5 else ("forged", False) if c == 6 else ("ok", len([k for k in keys if k > (s, i)]) > 4) for c, g, _, s, i in asked}
