import random

from pyspark.sql import functions as F

from pubtrack.operators import diff

SCHEMA = "center string, function string, quantity int, position long"
KEYS = ["center", "function"]


def test_kinds_deltas_and_representative(table):
    before = table([("a", "x", 2, 1), ("a", "x", 1, 2), ("b", "x", 1, 3), ("c", None, 4, 4), ("d", "x", 5, 5)], SCHEMA)
    after = table([("a", "x", 3, 1), ("b", "x", 4, 2), ("c", None, 1, 3), ("e", "x", 1, 4), ("e", "x", 1, 5)], SCHEMA)
    rows = {r["center"]: r for r in diff.snapshot_diff(before, after, KEYS, "quantity", "position").collect()}
    assert set(rows) == {"b", "c", "d", "e"}, "equal totals are no change, even over several rows"
    assert (rows["b"]["kind"], rows["b"]["delta"]) == ("quantity_changed", 3)
    assert (rows["c"]["kind"], rows["c"]["delta"]) == ("quantity_changed", -3)
    assert (rows["d"]["kind"], rows["d"]["after"]) == ("disappeared", 0)
    assert (rows["e"]["kind"], rows["e"]["after_rows"], rows["e"]["first_position"]) == ("appeared", 2, 4)
    full = diff.representative_rows(diff.snapshot_diff(before, after, KEYS, "quantity", "position").where("kind <> 'disappeared'"), after, KEYS, "position")
    assert {r["center"]: r["row_quantity"] for r in full.collect()} == {"b": 4, "c": 1, "e": 1}


def test_difference_is_antisymmetric(table):
    rng = random.Random(1)
    make = lambda: table([(rng.choice("abcdef"), rng.choice("xyz"), rng.randrange(3), i) for i in range(60)], SCHEMA)
    left, right = make(), make()
    delta = lambda a, b: {(r["center"], r["function"]): r["delta"] for r in diff.snapshot_diff(a, b, KEYS, "quantity", "position").collect()}
    forward, backward = delta(left, right), delta(right, left)
    assert forward and forward == {k: -v for k, v in backward.items()}


def test_series_equals_pairs(table):
    rows = [(y, c, "x", (y * 7 + i) % 4, i) for y in (1, 2, 5) for i, c in enumerate("abcab")]
    frame = table(rows, "y int, " + SCHEMA)
    series = diff.snapshot_diff_series(frame, "y", KEYS, "quantity", "position").drop("change_id")
    pair = lambda a, b: diff.snapshot_diff(frame.where(f"y={a}"), frame.where(f"y={b}"), KEYS, "quantity", "position").drop("change_id")
    assert sorted(map(tuple, series.where("y=5").drop("y").collect())) == sorted(map(tuple, pair(2, 5).collect()))
    assert series.where("y=1").count() == 0, "the first publication has nothing to be compared with"


def test_digest_ignores_order_but_counts_copies(table):
    one = table([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (3, "b"), (3, "b")], "doc int, cell string")
    digests = {r["doc"]: r["semantic_sha256"] for r in diff.semantic_digest(one, ["doc"], ["cell"]).collect()}
    assert digests[1] == digests[2] != digests[3]


def test_previous_publication_has_another_process(table):
    rows = [("p1", "A", 1, "approved"), ("p2", "A", 3, "approved"), ("p3", "B", 2, "approved"), ("p4", "C", 9, "draft")]
    frame = table(rows, "id string, process string, at int, status string")
    got = diff.current_and_previous(frame, [], "id", "process", F.col("status") == "approved", [F.col("at")]).first()
    assert (got["current_id"], got["previous_id"]) == ("p2", "p3")


def test_multiset_difference_keeps_copies(table):
    left, right = table([("a",), ("a",), ("b",)], "k string"), table([("a",), ("b",)], "k string")
    assert [tuple(r) for r in diff.multiset_difference(left, right, ["k"]).collect()] == [("a", 2, 1)]
