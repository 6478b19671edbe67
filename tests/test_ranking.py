from pyspark.sql import functions as F

from pubtrack.operators import ranking

MEMBERS = "specialty string, block string, list_number long, name string, source_id string"


def test_insertion_between_reviewed_neighbours(table):
    base = table([("597", "I", 25000070, "A", "208095"), ("597", "I", 25000090, "C", "208095"), ("597", "II", 25000010, "D", "208095")], MEMBERS)
    change = table([("597", "I", 25000080, "B", "208379")], MEMBERS)
    rows = ranking.apply_insertions(base, change, "specialty", "block", F.col("block"), "list_number", "name", "source_id").orderBy("rank").collect()
    assert [r["list_number"] for r in rows] == [25000070, 25000080, 25000090, 25000010]
    assert [r["rank"] for r in rows] == [1, 2, 3, 4]
    assert [r["source_id"] for r in rows][:3] == ["208095", "208379", "208095"]


def test_insertions_fail_closed(table):
    base = table([("597", "I", 10, "A", "s"), ("597", "I", 30, "C", "s")], MEMBERS)
    changes = table([("597", "I", 30, "x", "t"), ("597", "IX", 20, "x", "t"), ("597", "I", 20, "x", "t"), ("597", "I", 40, "x", "t"),
                     ("597", "I", 25, "x", "t"), ("597", "I", 25, "y", "t")], MEMBERS)
    verdicts = {(r["block"], r["list_number"]): r["verdict"] for r in ranking.check_insertions(base, changes, ["specialty", "block"], "list_number").collect()}
    assert verdicts == {("I", 30): "already_present", ("IX", 20): "unknown_block", ("I", 20): "bracketed", ("I", 40): "edge", ("I", 25): "repeated_insertion"}


def test_insertion_at_the_end_of_a_block_precedes_the_next(table):
    base = table([("1", "69", 10, "A", "s"), ("1", "70", 5, "B", "s")], MEMBERS)
    change = table([("1", "69", 99, "C", "t")], MEMBERS)
    rows = ranking.apply_insertions(base, change, "specialty", "block", F.col("block").cast("int"), "list_number", "name", "source_id")
    assert [r["name"] for r in rows.orderBy("rank").collect()] == ["A", "C", "B"]


def test_inclusion_needs_adjacent_neighbours(table):
    base = table([("597", "I", n, "A", "s") for n in (10, 20, 30)], MEMBERS)
    wanted = table([("597", "I", 15, 10, 20), ("597", "I", 25, 10, 30), ("597", "I", 26, 20, 30)], "specialty string, block string, list_number long, b long, a long")
    got = {r["list_number"]: r["verdict"] for r in ranking.check_inclusions(base, wanted, ["specialty", "block"], "list_number", "b", "a").collect()}
    assert got == {15: "proven", 25: "neighbours_differ", 26: "proven"}


def test_corrections_need_one_matching_member(table):
    base = table([(1, "Ana", ["a"]), (2, "Luz", ["b"]), (3, "Luz", ["b"])], "number long, name string, codes array<string>")
    changes = table([("c1", 1, "Ana", "b"), ("c2", 2, "Luz", "a"), ("c3", 9, "Ana", "c"), ("c4", 1, "Ana", "a")], "change_id string, number long, name string, code string")
    corrected, outcomes = ranking.apply_corrections(base, changes, "number", "name", "codes")
    assert {r["change_id"]: r["outcome"] for r in outcomes.collect()} == {"c1": "applied", "c2": "ambiguous_member", "c3": "ambiguous_member", "c4": "already_present"}
    assert {r["number"]: r["codes"] for r in corrected.collect()} == {1: ["a", "b"], 2: ["b"], 3: ["b"]}


def test_repeated_numbers_in_two_blocks_and_specialties(table):
    base = table([("s1", "1", 7, "A", "s"), ("s1", "2", 7, "B", "s"), ("s2", "1", 7, "C", "s")], MEMBERS)
    ranks = ranking.ordinal_rank(base, ["specialty"], [F.col("block"), F.col("list_number")]).orderBy("name").collect()
    assert [r["rank"] for r in ranks] == [1, 2, 1]
    bad = ranking.order_violations(table([(1, 5), (2, 5), (3, 9)], "pos int, n long").withColumn("g", F.lit(1)), ["g"], [F.col("pos")], "n")
    assert [r["pos"] for r in bad.collect()] == [2]
