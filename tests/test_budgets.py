import random

from pyspark.sql import functions as F

from pubtrack.operators import budgets, ledger
from pubtrack.operators.budgets import DAY_US
from pubtrack.streaming import timed
from pubtrack.streaming.runtime import ROCKS, drain

DAY = 86_400
BASE = 19_723 * DAY_US


def delayed(rows, budget, most):
    """The budget as statements on a table by day, settlement after settlement."""
    table, events, out, open_ = {}, [], [], {}
    for request, at, wish, end, cost in rows:
        events.append((at, 1, request, wish, None))
        if end is not None:
            events.append((max(end, at + 1), 0, request, wish, wish if cost is None else cost + 32))
    for at, asks, request, wish, charge in sorted(events, key=lambda e: e[:3]):
        day = at // DAY_US
        if asks:
            used, count = table.get(day, (0, 0))
            if day not in table or used + wish <= budget and count < most:
                table[day] = (used + wish, count + 1)
                open_[request] = day
                out.append((request, day, wish, used + wish))
        elif request in open_:
            since = open_.pop(request)
            used, count = table[since]
            table[since] = (max(0, used - wish + charge), count)
            if day != since:
                used, count = table.get(day, (0, 0))
                table[day] = (used + charge, count + 1)
    return sorted(out)


def test_delayed_budget_equals_statements_on_a_table(table):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        at = BASE + rng.randrange(3 * DAY_US)
        rows.append((i, at, rng.choice([100, 900]), rng.choice([None, at, at + rng.randrange(DAY_US)]), rng.choice([None, 5, 400])))
    rows += [(2000 + i, BASE + 9 * DAY_US + i, 99_999, None, None) for i in range(3)]  # only a day's first request fits
    frame = table([("all", *r) for r in rows], "scope string, id long, at long, est long, settled long, act long")
    got = budgets.delayed_budget(frame, ["scope"], "id", "at", "est", "settled", "act", 20_000, 60).collect()
    want = delayed(rows, 20_000, 60)
    assert sorted((r["id"], r["day"], r["est"], r["used"]) for r in got) == want
    # The simple rule, which settles at once, admits others.
    at_once = delayed([(i, at, wish, at, cost) for i, at, wish, _, cost in rows], 20_000, 60)
    assert [w[0] for w in want] != [w[0] for w in at_once] and {w[0] for w in want} & {2000, 2001, 2002} == {2000}


def ledger_log(seed, n, ledgers):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at, key = BASE + rng.randrange(4 * DAY_US), rng.choice(ledgers)
        rows.append((key, i, at, rng.randrange(20, 90), None))
        if rng.random() < 0.8:
            rows.append((key, i, at + rng.choice([10**9, 4 * 10**9, rng.randrange(2 * DAY_US)]), None, rng.choice([None, rng.randrange(200)])))
    return rows


LOG = "ledger string, id long, at long, reserved long, written long"


def book(rows, limit, lease, overhead=8):
    """The ledger as statements on tables of reservations and allocations."""
    out = []
    for key in {r[0] for r in rows}:
        held, charged = {}, {}
        for _, i, at, wish, written in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[3] is not None, r[1])):
            today = at // DAY_US

            def usage():
                carried = sum(r["wish"] for j, r in held.items() if not r["settled"] and r["day"] < today <= r["end"] // DAY_US and (j, today) not in charged)
                return sum(c for (_, d), c in charged.items() if d == today) + carried

            if wish is not None:
                fits = usage() + wish <= limit
                if fits:
                    held[i] = {"day": today, "wish": wish, "end": at + lease, "settled": False}
                    charged[i, today] = wish
                out.append((key, i, "admitted" if fits else "refused", today, wish, usage()))
            elif i in held and not held[i]["settled"]:
                r = held[i]
                measured = r["wish"] if written is None else written + overhead
                expired = at >= r["end"]
                actual = max(r["wish"], measured) if expired else measured
                last = r["end"] // DAY_US if expired else today
                entries = {r["day"]: actual} | ({last: actual} if r["day"] < last else {}) | ({today: overhead} if today > last else {})
                charged.update({(i, d): c for d, c in entries.items()})
                r["settled"] = True
                out += [(key, i, "charged", d, c, usage()) for d, c in entries.items()]
    return sorted(out)


def test_write_ledger_equals_statements_on_tables(table):
    rows = ledger_log(3, 700, ["a", "b"])
    got = budgets.write_ledger(table(rows, LOG), "ledger", "at", "id", "reserved", "written", 4_000, 7_200_000_000)
    want = book(rows, 4_000, 7_200_000_000)
    assert sorted(map(tuple, got.collect())) == want
    assert {w[2] for w in want} == {"admitted", "refused", "charged"}


def test_stream_ledger_with_shuffled_files_equals_batch_twin(spark, tmp_path):
    rows = sorted(ledger_log(9, 400, ["hot", "hot", "cold"]), key=lambda r: r[2])
    parts = [rows[i:i + 120] for i in range(0, len(rows), 120)]
    draw = random.Random(1)
    draw.shuffle(parts)
    for part in parts:
        draw.shuffle(part)
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    # A last row far behind closes all of them.
    spark.createDataFrame([("end", 9999, BASE + 40 * DAY_US, 1, None)], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")).withColumn("time", F.timestamp_micros("at")).withWatermark("time", "7 days")
    got = drain(timed.write_ledger_stream(stream, "ledger", "at", "id", "reserved", "written", 4_000, 7_200_000_000), conf=ROCKS).where("ledger <> 'end'")
    want = budgets.write_ledger(spark.createDataFrame(rows, LOG), "ledger", "at", "id", "reserved", "written", 4_000, 7_200_000_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("outcome = 'refused'").count() > 0


def test_split_throttle_equals_throttle(table):
    rng = random.Random(2)
    base = 19_723 * DAY
    log = [("hot", i, base + rng.randrange(3 * DAY)) for i in range(3000)] + [("cold", 5000 + i, base + rng.randrange(9 * DAY)) for i in range(40)]
    log += [("edge", 6000 + i, base + s) for i, s in enumerate((DAY - 10, DAY - 5, DAY + 1, DAY + 100, 3 * DAY - 1, 3 * DAY + 50))] + [("one", 7000, base)]
    frame = table([(s, i, at) for s, i, at in log], "service string, id long, s long")
    for gap, cap in ((300, 40), (600, 1), (60, 10_000)):
        want = ledger.throttle(frame, ["service"], "id", F.col("s"), gap, cap)
        got = budgets.split_throttle(frame, ["service"], "id", F.col("s"), gap, cap)
        columns = ["service", "accepted_second", "id"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
