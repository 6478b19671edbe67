import random

from pyspark.sql import functions as F

from pubtrack.operators import ledger, queues

DAY = 86_400


def greedy(seconds, gap, cap):
    kept, free, day, used = [], 0, None, 0
    for s in sorted(set(seconds)):
        if s // DAY != day:
            day, used = s // DAY, 0
        if s >= free and used < cap:
            kept.append(s)
            free, used = s + gap, used + 1
    return kept


def test_throttle_equals_greedy_over_bitmap_edges(table):
    rng = random.Random(2)
    base = 1_704_067_200
    log = [(i, rng.choice(["hot", "hot", "cold"]), base + rng.randrange(3 * DAY)) for i in range(4000)]
    log += [(5000 + i, "hot", s) for i, s in enumerate((32768, 32769, 32767, 65536, 65537, 98304))]
    got = ledger.throttle(table(log, "id long, service string, s long"), ["service"], "id", F.col("s"), 300, 40).collect()
    for service in ("hot", "cold"):
        rows = [r for r in log if r[1] == service]
        want = greedy([r[2] for r in rows], 300, 40)
        mine = sorted((r["accepted_second"], r["id"]) for r in got if r["service"] == service)
        assert [m[0] for m in mine] == want
        assert all(number == min(r[0] for r in rows if r[2] == second) for second, number in mine)


def test_throttle_cap_and_midnight(table):
    seconds = [DAY - 10, DAY - 5, DAY + 1, DAY + 100]
    requests = table([("g", i, s) for i, s in enumerate(seconds)] + [("h", 9, DAY + 5)], "service string, id long, s long")
    got = ledger.throttle(requests, ["service"], "id", F.col("s"), 60, 1)
    assert {(r["service"], r["accepted_second"]) for r in got.collect()} == {("g", DAY - 10), ("g", DAY + 100), ("h", DAY + 5)}


def test_gate_follows_the_job(table):
    requests = table([(1, 1, 0), (1, 2, 50), (1, 3, 100), (1, 4, 150), (1, 5, 1000), (1, 6, 1900), (2, 7, 0), (2, 8, DAY)], "s long, id long, t long")
    finishes = table([(1, 90), (2, 10), (3, 5)], "s long, t long")
    got = {r["id"]: (r["acquired"], r["job_id"]) for r in ledger.job_throttle(requests, finishes, ["s"], "id", "t", 900, 60, 2).collect()}
    # 3: cooldown since 90; 5: the job of 4 is past its lease but the day is full.
    assert got == {1: (True, 1), 2: (False, 1), 3: (False, 1), 4: (True, 4), 5: (False, 4), 6: (False, 4), 7: (True, 7), 8: (True, 8)}


def test_budget_equals_sequential_admission(table):
    rng = random.Random(4)
    log = [("hot" if rng.random() < 0.7 else "d2", i, rng.choice([5, 5, 40, 300]), rng.randrange(0, 40)) for i in range(3000)]
    want = []
    for day in ("hot", "d2"):
        used = count = 0
        for d, i, wish, cost in log:
            if d == day and count < 50 and used + wish <= 900:
                used, count = used + cost, count + 1
                want.append((d, i, wish, cost, used))
    frame = table(log, "day string, id long, est long, act long")
    got = ledger.daily_budget(frame, "day", ["id"], "id", "est", "act", 900, 50)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_midnight_is_charged_twice(table):
    admitted = table([("2026-01-01", "2026-01-01", 5), ("2026-01-01", "2026-01-02", 7)], "day string, settled string, act long")
    got = {r["day"]: (r["used"], r["requests"]) for r in ledger.settled_usage(admitted, "day", "settled", "act").collect()}
    assert got == {"2026-01-01": (12, 2), "2026-01-02": (7, 1)}


def test_open_reservation_reaches_the_next_day_until_charged(table):
    day = "cast(day as date) as day"
    reservations = table([("a", "2026-01-01", 10, False), ("b", "2026-01-01", 20, False), ("c", "2026-01-01", 40, True)],
                         "reservation_id string, day string, reserved long, settled boolean").selectExpr("reservation_id", day, "reserved", "settled")
    leases = table([("a", "2026-01-02"), ("b", "2026-01-02"), ("c", "2026-01-02")], "reservation_id string, expires_day string").selectExpr(
        "reservation_id", "cast(expires_day as date) as expires_day")
    allocations = table([("a", "2026-01-01", 10), ("b", "2026-01-02", 25), ("c", "2026-01-01", 33)], "reservation_id string, day string, charged long").selectExpr(
        "reservation_id", day, "charged")
    got = {str(r["day"]): r["writes"] for r in ledger.write_usage(reservations, leases, allocations).collect()}
    assert got == {"2026-01-01": 43, "2026-01-02": 35}


def test_backoff_doubles_to_six_hours(table):
    log = [(i, "r", bad) for i, bad in enumerate([1, 1, 0, 1, 1, 1, 1, 1, 1])]
    frame = queues.failure_streaks(table(log, "at long, r string, bad int"), ["r"], [F.col("at")], F.col("bad") == 1)
    got = [r[0] for r in frame.orderBy("at").select(queues.backoff_seconds(F.col("failures"))).collect()]
    assert got == [3600, 7200, None, 3600, 7200, 14400, 21600, 21600, 21600]


def test_byte_budget_takes_the_shortest_old_prefix(table):
    rows = [(1, "g", 100, 10, False), (2, "g", 100, 10, True), (3, "g", 100, 10, False), (4, "g", 100, 10, False)]
    frame = table(rows, "id long, g string, full long, stub long, keep boolean")
    run = lambda budget: {r["id"]: (r["reduced"], r["fits"]) for r in queues.byte_budget(frame, ["g"], "id", "full", "stub", [F.col("id")], F.col("keep"), budget).collect()}
    assert [k for k, v in run(300).items() if v[0]] and sorted(k for k, v in run(300).items() if v[0]) == [1, 3]
    assert sorted(k for k, v in run(400).items() if v[0]) == []
    assert not any(v[1] for v in run(100).values())


def test_completion_before_the_start_is_no_evidence(table):
    jobs = table([("a", 1_000_000), ("b", 1_000_000), ("c", 1_000_000)], "job string, start long")
    done = table([("a", 500_000), ("a", 2_000_000), ("b", 900_000), ("b", 99_000_000), ("c", 61_000_000)], "job string, finish long")
    got = {r["job"]: (r["job_status"], r["ended_us"]) for r in ledger.lease_outcomes(jobs, done, "job", "start", "finish", 60).collect()}
    assert got == {"a": ("completed", 2_000_000), "b": ("failed", 61_000_000), "c": ("completed", 61_000_000)}


def test_backoff_of_two_transports(table):
    rng = random.Random(6)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([600, 4000, 20_000, 9 * DAY])
        bad = rng.random() < 0.8
        rows.append(("u", i, t, bad, bad and rng.random() < 0.4, rng.random() < 0.5, rng.choice([None, None, 50_000])))
    frame = table(rows, "url string, id long, at long, failed boolean, challenge boolean, browser boolean, retry_after long")
    got = {r["id"]: (r["outcome"], r["failures"], r["next_attempt"]) for r in queues.pruned_backoff(frame, ["url"], "at", "id", "failed", "challenge", "browser", "retry_after").collect()}
    plain, web, want = None, None, {}
    for _, i, now, bad, barred, browser, floor in rows:
        plain, web = [e if e and e["until"] > now - 7 * DAY else None for e in (plain, web)]
        held = plain and plain["until"] > now and not (browser and plain["barred"]) or browser and web and web["until"] > now
        if held:
            want[i] = ("deferred", None, None)
        elif not bad:
            plain, web = None, None if browser else web
            want[i] = ("read", None, None)
        else:
            before = web if browser and barred else plain
            n = min(5, (before["n"] if before else 0) + 1)
            entry = {"n": n, "until": now + max(floor or 0, min(21600, 3600 * 2 ** (n - 1))), "barred": barred}
            plain, web = (plain, entry) if browser and barred else (entry, web)
            want[i] = ("failed", n, entry["until"])
    assert got == want and {w[1] for w in want.values()} >= {1, 2, 3}
