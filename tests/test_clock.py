"""Clock log: fixture cases, and random logs against a plain fold."""

import random


from paceline import schemas
from paceline.operators import clock


def plain_fold(log):
    start, status, offset, out = None, "stopped", 0.0, []
    for ts, _, action, arg in log:
        if action == "start":
            start, status = ts, "running"
        elif action == "stop":
            status = "stopped"
        elif action == "reset":
            start, status, offset = None, "stopped", 0.0
        else:
            offset = arg if start is None else arg - (ts - start) * 1000
        out.append((start, status, offset))
    return out


def random_log(rng, n):
    log, ts = [], 0.0
    for seq in range(n):
        ts += rng.choice([0.0, 1.5, 20.25])
        log.append((ts, seq, rng.choice(["start", "stop", "edit", "edit", "reset"]), float(rng.randint(0, 9) * 1000)))
    return log


def test_fold(rows_of):
    rng = random.Random(2)
    logs = {race: random_log(rng, n) for race, n in ((0, 400), (1, 30), (2, 1))}
    rows = [(race, *e) for race, log in logs.items() for e in log]
    states = clock.fold_clock(rows_of(schemas.CLOCK_EVENT, *rows).repartition(5))
    got = {(r.race_id, r.seq): (r.race_start_s, r.status, r.offset_ms) for r in states.collect()}
    assert got == {(race, i): s for race, log in logs.items() for i, s in enumerate(plain_fold(log))}
    now = {r.race_id: (r.race_start_s, r.status, r.offset_ms) for r in clock.clock_status(rows_of(schemas.CLOCK_EVENT, *rows)).collect()}
    assert now == {race: plain_fold(log)[-1] for race, log in logs.items()}


def test_clock_log(rows_of):
    raw = rows_of(
        "race_id bigint, ts_s double, seq bigint, action string, arg string",
        (0, 1.0, 1, "start", None), (0, 2.0, 2, "edit", "1:2.5"), (0, 3.0, 3, "edit", "250"),
        (0, 4.0, 4, "edit", "x"), (0, 5.0, 5, "edit", None), (0, 6.0, 6, "edit", "-1:0.0"),
    )
    good, bad = clock.clock_log(raw)
    assert {r.seq: r.arg_ms for r in good.collect()} == {1: None, 2: 62050.0, 3: 250.0}
    assert {r.seq: r.error for r in bad.collect()} == {
        4: clock.MSG_BAD_TIME, 5: clock.MSG_NO_TIME, 6: clock.MSG_BAD_TIME,
    }


def test_against_a_plain_machine(rows_of):
    """Any number of commands, null times first, ties to the clock."""
    rng = random.Random(11)
    log = [(race, *e) for race in range(5) for e in random_log(rng, 40 if race else 150)]
    log += [(1, None, 900, "start", None), (2, None, 901, "stop", None)]
    at = [e[1] for e in log]
    events = [(rng.randint(0, 6), None if i % 50 == 0 else rng.choice([t for t in at if t is not None]) + rng.choice([0, 0, 0.5, -1]), i) for i in range(500)]
    clock_rows = rows_of(schemas.CLOCK_EVENT, *log)
    states = {}
    for r in clock.fold_clock(clock_rows).collect():
        states.setdefault(r.race_id, []).append(((r.ts_s is not None, r.ts_s or 0, r.seq), (r.race_start_s, r.status, r.offset_ms)))
    want = {}
    for race, ts, seq in events:
        past = [s for s in sorted(states.get(race, [])) if s[0][:2] <= (ts is not None, ts or 0)]
        want[seq] = past[-1][1] if past else (None, "stopped", 0.0)
    got = clock.apply_clock(rows_of("race_id bigint, ts_s double, seq bigint", *events), clock_rows)
    assert {r.seq: (r.race_start_s, r.status, r.offset_ms) for r in got.collect()} == want


def test_as_of(rows_of):
    log = rows_of(
        schemas.CLOCK_EVENT,
        (0, 5.0, 1, "edit", 3000.0),
        (0, 10.0, 2, "start", None),
        (0, 20.0, 3, "edit", 15000.0),
        (0, 30.0, 4, "stop", None),
        (0, 40.0, 5, "start", None),
        (0, 50.0, 6, "reset", None),
    )
    events = rows_of("race_id bigint, ts_s double, seq bigint", *[(0, float(t), t) for t in (1, 5, 10, 25, 30, 45, 60)], (9, 1.0, 99))
    got = {r.seq: (r.race_start_s, r.status, r.offset_ms) for r in clock.apply_clock(events, log).collect()}
    assert got == {
        1: (None, "stopped", 0.0),
        5: (None, "stopped", 3000.0),
        10: (10.0, "running", 3000.0),
        25: (10.0, "running", 5000.0),
        30: (10.0, "stopped", 5000.0),
        45: (40.0, "running", 5000.0),
        60: (None, "stopped", 0.0),
        99: (None, "stopped", 0.0),
    }
