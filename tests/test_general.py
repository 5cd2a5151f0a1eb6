"""The general data-processing operators against brute force on small, awkward inputs."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from chronolane.operators import grid, ordered, redelivery, rolling, sessions, spikes
from tests.conftest import rows_of

HOT = "H" * 17
DAY = 86_400_000


def vin(rng, n=4):
    """One source holds a third of all rows and more."""
    return HOT if rng.random() < 0.4 else f"V{rng.randrange(n):016d}"


# ---- ordered helpers
def test_positions_and_lags(spark):
    rng = random.Random(1)
    keys = sorted({(vin(rng), rng.randrange(-3 * DAY, 9 * DAY)) for _ in range(700)})
    df = spark.createDataFrame([(v, t, float(i)) for i, (v, t) in enumerate(keys)], "vin string, ts bigint, x double").repartition(5)
    by = defaultdict(list)
    for i, (v, t) in enumerate(keys):
        by[v].append((t, float(i)))
    pos = {(r.vin, r.ts): r._pos for r in ordered.positions(df).collect()}
    lag = {(r.vin, r.ts): [x.x for x in r._lag] for r in ordered.lagged(df, ["x"], depth=3).collect()}
    for v, seq in by.items():
        for i, (t, _) in enumerate(seq):
            assert pos[v, t] == i
            assert lag[v, t] == [x for _, x in reversed(seq[max(0, i - 3) : i])]


# ---- 2
MESSAGE = "row_id bigint, vin string, ts bigint, recv_at timestamp_ntz, batch_id bigint, batch_pos int, row_no int, _best string"


def messages(rng, n):
    at = [datetime(2024, 5, 1) + timedelta(hours=7 * i) for i in range(30)]
    out = []
    for i in range(n):
        b = rng.randrange(30)
        v = rng.choice([None, " ab ", "AB", "ab", HOT, f"v{rng.randrange(40)}"])
        out.append((i, v, rng.choice([None, rng.randrange(5) * DAY, -1, 17]), at[b] if b else None, b * 7 % 11, rng.choice([None, i]), 1, "x"))
    return out


@pytest.mark.parametrize("slices", [1, 2, 5])
def test_repeated_rows(spark, slices):
    rows = messages(random.Random(slices), 600)
    df = spark.createDataFrame(rows, MESSAGE)
    best = {}
    low = lambda x: (x is not None, x)
    for r in rows:
        if r[1] is not None and r[2] is not None:
            k, rank = (r[1].strip().lower(), r[2]), (low(r[3]), low(r[4]), low(r[5]), r[0])
            best[k] = max(best.get(k, (rank, r[0])), (rank, r[0]))
    keep = {i for _, i in best.values()} | {r[0] for r in rows if r[1] is None or r[2] is None}
    found = redelivery.repeats(df.repartition(3), slices, blocks=64, pieces=3).collect()
    assert {r.how for r in found} == {"batch", "log"}
    got = [r.row_id for r in found]
    assert len(got) == len(set(got)) and set(got) == {r[0] for r in rows} - keep
    assert {r.row_id for r in redelivery.once_each(df, slices).collect()} == keep
    assert redelivery.repeated_rows(df.limit(0)).count() == 0


def ids(spark, *ranges, at=0):
    """Messages of these ranges of numbers, delivered in batch ``at``."""
    n = [i for r in ranges for i in r]
    when = datetime(2024, 5, 1) + timedelta(hours=at)
    return spark.createDataFrame([(at * 10**6 + i, f"v{i}", i * 1000, when, at, i, 1, "x") for i in n], MESSAGE)


def test_filter_passes_few_new_identifiers(spark, folder):
    store = redelivery.MessageStore(spark, folder, blocks=512)
    assert store.ingest(ids(spark, range(2000))).count() == 0
    assert store.ingest(ids(spark, range(2000, 4000), range(100), at=1)).count() == 100
    log = store._log(store.versions.read()[1]["batches"])
    assert 100 <= log.where("_maybe").count() < 300  # of 4100; no repeat is missed
    assert store.words(store.versions.read()[1]["batches"]).count() <= 512


def test_store_is_reopened(spark, folder, monkeypatch):
    redelivery.MessageStore(spark, folder, blocks=64).ingest(ids(spark, range(50)))
    one, two = redelivery.MessageStore(spark, folder), redelivery.MessageStore(spark, folder)
    assert one.blocks == 64
    assert sorted(r.row_id for r in one.ingest(ids(spark, range(40, 60), at=2)).collect()) == list(range(40, 50))
    # late batch: what it brings is older than what is kept
    late = ids(spark, range(45, 70), at=1).collect()
    real, left = two.versions.commit, [lambda: one.ingest(ids(spark, range(65, 67), at=3))]

    def slow(number, state):
        if left:
            left.pop()()
        return real(number, state)

    monkeypatch.setattr(two.versions, "commit", slow)
    got = two.ingest(spark.createDataFrame(late, MESSAGE))
    assert sorted(r.row_id for r in got.collect()) == [10**6 + i for i in (*range(45, 60), 65, 66)]


def test_a_message_repeated_without_end(spark):
    rows = [(i, "hot", 5, datetime(2024, 5, 1) + timedelta(minutes=i % 7), i % 7, i, 1, "x") for i in range(900)]
    found = redelivery.repeats(spark.createDataFrame(rows, MESSAGE).repartition(4)).collect()
    assert len(found) == 899 and {r.row_id for r in found} == set(range(900)) - {895}
    assert sum(r.how == "log" for r in found) <= 7 * 8  # one row per delivery batch and chunk is sent


# ---- 3
TRIP = "vin string, ts bigint, recv_at timestamp_ntz, rlxhl int, zdl double, _first int, n int"


def trips(rng, n):
    out = []
    for _ in range(n):
        t = rng.choice([None, rng.randrange(-DAY, 20 * DAY), rng.randrange(90 * DAY, 130 * DAY)])
        r = (rng.choice([None, HOT, HOT, "b", "c"]), t, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(900)), rng.choice([None, 5, 2**31 - 1, -3]), rng.choice([None, 0.1, 0.7, float("nan"), float("inf"), 1e300]), 1, 2)
        out += [r, (*r[:2], r[2] + timedelta(days=rng.randrange(9)), *r[3:])] if rng.random() < 0.3 else [r]
    return out


def totals_by_hand(rows):
    days = defaultdict(lambda: defaultdict(list))
    for v, t, r, z in {(r[0], r[1], r[3], repr(r[4])) for r in rows}:
        if v is not None and t is not None:
            days[v][math.floor(t / DAY)].append((r, eval(z, {"nan": math.nan, "inf": math.inf})))
    want = {}
    for v, by in days.items():
        for d in range(min(by), max(by) + 1):
            row = []
            for p in (7, 30):
                cells = [x for e in range(d - p + 1, d + 1) for x in by.get(e, [])]
                rs = [r for r, _ in cells if r is not None]
                zs = [z for _, z in cells if z is not None and math.isfinite(z)]
                row += [len(cells), float(sum(rs)), sum(rs) / len(rs) if rs else None, math.fsum(zs), math.fsum(zs) / len(zs) if zs else None]
            before, after = max(e for e in by if e <= d), min(e for e in by if e >= d)
            want[v, d] = (*row, max(after - before - 1, 0))
    return want


def totals_of(r):
    return [x for p in (7, 30) for x in (r[f"n_{p}"], r[f"sum_rlxhl_{p}"], r[f"avg_rlxhl_{p}"], r[f"sum_zdl_{p}"], r[f"avg_zdl_{p}"])] + [r.gap_days]


@pytest.mark.parametrize("slices", [1, 2, 5])
def test_rolling_totals(spark, slices):
    rows = trips(random.Random(slices), 120)
    df, want = spark.createDataFrame(rows, TRIP), totals_by_hand(rows)
    got = rolling.rolling_totals(df, "recv_at", slices).collect()
    assert {(r.vin, r.day_no) for r in got} == set(want)
    for r in got:
        assert totals_of(r) == pytest.approx(list(want[r.vin, r.day_no]), abs=1e-6), (r, want[r.vin, r.day_no])
    quiet = {(r.vin, r.day_no, r.trail_days) for r in rolling.quiet_days(df, "recv_at", slices=slices).collect()}
    assert quiet == {(v, d, p) for (v, d), w in want.items() for p, n in ((7, w[0]), (30, w[5])) if n == 0 and w[-1] < 50}


def test_measures_of_any_size_count(spark):
    """Nothing is dropped or rounded, and a large amount leaves nothing behind when it expires."""
    rows = [("a", d * DAY, None, 1, z, 1, 2) for d, z in ((0, 1e33), (0, -3e307), (3, 1e-7), (4, 2e-7), (8, 1.23456789), (45, 5e-324))]
    df = spark.createDataFrame(rows, TRIP)
    want = totals_by_hand(rows)
    for r in rolling.rolling_totals(df).collect():
        have, right = ([-1 if x is None else x for x in xs] for xs in (totals_of(r), want[r.vin, r.day_no]))
        assert have == pytest.approx(right, rel=1e-12, abs=0)
    assert want["a", 7][3] == pytest.approx(3e-7) and want["a", 45][3] == 5e-324


def test_state_is_advanced_from_a_stored_version(spark, folder, monkeypatch):
    rows = sorted((r for r in trips(random.Random(5), 150)), key=lambda r: r[2])
    frame = lambda part: spark.createDataFrame(part, TRIP)
    first = rolling.RollingTable(spark, folder)
    assert first.advance(frame(rows[:60]), "recv_at") == 1
    again = rolling.RollingTable(spark, folder)  # from the path alone
    assert again.advance(frame(rows[60:]), "recv_at") == 2
    assert again.advance(frame(rows[20:90]), "recv_at") == 2  # nothing new: no new version
    got = {(r.vin, r.day_no): totals_of(r) for r in rolling.with_quiet_days(first.read()).collect()}
    want = totals_by_hand(rows)
    assert set(got) == set(want) and all(got[k] == pytest.approx(list(want[k]), abs=1e-6) for k in want)
    # a correction rewrites the blocks of the dates it reaches and no others
    before = first.versions.read()[1]["totals"]
    late = ("b", 110 * DAY, rows[-1][2], 77, 0.5, 1, 2)
    # and if another writer commits meanwhile, both count
    other = ("c", 111 * DAY, rows[-1][2], 78, 0.5, 1, 2)
    real, left = again.versions.commit, [lambda: first.advance(frame([other]), "recv_at")]

    def slow(number, state):
        if left:
            left.pop()()
        return real(number, state)

    monkeypatch.setattr(again.versions, "commit", slow)
    assert again.advance(frame([late]), "recv_at") == 4
    after = first.versions.read()[1]["totals"]
    assert {d for d in after if after[d] != before.get(d)} == {"3", "4"} and len(after) > 2
    want = totals_by_hand([*rows, late, other])
    got = {(r.vin, r.day_no): totals_of(r) for r in rolling.with_quiet_days(first.read()).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(list(want[k]), abs=1e-6) for k in want)


def test_rolling_of_nothing(spark):
    assert rolling.rolling_totals(spark.createDataFrame([], TRIP), "recv_at").count() == 0


# ---- 4
def sensor_rows(rng, n):
    """Random walks with spikes as close as may be, ramps, frozen stretches, and several readings at one time."""
    out, level = [], defaultdict(lambda: 50.0)
    for i in range(n):
        v = vin(rng, 2)
        at = (i - i % 3 if rng.random() < 0.2 else i) * 1000
        off = 90 + rng.random() if rng.random() < 0.12 else 0
        level[v] = min(max(level[v] + rng.choice([0, 0.5, -0.5, 1]), 20), 60) if 400 > i or i > 420 else level[v] + 9
        r = (v, at, rng.choice([level[v] + off / 3, None, float("nan"), 120.0, level[v] + off / 3]), round(300 + rng.random(), 2) + off, 7.0 if 50 < i % 200 < 170 else float(i % 13) + off, float("inf") if i % 97 == 0 else 20 + rng.randrange(9) * 0.01, 1, "e")
        out += [r] * rng.choice([1, 1, 1, 2])
    rng.shuffle(out)
    return [*out, (None, 1, 500.0, 1.0, 1.0, 1.0, 1, "e"), ("x", None, 500.0, 1.0, 1.0, 1.0, 1, "e")]


SENSOR = "vin string, ts bigint, soc double, zdy double, zdl double, qddjwd double, part int, kind string"


def implausible_by_hand(rows):
    out = set()
    for j, (f, (lo, hi)) in enumerate(spikes.BOUNDS.items()):
        by = defaultdict(set)
        for r in rows:
            x = r[2 + j]
            if r[0] is not None and r[1] is not None and x is not None and not math.isnan(x):
                by[r[0]].add((r[1], x))
        for v, seq in by.items():
            seq = sorted(seq)
            out |= {(v, t, f) for t, x in seq if not lo <= x <= hi}
            if f != "soc":
                a = 0
                for b in range(1, len(seq) + 1):
                    if b == len(seq) or seq[b][1] != seq[a][1]:
                        if b - a >= 25:
                            out |= {(v, t, f) for t, _ in seq[a:b]}
                        a = b
            course = [(t, x) for t, x in seq if lo <= x <= hi]
            changes = [abs(b[1] - a[1]) for a, b in zip(course, course[1:]) if a[1] != b[1]]
            if not changes:
                continue
            limit = 10 * float(np.median(changes))
            for i in range(1, len(course)):
                for k in (1, 2, 3):
                    if i + k < len(course) and all(abs(x - course[i - 1][1]) > limit and abs(x - course[i + k][1]) > limit for _, x in course[i : i + k]):
                        out |= {(v, t, f) for t, _ in course[i : i + k]}
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("known", [True, False])
def test_implausible(spark, monkeypatch, partitions, known):
    if not known:
        monkeypatch.setattr(spikes, "BROADCAST_SOURCES", -1)
    rows = sensor_rows(random.Random(partitions), 900)
    got = spikes.implausible(spark.createDataFrame(rows, SENSOR), partitions)
    assert {(r.vin, r.ts, r.field) for r in got.collect()} == implausible_by_hand(rows)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_close_excursions_ramps_and_ties(spark, partitions):
    """Readings between two excursions and points of a ramp count by the letter; at one time readings go in order of value."""
    flat = [5.0, 5.1] * 12
    caught = flat[:]
    caught[8] = caught[10] = caught[12] = 99.0
    ramp = [*flat, 50.0, 99.0, 140.0, *flat]
    rows = [("caught", i, None, x, None, None, 1, "e") for i, x in enumerate(caught)] + [("ramp", i, None, x, None, None, 1, "e") for i, x in enumerate(ramp)]
    rows += [("tied", i, 50.0 + i % 3, None, 1.5, None, 1, "e") for i in range(25)] + [("tied", 24, 1.0, None, 1.5, None, 1, "e"), ("tied", 24, 90.0, None, 1.5, 3.0, 1, "e"), ("tied", 12, 50.0, None, -7.0, 2.0, 1, "e")]
    got = {(r.vin, r.ts, r.field) for r in spikes.implausible(spark.createDataFrame(rows, SENSOR), partitions).collect()}
    assert got == implausible_by_hand(rows)
    assert {t for v, t, _ in got if v == "caught"} == {8, 9, 10, 11, 12} and ("tied", 24, "zdl") not in got
    held = [("h", i, None, None, 1.5, float(i), 1, "e") for i in range(25)] + [("h", 24, None, None, 1.5, -1.0, 1, "e")]
    assert sum(r.field == "zdl" for r in spikes.implausible(spark.createDataFrame(held, SENSOR), partitions).collect()) == 25


def test_rolling_median():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 9, 300).astype(float)
    padded = np.r_[[v[0]] * 3, v, [v[-1]] * 3]
    assert (spikes.rolling_median(v) == [np.median(padded[i : i + 7]) for i in range(300)]).all()
    x = np.r_[5e-324, 10.0 ** rng.uniform(-300, 300, 500)]
    low, beyond = spikes.cell_bounds(spikes.cell_of(x), spikes.cell_of(x))
    assert (low <= x).all() and (x < beyond).all() and (beyond[1:] < 1.01 * low[1:]).all()


def test_implausible_corner_cases(spark):
    make = lambda rows: spikes.implausible(spark.createDataFrame(rows, SENSOR))
    assert make([]).count() == 0
    assert make([("a", 1, None, None, None, None, 1, "k")]).count() == 0
    assert rows_of(make([("a", 1, -1.0, None, None, None, 1, "k")]).select("field", "reason")) == [("soc", "bound")]
    frozen = [("a", i, 5.0, 5.0, None, None, 1, "k") for i in range(25)]
    assert {r.field for r in make(frozen).collect()} == {"zdy"} and make(frozen[:24]).count() == 0


def test_median_changes(spark):
    rng = random.Random(3)
    data = {v: [abs(rng.gauss(0, 10**k)) + 1e-9 for _ in range(m)] for k, (v, m) in enumerate([("a", 101), ("b", 100), ("c", 1), ("d", 2)])}
    flat = [(v, "f", x, 1, int(spikes.cell_of(np.array([x]))[0])) for v, xs in data.items() for x in xs]
    df = spark.createDataFrame(flat, "vin string, field string, v double, n bigint, cell bigint")
    middle = spikes.middle_cells(df)
    near = df.join(middle, ["vin", "field"]).where("cell = low OR cell = high").select("vin", "field", "v", "n")
    got = {r.vin: r["median"] for r in spikes.exact_medians(near, middle).collect()}
    assert got == pytest.approx({v: float(np.median(xs)) for v, xs in data.items()})


# ---- 5
@pytest.mark.parametrize("slices", [1, 2, 4])
def test_sessions(spark, slices):
    rng = random.Random(slices)
    rows = [(rng.choice([None, HOT, HOT, "b", "c"]), rng.choice([None, rng.randrange(-DAY, 4 * DAY), 1_800_000 * rng.randrange(90)]), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(99)), 1) for _ in range(500)]
    rows += [(HOT, 5, None, 1)] * 20
    df = spark.createDataFrame(rows, "vin string, ts bigint, recv_at timestamp_ntz, n_rows int")
    want = set()
    for v in {r[0] for r in rows if r[0]}:
        t = sorted(r[1] for r in rows if r[0] == v and r[1] is not None)
        a = 0
        for b in range(1, len(t) + 1):
            if b == len(t) or t[b] - t[b - 1] > sessions.GAP_MS:
                want.add((v, t[a], t[b - 1], t[b - 1] - t[a], b - a))
                a = b
    assert {tuple(r) for r in sessions.sessions(df, arrival="recv_at", slices=slices).collect()} == want


def test_session_table_bridges_and_versions(spark, folder):
    t = sessions.SessionTable(spark, folder, gap_ms=10, buckets=4)
    put = lambda *ts: t.apply(spark.createDataFrame([("a", x) for x in ts], "vin string, ts bigint"))
    assert put(0, 20, 100) == 1 and t.read().count() == 3
    assert put(10) == 2
    assert rows_of(t.read()) == [(1, 100, 100, "a"), (3, 0, 20, "a")]
    assert t.apply(spark.createDataFrame([], "vin string, ts bigint")) == 2


def test_a_batch_rewrites_only_the_folders_it_reaches(spark, folder):
    t = sessions.SessionTable(spark, folder, gap_ms=10_000, buckets=2, period_ms=DAY)
    put = lambda *ts: t.apply(spark.createDataFrame([(v, x) for v in ("a", "b") for x in ts], "vin string, ts bigint"))
    put(*(d * DAY + 5 for d in range(10)))
    before = t.versions.read()[1]["dirs"]
    put(4 * DAY + 500_000)
    after = t.versions.read()[1]["dirs"]
    changed = {n for n in after if after[n] != before.get(n)}
    assert {int(n) % sessions.PERIODS for n in changed} == {4} and len(changed) < len(after)
    assert t.read().count() == 22
    # a session from one day into the next is found from either side
    put(6 * DAY - 3000, 6 * DAY + 3000)
    assert t.apply(spark.createDataFrame([("a", 6 * DAY - 12_000)], "vin string, ts bigint")) == 4
    assert t.read().where(f"vin = 'a' AND ts_from = {6 * DAY - 12_000}").first().n_rows == 4
    assert t.vacuum(10**6) == 0 and t.vacuum(-5) > 0 and t.read().count() == 22


def test_two_session_writers(spark, folder, monkeypatch):
    one, two = (sessions.SessionTable(spark, folder, gap_ms=10, buckets=2) for _ in range(2))
    put = lambda t, *ts: t.apply(spark.createDataFrame([("a", x) for x in ts], "vin string, ts bigint"))
    put(one, 0, 100)
    real, left = two.versions.commit, [lambda: put(one, 10**9, 107)]

    def late(number, state):
        if left:
            left.pop()()  # the other writer commits between this one's reading and committing
        return real(number, state)

    monkeypatch.setattr(two.versions, "commit", late)
    assert put(two, 115, 5) == 3
    assert rows_of(one.read()) == rows_of(two.read()) == [(1, 10**9, 10**9, "a"), (2, 0, 5, "a"), (3, 100, 115, "a")]


# ---- 6
def test_grid(spark):
    rng = random.Random(6)
    rows = []
    for v in (HOT, "b", "c"):
        t = 0
        for _ in range(120 if v == HOT else 30):
            t += rng.choice([1, 999, 30_000, 60_000, 61_000, 400_000, 5_000_000])
            rows.append((v, t - 7_000_000, datetime(2024, 1, 1, rng.randrange(24)), rng.choice([1.5, 2.0, 99.0, None, float("nan"), float("-inf")]), 1))
    rows += [(r[0], r[1], r[2] + timedelta(hours=30), 7.0, 1) for r in rows[::9]] + [(None, 1, None, 1.0, 1), ("b", None, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "vin string, ts bigint, recv_at timestamp_ntz, soc double, v int")
    got = {(r.vin, r.slot_ts): r for r in grid.regular_grid(df, "soc", arrival="recv_at").collect()}
    want = {}
    for v in (HOT, "b", "c"):
        best = {}
        for r in rows:
            if r[0] == v and r[1] is not None and r[3] is not None and math.isfinite(r[3]):
                best[r[1]] = max(best.get(r[1], (r[2], r[3])), (r[2], r[3]))
        seq = sorted((t, x[1]) for t, x in best.items())
        first, last = seq[0][0] // 60_000, seq[-1][0] // 60_000
        for m in range(first, last + 1):
            a, b = m * 60_000, (m + 1) * 60_000
            n = sum(a <= t < b for t, _ in seq)
            parts = []
            for i, (t, x) in enumerate(seq):
                end = min(t + 300_000, seq[i + 1][0] if i + 1 < len(seq) else b)
                parts.append((max(0, min(end, b) - max(t, a)), x))
            w = sum(p for p, _ in parts)
            want[v, a] = (n, sum(p * x for p, x in parts) / w if w else None, w / 60_000)
    assert set(got) == set(want)
    for k, (n, x, w) in want.items():
        r = got[k]
        assert (r.n_readings, r.coverage) == (n, pytest.approx(w)) and (r.value is None if x is None else r.value == pytest.approx(x))
        assert r.status == ("measured" if n else "filled" if w else "missing")
    empty = {k for k, (n, _, _) in want.items() if not n}
    assert {tuple(r) for r in grid.missing_slots(df, "soc", arrival="recv_at", absence_slots=10**9).collect()} == empty
    few = {tuple(r) for r in grid.missing_slots(df, "soc", arrival="recv_at", absence_slots=60).collect()}
    runs = {k for k in empty if got[k].gap_slots < 60}
    assert few == runs and 0 < len(few) < len(empty)
    assert grid.regular_grid(df.limit(0), "soc").count() == 0


def test_one_wrong_time_makes_no_giant_row(spark):
    far = 400 * 365 * DAY
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 180_000, 2.0), ("a", 180_000 + 5000 * 60_000, 2.0), ("b", 0, 1.0), ("b", far, 1.0)], "vin string, ts bigint, soc double")
    got = grid.missing_slots(df, "soc").collect()
    assert sorted((r.vin, r.slot_ts) for r in got) == [("a", 60_000), ("a", 120_000)]
    assert grid.regular_grid(df.where("vin = 'a'"), "soc").where("n_readings = 0").count() == 2 + 4999
