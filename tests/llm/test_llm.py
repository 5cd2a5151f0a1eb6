"""Training-data operators: SQL where there is one, else brute force, exact invariants and error bounds."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from chronolane.llm import catalogue, mixing, packing, quantiles, runs, spans, tokens
from tests.conftest import compare_with_sql

HOT = "H" * 17
NAN = float("nan")


def test_against_sql(spark, small):
    assert compare_with_sql(spark, small, list(catalogue.SQL)) == []


# ---- 1
def events(rng, n):
    out = []
    for i in range(n):
        v = rng.choice([None, HOT, HOT, HOT, "b", "c"])
        out.append((i, v, rng.choice([7, rng.randrange(60), None if rng.random() < 0.1 else 3]), rng.choice([1, 1, 1, None]), rng.choice([0.0, 0.4, 0.9, None, NAN, float("inf")]), rng.choice(["a", " A ", "a", None, ""]), 1, "x"))
    return out


def runs_by_hand(rows):
    def alike(a, b):
        fold = lambda s: None if s is None else s.strip().lower()
        none = [x is None or math.isnan(x) for x in (a[4], b[4])]
        near = all(none) if any(none) else a[4] == b[4] or abs(a[4] - b[4]) <= 0.5
        return a[3] == b[3] and fold(a[5]) == fold(b[5]) and near

    out = []
    for v in {r[1] for r in rows if r[1]}:
        seq = sorted((r for r in rows if r[1] == v and r[2] is not None), key=lambda r: (r[2], r[0]))
        a = 0
        for b in range(1, len(seq) + 1):
            if b == len(seq) or not alike(seq[b], seq[b - 1]):
                out.append((v, seq[a][2], seq[b - 1][2], b - a))
                a = b
    return sorted(out)


STATUS = "seq bigint, vin string, ts bigint, col1 int, col2 double, col3 string, part int, run string"


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_runs(spark, partitions):
    rows = events(random.Random(partitions), 400)
    got = runs.event_runs(spark.createDataFrame(rows, STATUS), partitions=partitions)
    assert sorted((r.vin, r.ts_from, r.ts_to, r.n_rows) for r in got.collect()) == runs_by_hand(rows)


def test_one_run_over_many_partitions(spark):
    rows = [(i, HOT, 5, 1, 0.1, "x", 1, "x") for i in range(300)]
    got = runs.event_runs(spark.createDataFrame(rows, STATUS), partitions=20).collect()
    assert [(r.ts_from, r.ts_to, r.n_rows) for r in got] == [(5, 5, 300)]
    assert runs.event_runs(spark.createDataFrame([], STATUS)).count() == 0


# ---- 7
AZ = "vin string, ts bigint, a int, d double, n int, level string"


@pytest.mark.parametrize(("fan_in", "chunk"), [(2, 300), (64, 10**6)])
def test_percentiles_within_their_bound(spark, fan_in, chunk):
    rng = random.Random(fan_in)
    rows = []
    for i in range(12_000):
        v = rng.choice([HOT, HOT, "b", None if rng.random() < 0.02 else "c"])
        rows.append((v, rng.choice([rng.randrange(70 * 86_400_000), -5, None if rng.random() < 0.01 else 3]), rng.choice([None, -(2**31), 2**31 - 1, rng.randrange(50), i]), rng.choice([None, NAN, float("-inf"), float("inf"), rng.gauss(0, 1), rng.lognormvariate(0, 4), -3.5]), 1, "x"))
    df = spark.createDataFrame(rows, AZ).repartition(11)
    exact = defaultdict(list)
    for v, t, a, d, *_ in rows:
        if v is None or t is None:
            continue
        for f, x in (("a", None if a == -(2**31) else a), ("d", None if d is None or math.isnan(d) or d == -math.inf else d)):
            if x is not None:
                exact[v, None, f].append(x)
                exact[v, t // 86_400_000, f].append(x)
    got = quantiles.percentiles(df, ["a", "d"], epsilon=0.05, fan_in=fan_in, chunk_rows=chunk).collect()
    assert {(r.vin, r.day_no, r.field) for r in got} == set(exact)
    worst = 0
    for r in got:
        xs = np.sort(np.array(exact[r.vin, r.day_no, r.field], float))
        assert r.n == len(xs) and r.rank_error <= 0.05 * r.n
        for p in quantiles.PROBS:
            rank, q = max(1, math.ceil(p * r.n)), r[quantiles.column_name(p)]
            lo, hi = np.searchsorted(xs, q, "left") + 1, np.searchsorted(xs, q, "right")
            assert lo <= hi, "the answer is a value of the group"
            assert max(0, lo - rank, rank - hi) <= r.rank_error
            worst = max(worst, r.rank_error)
    assert worst > 0 or fan_in > 2
    assert quantiles.percentiles(df.limit(0), ["a"]).count() == 0


def test_merge_keeps_ranks_in_bounds():
    rng = np.random.default_rng(5)
    parts = [np.sort(rng.integers(0, 40, n)).astype(float) for n in (1, 2, 50, 333)]
    made = [quantiles.of_sorted(x, np.array([0]), np.array([len(x)]), 0.1) for x in parts]
    cat = lambda name: np.concatenate([getattr(g, name) for g in made])
    m = quantiles.merge(cat("v"), cat("lo"), cat("hi"), np.array([len(g.v) for g in made]), np.array([len(x) for x in parts]), np.zeros(4, np.int64))
    whole = np.sort(np.concatenate(parts))
    assert m.n.tolist() == [len(whole)] and m.lo[0] == m.hi[0] == 1 and m.lo[-1] == m.hi[-1] == len(whole)
    for v, lo, hi in zip(m.v, m.lo, m.hi, strict=True):
        first, last = np.searchsorted(whole, v, "left") + 1, np.searchsorted(whole, v, "right")
        assert lo <= last and hi >= first and lo <= hi


# ---- 8
def test_tightest_bin_is_found():
    rng = random.Random(2)
    tree, have = packing.OpenBins(37), []
    for i in range(400):
        left = rng.randint(1, 37)
        tree.put(i, left)
        have.append(left)
        size = rng.randint(1, 37)
        want = min((x for x in have if x >= size), default=-1)
        assert tree.tightest(size) == want
        if want > 0 and rng.random() < 0.7:
            tree.take(want)
            have.remove(want)


def test_best_fit_decreasing_by_hand():
    def slow(sizes, capacity):
        left, out = [], {}
        for i in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
            fits = [b for b in range(len(left)) if left[b] >= sizes[i]]
            if not fits:
                left.append(capacity)
                fits = [len(left) - 1]
            tight = min(left[b] for b in fits)
            b = next(b for b in fits if left[b] == tight)
            left[b] -= sizes[i]
            out[i] = b
        return sorted(left)

    rng = random.Random(4)
    for _ in range(20):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 80))]
        placed = packing.best_fit_decreasing(sizes, 50)
        left = defaultdict(lambda: 50)
        for b, s in zip(placed, sizes, strict=True):
            left[b] -= s
        assert sorted(left.values()) == slow(sizes, 50)


def test_boxes(spark, small):
    docs = [(1, "word " * 700, "x"), (2, "", "x"), (3, None, "x"), (4, "short text", "x"), (5, "short text", "x"), (6, "字" * 300, "x")] + [(10 + i, "hello there " * (i % 40 + 1), "x") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, shard string")
    boxes = spark.createDataFrame([("s", 64), ("l", 256), ("none", 0), ("null", None)], "box_kind string, capacity_tokens int")
    rows = packing.pack(df, boxes, shard_rows=60).collect()
    encode = tokens.encoding().encode_ordinary
    count = {i: len(encode(t)) if t else 0 for i, t, _ in docs}
    for kind, capacity in (("s", 64), ("l", 256)):
        mine = [r for r in rows if r.box_kind == kind]
        used, pieces = defaultdict(int), defaultdict(list)
        for r in mine:
            pieces[r.doc_id].append(r)
            if r.box_id is not None:
                used[r.box_id] += r.n_tokens
        assert max(used.values()) <= capacity
        assert {i for i in count if not count[i]} == {r.doc_id for r in mine if r.box_id is None}
        for i, n in count.items():
            p = sorted(pieces[i], key=lambda r: r.piece_no)
            assert len(p) == max(1, -(-n // capacity)) and sum(r.n_tokens for r in p) == n
            at = 0
            for r in p:
                assert r.token_from == at
                at += r.n_tokens
    assert {r.box_kind for r in rows} == {"s", "l"}
    odd = spark.createDataFrame([(None, "no id", "x"), (2**62 + 1, "big id", "x"), (None, "no id", "x")], df.schema)
    assert sorted((r.doc_id is None, r.doc_id) for r in packing.pack(odd, boxes).where("box_kind = 's'").collect()) == [(False, 2**62 + 1), (True, None), (True, None)]
    assert packing.pack(df.limit(0), boxes).count() == 0


# ---- 9
def test_positions_invert_the_schedule(spark):
    from pyspark.sql import functions as F

    for w in ([1.0, 1.0], [0.2, 1.8], [2.0, 0.0], [0.0, 1.0, 3.0, 0.5]):
        knots = mixing.integrated(w)
        times = [i / 50 for i in range(51)]

        def area(t, w=w, knots=knots):
            n = len(w) - 1
            j = min(int(t * n), n - 1)
            u = t - j / n
            return knots[j] + w[j] * u + (w[j + 1] - w[j]) * n * u * u / 2

        df = spark.createDataFrame([(t, area(t)) for t in times], "t double, c double")
        arrays = [F.array(*[F.lit(float(x)) for x in a]) for a in (knots, w)]
        for r in df.select("t", mixing.position_of(F.col("c"), *arrays).alias("p")).collect():
            assert r.p == pytest.approx(r.t, abs=1e-6)


def test_mix(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice(["Web", "web ", "WEB", "books", "tiny" if i % 10 == 0 else "web", "other", None]), " ".join(["word"] * rng.randrange(0, 60)), 1) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, position int")
    targets = spark.createDataFrame([("web", 0.5, 1), ("books", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(df, targets).collect()
    uses = defaultdict(list)
    total = defaultdict(int)
    for r in rows:
        uses[r.doc_id].append(r.repeat_no)
        total[r.source] += r.n_tokens
    limit = {"web": 1, "books": 2, "tiny": 4}
    source = {i: (s or "").strip().lower() for i, s, *_ in docs}
    assert all(sorted(u) == list(range(len(u))) and len(u) <= limit[source[i]] for i, u in uses.items())
    for s, x in (("web", 5 / 9), ("books", 3 / 9), ("tiny", 1 / 9)):
        assert total[s] / sum(total.values()) == pytest.approx(x, abs=0.01)
    at = [r.position for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    shares = {r.source: r for r in mixing.mix_shares(df, targets).collect()}
    assert shares["absent"].actual_share == 0 and {s: shares[s].mixed_tokens for s in total} == dict(total)
    # a first third of larger sources, as the default schedule leans
    third = lambda a, b: sum(r.n_tokens for r in rows if a <= r.position < b and r.source == "web") / sum(r.n_tokens for r in rows if a <= r.position < b)
    assert third(0, 1 / 3) > third(2 / 3, 1.1)
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_running_totals_in_buckets(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source", "id % 7 AS n_tokens")
    got = mixing.running_totals(df, "source", F.xxhash64("doc_id"), "n_tokens", bucket_rows=20).withColumn("h", F.xxhash64("doc_id")).collect()
    for s in ("a", "b"):
        total = 0
        for r in sorted((r for r in got if r.source == s), key=lambda r: r.h):
            assert r._before == total
            total += r.n_tokens


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "� \u0000x" * 5)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}
    assert got[1] == len(tokens.encoding().encode_ordinary("hello world")) and got[2] == got[3] == 0 and got[4] > 0


# ---- 10
def texts_for_spans(rng):
    alphabet = "abc äß字🙂 "
    noise = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    core = [noise(n) for n in (199, 200, 201, 260, 700)]
    out = []
    for c in core:
        out += [noise(rng.randrange(150)) + c + noise(rng.randrange(150)) for _ in range(3)]
    for _ in range(12):  # parts of the longest passage, overlapping by more and less than 200
        a = rng.randrange(500)
        out.append(noise(30) + core[-1][a : a + rng.choice([150, 230, 400])] + noise(30))
    out += [core[-1]] * 3 + ["", None, "x" * 5, "ab" * 150, "ab" * 400, "z" * 199, "z" * 230, "z" * 5000, noise(3000) + core[3] + noise(20) + core[1]]
    out += [noise(60).join([core[1][:120], core[1][60:], core[1]]), core[1][:150] + core[2][:150], core[0] + core[1]]
    return out


def common(a, b, k=200):
    if a is None or b is None or min(len(a), len(b)) < k:
        return set()
    return {a[i : i + k] for i in range(len(a) - k + 1)} & {b[i : i + k] for i in range(len(b) - k + 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_spans(spark, seed):
    texts = texts_for_spans(random.Random(seed))
    df = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, rep string")
    want = {(i * 3, j * 3) for i in range(len(texts)) for j in range(i + 1, len(texts)) if common(texts[i], texts[j])}
    got = [tuple(r) for r in spans.sharing_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    share = {r.doc_id: r for r in spans.shared_shares(df).collect()}
    for i, t in enumerate(texts):
        covered = set()
        for j, u in enumerate(texts):
            if i != j:
                hit = common(t, u)
                covered |= {p + q for p in range(len(t or "") - 199) if t[p : p + 200] in hit for q in range(200)}
        assert share[i * 3].shared_chars == len(covered), i
        assert share[i * 3].n_chars == len(t or "")


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.sharing_pairs(df).count() == 0 and spans.shared_shares(df).count() == 0
    short = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id bigint, text string")
    assert spans.sharing_pairs(short).count() == 0 and spans.shared_shares(short).count() == 3


def test_window_hashes_depend_on_content_only():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 0x10FFFF, 5000).astype(np.uint32)
    b = np.concatenate([a[1234:2000], rng.integers(0, 99, 50).astype(np.uint32), a[:900]])
    ha, hb = spans.window_hashes(a, 200), spans.window_hashes(b, 200)
    assert (ha[1234 : 1234 + 567] == hb[:567]).all() and (ha[:701] == hb[816:]).all()
    assert len(np.unique(ha)) == len(ha)


def test_pairs_of_a_hot_group_meet_once(spark):
    members = [("hot", i) for i in range(57)] + [("two", 3), ("two", 9), ("one", 4)]
    df = spark.createDataFrame(members, "k string, rep bigint")
    got = sorted((r.a, r.b) for r in spans._pairs(df, ["k"], block_rows=10).collect())
    assert got == sorted([(i, j) for i in range(57) for j in range(i + 1, 57)] + [(3, 9)])


def test_a_template_in_many_records(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    template, rows = word(260), []
    for i in range(90):
        rows.append((i, word(50) + (template if i % 3 == 0 else word(150)) + word(20), "x"))
    rows += [(90 + i, rows[0][1], "x") for i in range(5)] + [(99, None, "x"), (98, "short", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rep string")
    held = [i for i, t, _ in rows if t and template in t]
    got = {tuple(r) for r in spans.sharing_pairs(df).collect()}
    assert got == {(a, b) for a in held for b in held if a < b}
    links = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in spans.sharing_links(df).collect()}
    assert len(links) == len(rows) and links[0] == links[94] == (0, 6, 29) and links[3] == (3, 1, 29) and links[1] == (1, 1, 0) and links[99] == (99, 1, 0)


def test_digests_are_of_the_characters(spark):
    p = spans._points("aé字🙂" * 100)
    k = spans.digests(p, np.array([0, 4, 1]), np.array([200, 200, 200]))
    assert (k[0] == k[1]).all() and (k[0] != k[2]).any()


# ---- 7 and 8 at their bounds
def test_merging_in_small_stretches(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.choice([HOT, HOT, "b", f"v{rng.randrange(30)}"]), rng.randrange(90 * 86_400_000), rng.randrange(10**6), rng.gauss(0, 1), 1, "x") for _ in range(4000)]
    df = spark.createDataFrame(rows, AZ).repartition(7)
    key = lambda r: (r.vin, r.day_no is not None, r.day_no or 0, r.field)
    want = sorted(quantiles.percentiles(df, ["a", "d"], fan_in=3, chunk_rows=500).collect(), key=key)
    real = quantiles._merging
    monkeypatch.setattr(quantiles, "_merging", lambda steps, whole: _small(real, steps, whole))
    got = sorted(quantiles.percentiles(df, ["a", "d"], fan_in=3, chunk_rows=500).collect(), key=key)
    assert [(key(r), r.n) for r in got] == [(key(r), r.n) for r in want] and all(r.rank_error <= 0.01 * r.n for r in got)
    small = [r for r in got if r.n <= 200]
    assert small and small == [r for r in want if r.n <= 200]


def _small(real, steps, whole):
    """The same merging, a few hundred bytes at a time."""

    def scan(batches):
        from chronolane.llm import quantiles as q

        q.HELD_BYTES = 300
        yield from real(steps, whole)(batches)

    return scan


def test_whole_groups_send_no_ranks():
    v = np.array([1.0, 2.0, 2.0, 5.0, 7.0])
    g = quantiles.of_sorted(v, np.array([0, 3]), np.array([3, 2]), 0.01)
    vs, los, his = g.binary()
    assert [len(x.as_py()) for x in vs] == [24, 16] and [len(x.as_py()) for x in los] == [0, 0] and [len(x.as_py()) for x in his] == [0, 0]
    big = np.arange(1000.0)
    g = quantiles.of_sorted(np.r_[big, v[:3]], np.array([0, 1000]), np.array([1000, 3]), 0.1)
    ranks = np.array([len(x.as_py()) // 8 for x in g.binary()[1]])
    lo = quantiles._full_ranks(np.frombuffer(g.binary()[1][0].as_py(), np.int64), g.sizes, ranks)
    assert (lo == g.lo).all()


def test_shards_are_tasks(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('word ', cast(id % 9 + 1 AS int)) AS text")
    boxes = spark.createDataFrame([("s", 64)], "box_kind string, capacity_tokens int")
    placed = packing.pack(docs, boxes, shard_rows=20)
    assert placed.rdd.getNumPartitions() == 15
    bound = packing.box_bound(placed).collect()
    assert [(r.box_kind, r.within, r.possible) for r in bound] == [("s", True, True)]
