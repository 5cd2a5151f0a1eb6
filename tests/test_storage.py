"""Tables, commits, restarts, streams."""

import pytest

from chronolane.operators import rollup
from chronolane.requests import Aggregate, Compare, Downsample, Latest, TimeRange
from chronolane.sources import generator, textrows
from chronolane.sources.generator import telemetry
from chronolane.sources.storage import TsCatalog, TsTable, bucket_of
from chronolane.streaming import append_closed, downsample_stream, ingest, latest_stream
from chronolane.types import Aggregator, ColumnType, CompareOp
from tests.conftest import rows_of

COLUMNS = {"col1": ColumnType.INTEGER, "col2": ColumnType.DOUBLE, "col3": ColumnType.STRING}
SCHEMA = "vin string, ts bigint, col1 int, col2 double, col3 string"
A, B = "12345678912345678", "98765432123456789"


def test_write_restart_overwrite(spark, folder):
    t = TsCatalog(spark, folder).create_table("smoke", COLUMNS, buckets=4)
    t.write(spark.createDataFrame([(A, 1, 123, 1.23, "FGH")], SCHEMA))
    again = TsCatalog(spark, folder).table("smoke")
    assert rows_of(again.latest(Latest.of([A]))) == [(123, 1.23, "FGH", 1, A)]
    assert again.time_range(TimeRange(A, 1, 2)).count() == 1
    again.write(spark.createDataFrame([(A, 1, 321, 1.23, ""), (B, 1, 1, 0.0, "x"), (B, 2, 2, 0.0, "x"), (B, 3, 3, 0.0, "x")], SCHEMA))
    assert rows_of(again.read([A])) == [(321, 1.23, "", 1, A)]
    assert sorted(r.ts for r in again.time_range(TimeRange(B, 1, 3)).collect()) == [1, 2]
    before = rows_of(again.read())
    again.compact()
    assert rows_of(TsTable(spark, f"{folder}/smoke").read()) == before and len(again.snapshot().batches) == 1
    assert again.aggregate(Aggregate(B, 0, 9, "col1", Aggregator.MAX)).first().col1 == 3
    assert again.downsample(Downsample(B, 0, 4, "col2", Aggregator.AVG, 2)).count() == 2
    assert again.stored_bytes() > 0


def test_order_within_a_batch_and_tags(spark, folder):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS, buckets=2)
    rows = spark.createDataFrame([(A, 1, i, 0.0, "x", 10 - i) for i in range(5)], SCHEMA + ", no int")
    t.write(rows, sequence="no")
    assert t.read().first().col1 == 0
    assert t.write(rows, tag="b1") is not None and t.write(rows, tag="b1") is None
    assert t.read().first().col1 == 4  # the last of the batch in its own order


def test_refusals(spark, folder):
    c = TsCatalog(spark, folder)
    t = c.create_table("t", COLUMNS)
    with pytest.raises(FileExistsError):
        c.create_table("t", COLUMNS)
    with pytest.raises(KeyError):
        c.table("unknown")
    with pytest.raises(FileNotFoundError):
        TsCatalog(spark, folder + "/nothing")
    with pytest.raises(ValueError):
        t.write(spark.createDataFrame([(A, 1)], "vin string, ts bigint"))
    with pytest.raises(TypeError):
        t.write(spark.createDataFrame([(A, 1, "a", 1.0, "x")], "vin string, ts bigint, col1 string, col2 double, col3 string"))
    with pytest.raises(Exception, match="null in col2"):
        t.write(spark.createDataFrame([(A, 1, 1, None, "x")], SCHEMA))
    assert t.read().count() == 0 and c.tables() == ["t"]  # a failed write leaves nothing visible


def test_buckets_are_pruned(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    t = TsCatalog(spark, folder).create_table("t", COLUMNS, buckets=4)
    t.write(spark.createDataFrame([(A, 1, 1, 0.0, "x"), (B, 1, 1, 0.0, "x")], SCHEMA))
    plan = t.time_range(TimeRange(A, 0, 5))._jdf.queryExecution().executedPlan().toString()
    assert "_bucket#" in plan and "PartitionFilters: [" in plan and str(bucket_of(A, 4)) in plan
    assert "EqualTo(vin," in plan or "In(vin," in plan


def test_rollup_follows_writes(spark, folder):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS)
    t.write(spark.createDataFrame([(A, i, i, 0.5, "x") for i in range(10)], SCHEMA))
    assert t.build_rollup(4).count() == 3 and t.rollup(4) is not None
    t.write(spark.createDataFrame([(A, 99, 1, 0.5, "x")], SCHEMA))
    assert t.rollup(4) is None


def test_aggregate_uses_the_rollup(spark, folder):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS)
    t.write(spark.createDataFrame([(v, i * 10, i, i / 4, "x") for v in (A, B) for i in range(1000)], SCHEMA))
    t.compact()
    asks = [Aggregate(A, lo, hi, c, how) for lo, hi in ((0, 10_000), (5, 4444), (2500, 5000), (7, 9), (20_000, 30_000)) for c in ("col1", "col2") for how in Aggregator]
    plain = [t.aggregate(x).first() for x in asks]
    t.build_rollup()
    fast = [t.aggregate(x) for x in asks]
    assert "rollup" in str(fast[0].inputFiles())
    assert [f.first() for f in fast] == plain


def test_text_rows(spark, folder):
    df = spark.createDataFrame([(A, 1, -2147483648, 0.1 + 0.2, 'a"b,\n'), (B, 2, 0, float("-inf"), "")], SCHEMA)
    textrows.export_rows(df, f"{folder}/csv")
    assert rows_of(textrows.import_rows(spark, f"{folder}/csv", df.schema)) == rows_of(df)


def test_generator(spark):
    df = telemetry(spark, vins=3, rows_per_vin=100)
    assert df.count() == 300 and df.select("vin", "ts").distinct().count() == 300 and len(df.columns) == 62
    assert df.select("SOC").distinct().count() > 100 and df.select("YXMS").distinct().count() == 4
    asks = [next(g) for g in (generator.time_range_requests(), generator.aggregate_requests(), generator.downsample_requests())]
    assert asks == [next(g) for g in (generator.time_range_requests(), generator.aggregate_requests(), generator.downsample_requests())]
    assert [a.upper - a.lower for a in asks] == [300_000, 10_800_000, 3_600_000]


# ---- writers and maintenance beside each other
def put(spark, t, value, *, at=1):
    return t.write(spark.createDataFrame([(A, at, value, 0.0, "x")], SCHEMA))


def during(monkeypatch, t, method, what):
    """Runs ``what`` once, just before the table's ``method`` is called the next time."""
    real, left = getattr(t, method), [what]

    def hooked(*args, **kw):
        if left:
            left.pop()()
        return real(*args, **kw)

    monkeypatch.setattr(t, method, hooked)


def test_compaction_inside_a_write_loses_nothing(spark, folder, monkeypatch):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS, buckets=2)
    other = TsTable(spark, t.path)
    put(spark, t, 1)
    put(spark, t, 2)
    during(monkeypatch, t.versions, "change", lambda: other.compact())  # the rows are written, not yet committed
    put(spark, t, 3)
    assert [r.col1 for r in t.read().collect()] == [3]
    t.compact()
    assert [r.col1 for r in other.read().collect()] == [3]


def test_write_inside_a_compaction_stays_newer(spark, folder, monkeypatch):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS, buckets=2)
    other = TsTable(spark, t.path)
    put(spark, t, 1)
    put(spark, t, 2, at=2)
    during(monkeypatch, t.versions, "change", lambda: put(spark, other, 9))
    t.compact()
    assert sorted((r.ts, r.col1) for r in t.read().collect()) == [(1, 9), (2, 2)]
    during(monkeypatch, t.versions, "change", lambda: other.compact())
    assert t.compact() is None  # the other was faster
    assert sorted((r.ts, r.col1) for r in t.read().collect()) == [(1, 9), (2, 2)]


def test_a_read_uses_one_snapshot(spark, folder, monkeypatch):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS, buckets=2)
    other = TsTable(spark, t.path)
    for i in range(3):
        put(spark, t, i)
    during(monkeypatch, t, "segments", lambda: other.compact())
    assert [r.col1 for r in t.read().collect()] == [2]


def test_streams_dont_shadow_each_other(spark, folder):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS)
    for i, name in enumerate(("a", "b")):
        spark.createDataFrame([(A, i, i, 0.5, name)], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")
        stream = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).parquet(f"{folder}/{name}")
        ingest(stream, t, f"{folder}/ck-{name}").awaitTermination()
    assert t.read().count() == 2
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/a")
    ingest(stream, t, f"{folder}/ck-new").awaitTermination()  # begun anew: taken, not skipped
    assert len(t.snapshot().batches) == 3


def test_replay_after_compaction_is_skipped(spark, folder):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS)
    rows = lambda v: spark.createDataFrame([(A, 1, v, 0.5, "x")], SCHEMA)
    t.write(rows(1), tag="one", transaction=("w", 0))
    t.write(rows(2), transaction=("w", 1))
    t.compact()
    assert t.write(rows(1), transaction=("w", 0)) is None and t.write(rows(1), tag="one") is None
    assert t.write(rows(1), transaction=("w", 1)) is None and t.write(rows(5), transaction=("w", 2)) is not None
    assert t.read().first().col1 == 5


def test_vacuum_keeps_what_is_live(spark, folder):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS)
    for i in range(4):
        put(spark, t, i)
    t.build_rollup(4)
    t.compact()
    assert t.rollup(4) is not None  # the rows are the same
    assert t.vacuum() == 0 and t.vacuum(older_than_s=-5) == 4
    assert [r.col1 for r in TsTable(spark, t.path).read().collect()] == [3] and t.rollup(4).count() == 1


def test_dictionary_grows_and_survives(spark, folder):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS)
    t.write(spark.createDataFrame([(v, 1, 1, 0.0, "x") for v in ("m", "z")], SCHEMA))
    assert rows_of(t.dictionary()) == [("m", 0), ("z", 1)]
    t.write(spark.createDataFrame([(v, 1, 1, 0.0, "x") for v in ("a", "z", "q")], SCHEMA))
    assert rows_of(TsTable(spark, t.path).dictionary()) == [("a", 2), ("m", 0), ("q", 3), ("z", 1)]
    assert rows_of(t.dictionary()) == rows_of(TsTable(spark, t.path).dictionary())


def test_point_lookup_and_compression(spark, folder):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS)
    t.write(spark.createDataFrame([(A, i, i, 0.0, "xyz") for i in range(50)], SCHEMA))
    assert sorted(r.ts for r in t.point(A, [3, 7, 99]).collect()) == [3, 7] and t.point(A, []).count() == 0
    made = t.compression().first()
    assert made.n_rows == 50 and made.raw_bytes == 50 * (17 + 8 + 4 + 8 + 3) and made.stored_bytes == t.stored_bytes()


def test_downsample_uses_the_rollup(spark, folder):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS, buckets=2)
    # ints of a saw, doubles with NaN here and there
    t.write(spark.createDataFrame([(v, i * 10, i // 40 % 7, float("nan") if i % 97 == 0 else i / 4, "x") for v in (A, B) for i in range(1200)], SCHEMA))
    t.compact()
    asks = [
        Downsample(A, lo, hi, c, how, iv, compare, fill)
        for lo, hi, iv in ((0, 12_000, 4000), (5, 9999, 1234), (2500, 5000, 10_000), (7, 9, 1), (50_000, 60_000, 7))
        for c in ("col1", "col2")
        for how in Aggregator
        for compare in (None, Compare(CompareOp.GREATER, 4), Compare(CompareOp.EQUAL, 3))
        for fill in ("omit", "fill")
    ][::9]
    plain = [rows_of(t.downsample(x)) for x in asks]
    t.build_rollup(20)
    zones = t.rollup(20)
    assert [rows_of(rollup.downsample_from_zones(t.read([A], x.lower, x.upper), zones, x)) for x in asks] == plain
    t.build_rollup()
    assert [rows_of(t.downsample(x)) for x in asks[:4]] == plain[:4]


def test_only_cut_blocks_are_read(spark, folder):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS, buckets=2)
    t.write(spark.createDataFrame([(A, i, i // 100, 0.0, "x") for i in range(1000)], SCHEMA))
    t.compact()
    zones = t.build_rollup(50)
    ask = Downsample(A, 0, 1000, "col1", Aggregator.MAX, 500, Compare(CompareOp.EQUAL, 3))
    undecided = zones.where("vin = 'x'")
    assert rollup.raw_ranges(undecided, 0, 1000) == []
    fast = rollup.downsample_from_zones(t.read([A], 0, 1000), zones, ask)
    assert rows_of(fast) == [(-2147483648, 500, A), (3, 0, A)]
    assert not any("/data/" in f for f in fast.inputFiles())  # every block decides: no raw row is read
    part = Downsample(A, 0, 1000, "col1", Aggregator.MAX, 490)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = rollup.downsample_from_zones(t.read([A], 0, 1000), zones, part)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,450)" in plan and "LessThanOrEqual(ts,499)" in plan


def test_late_rows_and_closed_windows(spark, folder):
    files_in = f"{folder}/in"
    spark.createDataFrame([(A, i * 1000, i, float(i), "x") for i in range(20)], SCHEMA).coalesce(1).write.parquet(f"{files_in}/1")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(files_in)
    windows = downsample_stream(stream, "col2", 5000, "1 second")
    append_closed(windows, f"{folder}/out", f"{folder}/ck").awaitTermination()
    closed = lambda: sorted((r.ts, r.n) for r in spark.read.parquet(f"{folder}/out").collect())
    assert closed() == [(0, 5), (5000, 5), (10_000, 5)]  # the last window is still open
    spark.createDataFrame([(A, 1, 1, 1.0, "late"), (A, 19_500, 1, 1.0, "x"), (A, 40_000, 1, 1.0, "x")], SCHEMA).coalesce(1).write.parquet(f"{files_in}/2")
    append_closed(windows, f"{folder}/out", f"{folder}/ck").awaitTermination()
    assert closed() == [(0, 5), (5000, 5), (10_000, 5), (15_000, 6)]


def test_streams(spark, folder):
    t = TsCatalog(spark, folder).create_table("t", COLUMNS)
    one = spark.createDataFrame([(A, i * 1000, i, float(i), "x") for i in range(20)], SCHEMA)
    one.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(one.schema).parquet(f"{folder}/in")
    ingest(stream, t, f"{folder}/ck").awaitTermination()
    ingest(stream, t, f"{folder}/ck").awaitTermination()  # nothing new
    assert t.read().count() == 20 and len(t.snapshot().batches) == 1
    q = latest_stream(stream).writeStream.format("memory").queryName("latest_mem").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("latest_mem").first().col1 == 19
    q = downsample_stream(stream, "col2", 5000, "1 second", anchor_ms=2000).writeStream.format("memory").queryName("down_mem").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.ts: (r.avg, r.n) for r in spark.table("down_mem").collect()}
    assert got[2000] == (4.0, 5) and sum(n for _, n in got.values()) == 20
