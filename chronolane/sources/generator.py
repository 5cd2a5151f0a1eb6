"""Seeded synthetic vehicle telemetry, made on the executors, and the request workloads that go with it."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolane.requests import Aggregate, Compare, Downsample, Latest, TimeRange
from chronolane.types import Aggregator, ColumnType, CompareOp

# The vehicle table's columns, in order, and what it holds by default.
INTS = (
    "QZZS ZDWDZXTH JYDZ FDJGZZS QXTZGWD ZGWDZXTH DW QDDJGS QQZGND ZGDYDCDTDH QDDJXH ZDDYDCDTDH DCDC RLDCRLXHL DJKZQDY DCDTDYZGZ "
    "ZGDYDCZXTDH YXMS DWZT RLDCDY QTGZLB QQZGYLCGQDH GYDCDCZT RLDCDL LATITUDE DJKZQDL QXTZGWDTZDH ZDWDTZXH KCDCNZZGZDMLB CDZT "
    "QDDJZS RLXHL QDDJZT LONGITUDE FDJGZLB QDDJGZDMLB DCDTDYZDZ QQZGNDCGQDH LJLC ZDWDZ"
).split()
DOUBLES = "QDDJZJ ZGBJDJ QDDJGZZS ZDL ZDDYDCZXTDH KCDCNZZGZZS SOC ZDY ZGWDTZXH QDDJWD".split()
STRINGS = "CS RLDCTZGS QDDJKZWD FDJZT ZGWDZ CLZT QQZGYL TYBJBZ ORNI JUBK".split()
LONG_STRINGS = {"ORNI": 30, "JUBK": 100}
VINS, ROWS_PER_VIN, START, STEP = 10, 36_000, 16_492_012_515_000, 1000
RANGE_ROWS, AGGREGATE_ROWS, DOWNSAMPLE_ROWS, INTERVAL = 300, 3 * 3600, 3600, 10_000

SCHEMA = {**{c: ColumnType.INTEGER for c in INTS}, **{c: ColumnType.DOUBLE for c in DOUBLES}, **{c: ColumnType.STRING for c in STRINGS}}


def vin_of(number: int) -> str:
    return str(number).zfill(17)


def _text(i: int, length: int, seed: int) -> Column:
    """``length`` hexadecimal digits."""
    parts = [F.md5(F.concat_ws("/", "id", F.lit(f"{seed + i}"), F.lit(f"{k}"))) for k in range(-(-length // 32))]
    return F.substring(F.concat(*parts), 1, length)


def telemetry(spark: SparkSession, vins: int = VINS, rows_per_vin: int = ROWS_PER_VIN, start: int = START, step: int = STEP, seed: int = 42) -> DataFrame:
    """(vin, ts, sixty columns): ints 0..3, doubles whole numbers 0..999, strings of a digit and ``asd``, two of 30 and 100 characters.

    A cell depends on the row's number, its column's place and the seed alone: the same call gives the same rows on any cluster.
    """
    at = spark.range(vins * rows_per_vin)
    # a multiplicative hash of the row's number, shifted per column; its upper bits
    hashed = lambda i: F.pmod((F.col("id") + 1) * F.lit(2_654_435_761) + F.lit((seed + i) * 40_503_001), F.lit(1 << 32))
    cell = lambda i, n: F.pmod(F.shiftright(hashed(i), 12), F.lit(n))
    columns = [cell(i, 4).cast("int").alias(c) for i, c in enumerate(INTS)]
    columns += [cell(100 + i, 1000).cast("double").alias(c) for i, c in enumerate(DOUBLES)]
    for i, c in enumerate(STRINGS):
        text = _text(300 + i, LONG_STRINGS[c], seed) if c in LONG_STRINGS else F.concat(cell(200 + i, 4).cast("string"), F.lit("asd"))
        columns.append(text.alias(c))
    return at.select(F.lpad(F.expr(f"id div {rows_per_vin}").cast("string"), 17, "0").alias("vin"), (F.lit(start) + F.pmod("id", F.lit(rows_per_vin)) * step).alias("ts"), *columns)


def time_range_requests(seed: int = 1) -> Iterator[TimeRange]:
    """Five minutes of the first entity, up to ten columns: four ints, four doubles, two strings, repeats count once."""
    rng = random.Random(seed)
    while True:
        a = rng.randrange(ROWS_PER_VIN - RANGE_ROWS)
        names = [rng.choice(kind) for kind, n in ((INTS, 4), (DOUBLES, 4), (STRINGS, 2)) for _ in range(n)]
        yield TimeRange(vin_of(0), START + a * STEP, START + (a + RANGE_ROWS) * STEP, tuple(dict.fromkeys(names)))


def latest_requests() -> Iterator[Latest]:
    """The newest row of one entity, two strings."""
    while True:
        yield Latest.of([vin_of(0)], ["FDJZT", "TYBJBZ"])


def _offset_span(rng: random.Random, rows: int) -> tuple[int, int]:
    """A span of ``rows`` rows whose bounds fall between two rows."""
    a, off = rng.randrange(ROWS_PER_VIN - rows), rng.randrange(1000)
    return START + a * STEP + off, START + (a + rows) * STEP + off


def aggregate_requests(seed: int = 1) -> Iterator[Aggregate]:
    """Average or maximum of an int over three hours."""
    rng = random.Random(seed)
    while True:
        yield Aggregate(vin_of(0), *_offset_span(rng, AGGREGATE_ROWS), INTS[1], rng.choice(list(Aggregator)))


def downsample_requests(seed: int = 1) -> Iterator[Downsample]:
    """An hour of an int in windows of ten seconds, compared with a constant 0..44."""
    rng = random.Random(seed)
    while True:
        how, op = rng.choice(list(Aggregator)), rng.choice(list(CompareOp))
        yield Downsample(vin_of(0), *_offset_span(rng, DOWNSAMPLE_ROWS), rng.choice(INTS), how, INTERVAL, Compare(op, rng.randrange(45)))
