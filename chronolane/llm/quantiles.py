"""Percentiles of very large columns with a known rank error, combinable across partitions and days.

A summary is a sorted list of tuples (value, lo, hi): the value's rank lies in lo .. hi. Merging adds rank bounds exactly;
compression drops tuples as far as a permitted uncertainty allows. The uncertainty left is measured, not assumed:
``rank_error`` of a summary is half the widest hi - lo between neighbours, and no rank asked for is missed by more.

Lists travel as packed little-endian arrays (float64 values, int64 ranks) in binary columns, so a whole partition of
summaries is one numpy array, whatever the number of groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.session import written

EPSILON = 0.01
PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
CHUNK_ROWS = 500_000
FAN_IN = 64
HELD_BYTES = 32 << 20  # of summaries merged at a time
MONTH_DAYS = 32
DAY_MS = 86_400_000
INT_MARK = -2147483648  # fixed value: "no data" of an INT column
TUPLES = "vs binary, los binary, his binary"
SUMMARY = f"level string, vin string, day_no int, field string, chunk int, n bigint, rank_error bigint, {TUPLES}, q array<double>"
NAMES = ["level", "vin", "day_no", "field", "chunk", "n", "rank_error", "vs", "los", "his", "q"]


class Groups:
    """Summaries of many groups, one after the other: tuples of all in v, lo, hi; ``starts`` and ``n`` per group."""

    def __init__(self, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, n: np.ndarray) -> None:
        self.v, self.lo, self.hi, self.starts, self.n = v, lo, hi, starts, n

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.r_[self.starts, len(self.v)])

    def compress(self, share: float) -> Groups:
        """Keeps in each group the last tuple of every stretch of ``share`` * n ranks, and the first tuple."""
        sizes = self.sizes
        step = np.repeat(np.maximum(1, np.floor(self.n * share)).astype(np.int64), sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        cell = (self.lo - 1) // step
        keep = np.ones(len(self.v), bool)
        keep[:-1] = (cell[1:] != cell[:-1]) | (group[1:] != group[:-1])
        keep[self.starts] = True
        kept = np.add.reduceat(keep, self.starts) if len(self.starts) else np.zeros(0, np.int64)
        return Groups(self.v[keep], self.lo[keep], self.hi[keep], np.r_[0, np.cumsum(kept)[:-1]].astype(np.int64), self.n)

    def errors(self) -> np.ndarray:
        """Per group the greatest rank error of any answer."""
        if not len(self.v):
            return np.zeros(0, np.int64)
        gap = self.hi - self.lo
        inner = np.ones(len(self.v), bool)
        inner[self.starts] = False
        at = np.flatnonzero(inner)
        gap[at] = np.maximum(gap[at], self.hi[at] - self.lo[at - 1])
        return np.maximum.reduceat(gap, self.starts) // 2

    def query(self, probs: tuple[float, ...]) -> np.ndarray:
        """(groups, probs): of each group a value whose rank misses ceil(p * n) by no more than the group's error.

        The last tuple with hi <= rank + error is one: the next one's hi is greater, and neighbours are near. The tuples on
        both sides of the rank may be closer still.
        """
        base, error = np.cumsum(self.n) - self.n, self.errors()
        low, high = (x + np.repeat(base, self.sizes) for x in (self.lo, self.hi))
        last = np.r_[self.starts[1:], len(self.v)] - 1
        out = np.empty((len(self.n), len(probs)))
        for j, p in enumerate(probs):
            r = np.clip(np.ceil(p * self.n), 1, self.n).astype(np.int64)
            best = np.clip(np.searchsorted(high, base + r + error, side="right") - 1, self.starts, last)
            after = np.clip(np.searchsorted(low, base + r, side="left"), self.starts, last)
            for other in (after, np.maximum(after - 1, self.starts)):
                miss, least = (np.maximum(self.hi[i] - r, r - self.lo[i]) for i in (other, best))
                best = np.where(miss < least, other, best)
            out[:, j] = self.v[best]
        return out

    def binary(self) -> list[pa.Array]:
        """Packed tuples of each group. A group that kept all its values has the ranks 1 .. n, which need not be stored."""
        whole = self.sizes == self.n
        ranked = np.repeat(~whole, self.sizes)

        def packed(x: np.ndarray, sizes: np.ndarray) -> pa.Array:
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64) * 8
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])
            return made.cast(pa.binary())

        rest = np.where(whole, 0, self.sizes)
        return [packed(self.v.astype("<f8"), self.sizes), packed(self.lo[ranked].astype("<i8"), rest), packed(self.hi[ranked].astype("<i8"), rest)]


def of_sorted(v: np.ndarray, starts: np.ndarray, n: np.ndarray, share: float) -> Groups:
    """Exact summaries of groups of sorted values, compressed."""
    rank = np.arange(len(v), dtype=np.int64) - np.repeat(starts, n) + 1
    return Groups(v, rank, rank, starts, n).compress(share)


def merge(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, sizes: np.ndarray, n: np.ndarray, group: np.ndarray) -> Groups:
    """Merges summaries (``sizes`` tuples, ``n`` values, belonging to ``group`` 0 .. g-1) into one per group.

    In merged order, a tuple's lo is the sum, over all summaries, of lo of their last tuple so far; its hi is one more than
    the sum of the most values each summary can have before it. Both are running sums of increments.
    """
    first = np.cumsum(sizes) - sizes
    last = first + sizes - 1
    d_lo = np.diff(lo, prepend=0)
    d_lo[first] = lo[first]
    d_hi = np.empty_like(hi)
    d_hi[:-1] = hi[1:] - hi[:-1]
    d_hi[last] = n - hi[last] + 1  # after its last tuple all of a summary's values can lie before
    g = np.repeat(group, sizes)
    order = np.lexsort((v, g))
    g, mv = g[order], v[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    total = np.bincount(group, weights=n, minlength=int(group.max()) + 1 if len(group) else 0).astype(np.int64)
    run_lo = np.cumsum(d_lo[order])
    run_hi = np.cumsum(d_hi[order]) - d_hi[order]  # before the tuple itself
    # a summary's first tuple has rank 1, so its values before that tuple are hi - 1
    begin = np.bincount(group, weights=hi[first] - 1, minlength=len(total)).astype(np.int64) if len(group) else total
    sizes_out = np.diff(np.r_[starts, len(mv)])
    run_lo -= np.repeat(run_lo[starts] - d_lo[order][starts], sizes_out)
    run_hi -= np.repeat(run_hi[starts], sizes_out)
    return Groups(mv, run_lo, run_hi + 1 + np.repeat(begin, sizes_out), starts, total)


def _batch(level: str, keys: dict[str, pa.Array], groups: Groups, probs: tuple[float, ...] | None, tuples: bool) -> pa.RecordBatch:
    k = len(groups.n)
    packed = groups.binary() if tuples else [pa.nulls(k, pa.binary())] * 3
    q = pa.nulls(k, pa.list_(pa.float64())) if probs is None else pa.ListArray.from_arrays(np.arange(0, (k + 1) * len(probs), len(probs), dtype=np.int32), groups.query(probs).ravel())
    return pa.RecordBatch.from_arrays(
        [pa.array([level] * k, pa.string()), keys["vin"], keys["day_no"], keys["field"], keys["chunk"], pa.array(groups.n, pa.int64()), pa.array(groups.errors(), pa.int64()), *packed, q], names=NAMES
    )


def _flush(parts: list[pa.RecordBatch], fields: list[str], chunk: int, share: float) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(parts)
    vin = t["vin"].combine_chunks()
    vin = vin.dictionary_encode()
    code, names = vin.indices.to_numpy(zero_copy_only=False).astype(np.int64), vin.dictionary
    day = t["day_no"].to_numpy().astype(np.int64)
    for f in fields:
        v = t[f].to_numpy()
        good = ~np.isnan(v)
        c, d, v = code[good], day[good], v[good]
        if not len(v):
            continue
        order = np.lexsort((v, d, c))
        c, d, v = c[order], d[order], v[order]
        starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        n = np.diff(np.r_[starts, len(v)])
        k = len(starts)
        keys = {"vin": names.take(pa.array(c[starts])), "day_no": pa.array(d[starts], pa.int32()), "field": pa.array([f] * k), "chunk": pa.array(np.full(k, chunk), pa.int32())}
        yield _batch("part", keys, of_sorted(v, starts, n, share), None, True)


def _summarise(fields: list[str], share: float, chunk_rows: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, rows = TaskContext.get().partitionId(), [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk_rows:  # memory of a task stays bounded, whatever the size of its input
                yield from _flush(held, fields, part, share)
                held, rows = [], 0
        if rows:
            yield from _flush(held, fields, part, share)

    return scan


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t[name].combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _packed(t: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    c = _column(t, name)
    offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    data = np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind) if c.buffers()[2] is not None else np.zeros(0, kind)
    return data, np.diff(offsets) // 8


def _full_ranks(stored: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The ranks of all tuples: those stored, and 1 .. n of groups that kept all their values."""
    full = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    full[np.repeat(ranks > 0, sizes)] = stored
    return full


def _regroup(t: pa.Table, by: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Group number of each row, and a row of each group."""
    columns = []
    for k in by:
        c = _column(t, k)
        columns.append(c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if pa.types.is_string(c.type) else c.fill_null(-(2**31)).to_numpy(zero_copy_only=False).astype(np.int64))
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _merge_table(t: pa.Table, by: list[str], level: str, share: float | None, probs, tuples: bool) -> tuple[pa.RecordBatch, pa.Table]:
    group, heads = _regroup(t, by)
    v, sizes = _packed(t, "vs", "<f8")
    lo, ranks = _packed(t, "los", "<i8")
    hi, _ = _packed(t, "his", "<i8")
    lo, hi = _full_ranks(lo, sizes, ranks), _full_ranks(hi, sizes, ranks)
    groups = merge(v, lo, hi, sizes, t["n"].to_numpy(), group)
    if share is not None:
        groups = groups.compress(share)
    at = pa.array(heads)
    keys = {k: (_column(t, k).take(at) if k in by else pa.nulls(len(heads), t.schema.field(k).type)) for k in ("vin", "day_no", "field", "chunk")}
    return _batch(level, keys, groups, probs, tuples)


def _merging(steps: list[tuple[list[str], str, float | None, tuple | None, bool, int | None]], whole: list[str]):
    """Merges a partition's summaries step by step; each step works on the result of the step before and is put out.

    Rows come sorted, so that groups of ``whole`` columns (``_month`` is a row's month) are stretches of rows. About ``HELD_BYTES``
    of them are merged at a time: a task holds that, and one group, whatever the size of its partition.
    """

    def merged(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        for by, level, share, probs, tuples, days in steps:
            if days:
                day = _column(t, "day_no").to_numpy(zero_copy_only=False).astype(np.int64)
                t = t.set_column(t.schema.get_field_index("day_no"), "day_no", pa.array(day // days * days, pa.int32()))
            b = _merge_table(t, by, level, share, probs, tuples)
            yield b
            t = pa.Table.from_batches([b])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(b.schema.get_field_index(k)) for k in whole]
            first = tuple(k[0].as_py() for k in keys)
            if held and size >= HELD_BYTES and first != last:
                yield from merged(held)
                held, size = [], 0
            last = tuple(k[b.num_rows - 1].as_py() for k in keys)
            if size + b.nbytes >= HELD_BYTES and first != last:
                # the rows before the last group can be merged now
                same = np.ones(b.num_rows, bool)
                for k, v in zip(keys, last, strict=True):
                    same &= np.array([x == v for x in k.to_pylist()])
                cut = b.num_rows - int(np.argmin(same[::-1]))
                yield from merged([*held, b.slice(0, cut)])
                held, size = [], 0
                b = b.slice(cut)
            held.append(b)
            size += b.nbytes
        if held:
            yield from merged(held)

    return scan


def _number(rows: DataFrame, field: str) -> Column:
    """A field's values as doubles; NaN stands for no value: null, NaN and the markers."""
    c = F.col(f"`{field}`")
    kind = rows.schema[field].dataType.simpleString()
    mark = F.lit(INT_MARK) if kind in ("int", "bigint", "smallint", "tinyint") else F.lit(float("-inf"))
    return F.when(c.isNull() | (c == mark), F.lit(float("nan"))).otherwise(c.cast("double")).alias(field)


def summaries(rows: DataFrame, fields: list[str], epsilon: float = EPSILON, probs: tuple[float, ...] = PROBS, fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Summaries per (vin, UTC day, field) (level 'day') and per (vin, 32 days, field) (level 'month'), with percentiles.

    Each scan task summarises chunks of bounded size; summaries of one group are merged as a tree of bounded fan-in, so a
    group that holds a third of all rows is never gathered. Rank errors stay below ``epsilon`` * n at every level: each of the
    levels may add its equal part. Rows with a null vin or ts are ignored; null, NaN, INT minimum (in int columns) and
    -infinity are no values; a group without values has no summary; an empty table gives none.
    """
    parts = rows.rdd.getNumPartitions()
    extra = max(0, math.ceil(math.log(max(parts, 2), fan_in)) - 1)
    share = epsilon / (4 + extra)
    day = F.floor(F.col("ts") / F.lit(float(DAY_MS))).cast("int").alias("day_no")
    keyed = rows.where(F.col("vin").isNotNull() & F.col("ts").isNotNull()).select("vin", day, *[_number(rows, f) for f in fields])
    local = keyed.mapInArrow(_summarise(fields, share, chunk_rows), SUMMARY)
    for _ in range(extra):
        by = ["vin", "day_no", "field", "chunk"]
        local = local.withColumn("chunk", F.expr(f"chunk div {fan_in}").cast("int")).repartition(*by).sortWithinPartitions(*by)
        local = local.mapInArrow(_merging([(by, "part", share, None, True, None)], by), SUMMARY)
    steps = [(["vin", "day_no", "field"], "day", share, probs, True, None), (["vin", "day_no", "field"], "month", share, None, True, MONTH_DAYS)]
    whole = ["vin", "_month", "field"]
    placed = local.withColumn("_month", F.expr(f"floor(day_no / {MONTH_DAYS})").cast("int")).repartition(*whole).sortWithinPartitions(*whole)
    return placed.mapInArrow(_merging(steps, whole), SUMMARY)


def combine(months: DataFrame, probs: tuple[float, ...] = PROBS) -> DataFrame:
    """One summary per (vin, field) of summaries of any days (level 'vin')."""
    whole = ["vin", "field"]
    return months.repartition(*whole).sortWithinPartitions(*whole).mapInArrow(_merging([(whole, "vin", None, probs, True, None)], whole), SUMMARY)


def column_name(p: float) -> str:
    return f"p{round(p * 100):02d}"


def percentiles(rows: DataFrame, fields: list[str], epsilon: float = EPSILON, probs: tuple[float, ...] = PROBS, fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(vin, day_no, field, n, rank_error, p01 ..): per vin (day_no null) and per vin and day.

    ``n`` values are counted exactly; a percentile p is a value of the group whose rank is within ``rank_error`` of
    ceil(p * n), and ``rank_error`` <= ``epsilon`` * n (0 for small groups: exact).
    """
    kept = written(summaries(rows, fields, epsilon, probs, fan_in, chunk_rows), "summaries")
    both = kept.where("level = 'day'").unionByName(combine(kept.where("level = 'month'"), probs))
    values = [F.get("q", F.lit(j)).alias(column_name(p)) for j, p in enumerate(probs)]
    return both.select("vin", "day_no", "field", "n", "rank_error", *values)


def bounds_kept(rows: DataFrame, found: DataFrame, fields: list[str], epsilon: float = EPSILON, probs: tuple[float, ...] = PROBS) -> DataFrame:
    """(vin, day_no, field, n, within): holds the answers of ``percentiles`` against exact ranks counted in the rows."""
    day = F.floor(F.col("ts") / F.lit(float(DAY_MS))).cast("int").alias("day_no")
    keyed = rows.where(F.col("vin").isNotNull() & F.col("ts").isNotNull()).select("vin", day, *[_number(rows, f) for f in fields])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("c")
    values = keyed.select("vin", "day_no", cells).select("vin", "day_no", "c.*").where(~F.isnan("v"))
    names = [column_name(p) for p in probs]
    answers = found.select("vin", "day_no", "field", "n", "rank_error", *names)
    per_day = values.join(answers.where("day_no IS NOT NULL"), ["vin", "day_no", "field"])
    per_vin = values.drop("day_no").join(answers.where("day_no IS NULL"), ["vin", "field"]).select(*per_day.columns)
    count = [F.count("*").alias("have")]
    for p in names:
        count += [F.count_if(F.col("v") < F.col(p)).alias(f"{p}_less"), F.count_if(F.col("v") <= F.col(p)).alias(f"{p}_upto")]
    ranks = per_day.unionByName(per_vin).groupBy("vin", "day_no", "field", "n", "rank_error").agg(*count)
    good = (F.col("have") == F.col("n")) & (F.col("rank_error") <= F.lit(epsilon) * F.col("n"))
    for p, name in zip(probs, names, strict=True):
        rank = F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1))
        miss = F.greatest(F.col(f"{name}_less") + 1 - rank, rank - F.col(f"{name}_upto"), F.lit(0))
        good = good & (miss <= F.col("rank_error")) & (F.col(f"{name}_upto") > F.col(f"{name}_less"))
    return ranks.select("vin", "day_no", "field", "n", good.alias("within"))
