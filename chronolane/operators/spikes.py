"""Implausible readings: physical bounds, short excursions (Hampel filter, then the exact rule) and stuck values.

Distinct rows are range-partitioned by (vin, ts) - a hot source is spread over partitions - kept as sorted files and scanned
twice in Arrow batches, a partition of bounded size at a time. The first scan counts absolute changes per source in narrow cells
of size; the running counts bound each source's median change to a cell. The second scan finds bounds and stuck values, screens
excursions against the rolling median, decides those clear of the cell, and picks the few changes in the cell, from which comes
the exact median for the rest. What lies across partition edges is settled from a bounded number of readings at each edge.

The screen's scale is the source's median absolute change, which the definition names, not the window's own median absolute
deviation: on a ramp, or between two spikes, the latter is as large as the spike. Two neighbouring readings more than a limit
apart can't both be within half of it from any one value, so no excursion passes the screen unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolane.operators.ordered import kept_partitions, partition_count
from chronolane.session import written

# Possible range of each field, and whether an unchanged value is suspicious.
BOUNDS = {"soc": (0.0, 100.0), "zdy": (0.0, 1000.0), "zdl": (-1000.0, 1000.0), "qddjwd": (-60.0, 210.0)}
STUCK_FIELDS = ("zdy", "zdl", "qddjwd")
STUCK_ROWS = 25
LONGEST = 3
TIMES_MEDIAN = 10.0
HALF = 3  # half-width of the rolling window: 7 readings, so that an excursion can't be its median
BROADCAST_SOURCES = 200_000  # cells of more sources (about 60 bytes each) are joined by shuffling the rows once more
EDGE = {"edge": 32, "course": 8}  # readings passed on at a partition edge: more than STUCK_ROWS; more than 2 * LONGEST
CELL_BITS = 45  # a cell is a double without its last bits: 128 to a doubling, each less than 1 % wide

SCAN = "kind string, part int, field string, vin string, ts bigint, pos bigint, v double, margin double, n bigint"
KINDS = {"kind": pa.string(), "part": pa.int32(), "field": pa.string(), "vin": pa.string(), "ts": pa.int64(), "pos": pa.int64(), "v": pa.float64(), "margin": pa.float64(), "n": pa.int64()}


def _out(**columns) -> pa.RecordBatch:
    size = next(len(c) for c in columns.values() if isinstance(c, (np.ndarray, pa.Array)))
    arrays = []
    for name, kind in KINDS.items():
        c = columns.get(name)
        whole = isinstance(c, (np.ndarray, pa.Array))
        arrays.append(pa.nulls(size, kind) if c is None else c.cast(kind) if isinstance(c, pa.Array) else pa.array(c, kind) if whole else pa.repeat(pa.scalar(c, kind), size))
    return pa.RecordBatch.from_arrays(arrays, names=list(KINDS))


def cell_of(change: np.ndarray) -> np.ndarray:
    """The cell of a positive double; cells are ordered as their values are."""
    return np.ascontiguousarray(change, np.float64).view(np.int64) >> CELL_BITS


def cell_bounds(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least value of cell ``low``, least value beyond cell ``high``."""
    value = lambda c: (np.asarray(c, np.int64) << CELL_BITS).view(np.float64)
    return value(low), value(np.asarray(high, np.int64) + 1)


class Part:
    """A partition's rows - their number is bounded - as numpy: source number of each row, sources, ts, fields."""

    def __init__(self, t: pa.Table) -> None:
        names = t["vin"].combine_chunks()
        names = (names.chunk(0) if isinstance(names, pa.ChunkedArray) else names).dictionary_encode()
        self.number = t["_part"][0].as_py()
        self.codes, self.names, self.ts = names.indices.to_numpy(zero_copy_only=False), names.dictionary, t["ts"].to_numpy()
        self.table = t
        first = np.zeros(len(self.names), bool)  # sources that may go on in another partition
        first[[self.codes[0], self.codes[-1]]] = True
        self.ends = first

    def vins(self, codes: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(codes))

    def per_source(self, column: str) -> np.ndarray:
        """A column that is the same in all rows of a source."""
        _, at = np.unique(self.codes, return_index=True)
        return self.table[column].to_numpy()[at]

    def readings(self, field: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Source, ts and value of one field's readings in order (ts, value), each once, and whether it is possible."""
        values = self.table[field].to_numpy()  # nulls come as NaN: neither is a reading
        rows = np.flatnonzero(~np.isnan(values))
        c, t, v = self.codes[rows], self.ts[rows], values[rows]
        tied = np.zeros(len(c) + 1, bool)
        tied[1:-1] = (c[1:] == c[:-1]) & (t[1:] == t[:-1])
        at = np.flatnonzero(tied[1:] | tied[:-1])
        if len(at):  # several readings at one time, in order of value
            v[at] = v[at][np.lexsort((v[at], t[at], c[at]))]
            fresh = ~tied[:-1]
            fresh[1:] |= v[1:] != v[:-1]
            c, t, v = c[fresh], t[fresh], v[fresh]
        low, high = BOUNDS[field]
        return c, t, v, (v >= low) & (v <= high)

    def edges(self, c: np.ndarray, size: int) -> np.ndarray:
        """Of the readings of sources ``c``: the first and last ``size`` of the sources that start or end the partition."""
        head, tail = np.flatnonzero(c == self.codes[0]), np.flatnonzero(c == self.codes[-1])
        return np.unique(np.concatenate([head[:size], head[-size:], tail[:size], tail[-size:]]))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """A task's rows, one partition of the kept files after the other."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        numbers = b.column(b.schema.get_field_index("_part")).to_numpy()
        at = 0
        for cut in [*(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1), len(numbers)]:
            piece = b.slice(at, cut - at)
            if held and piece.num_rows and held[-1].column(held[-1].schema.get_field_index("_part"))[0].as_py() != numbers[at]:
                yield Part(pa.Table.from_batches(held))
                held = []
            if piece.num_rows:
                held.append(piece)
            at = cut
    if held:
        yield Part(pa.Table.from_batches(held))


def _changes(c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Source and size of each non-zero change between neighbouring readings of a source."""
    d = np.abs(np.diff(v))
    keep = (c[1:] == c[:-1]) & (d > 0)
    return c[1:][keep], d[keep]


def _counted(c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (source, x) and how often each occurs."""
    order = np.lexsort((x, c))
    c, x = c[order], x[order]
    starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (x[1:] != x[:-1])]) if len(c) else np.zeros(0, np.int64)
    return c[starts], x[starts], np.diff(np.r_[starts, len(c)])


def scan_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition, source and field: changes counted by cell; and the partition's edge readings.

    Readings that lie in a row have consecutive ``pos``; a gap in ``pos`` is a hole.
    """
    for p in _parts(batches):
        for field in BOUNDS:
            c, t, v, good = p.readings(field)
            if not len(c):
                continue
            sources, sizes = _changes(c[good], v[good])
            sources, cells, n = _counted(sources, cell_of(sizes))
            if len(n):
                yield _out(kind="cell", part=p.number, field=field, vin=p.vins(sources), pos=cells, n=n)
            e = p.edges(c, EDGE["edge"])
            yield _out(kind="edge", part=p.number, field=field, vin=p.vins(c[e]), ts=t[e], pos=e, v=v[e])
            g = np.flatnonzero(good)
            e = p.edges(c[g], EDGE["course"])
            yield _out(kind="course", part=p.number, field=field, vin=p.vins(c[g[e]]), ts=t[g[e]], pos=e, v=v[g[e]])


def rolling_median(v: np.ndarray, half: int = HALF) -> np.ndarray:
    """Median of the 2 * half + 1 readings around each; at the ends the first and last reading are repeated."""
    padded = np.r_[np.full(half, v[0]), v, np.full(half, v[-1])]
    w = [padded[i : i + len(v)].copy() for i in range(2 * half + 1)]
    for top in range(2 * half, half - 1, -1):  # the greatest of those left moves up, until half are above
        for i in range(top):
            low, high = np.minimum(w[i], w[i + 1]), np.maximum(w[i], w[i + 1])
            w[i], w[i + 1] = low, high
    return w[half]


def excursions(v: np.ndarray, limit: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Largest margin by which each reading belongs to an excursion of one to three readings; 0 if by no more than its ``limit``.

    The margin of an excursion is the least distance of any of its readings to the reading before and to the one after it.
    Hampel screen: an excursion can start only where the reading, or the one before it, lies further than half the limit
    from the rolling median. A limit that isn't positive (no changes) allows no excursion. Readings lie in order, source by source.
    """
    best = np.zeros(len(v))
    if len(v) < 3:
        return best
    mid = rolling_median(v)
    with np.errstate(invalid="ignore"):
        far = np.abs(v - mid) > limit / 2
        far[1:] |= np.abs(v[:-1] - mid[1:]) > limit[1:] / 2
        far &= limit > 0
    starts = np.flatnonzero(far)
    for k in range(1, LONGEST + 1):
        i = starts[(starts >= 1) & (starts + k < len(v))]
        i = i[source[i - 1] == source[i + k]]
        before, after = v[i - 1], v[i + k]
        margin = np.full(len(i), np.inf)
        for j in range(k):
            x = v[i + j]
            margin = np.minimum(margin, np.minimum(np.abs(x - before), np.abs(x - after)))
        hit = margin > limit[i]
        for j in range(k):
            np.maximum.at(best, i[hit] + j, margin[hit])
    return best


def stuck(v: np.ndarray, source: np.ndarray, rows: int = STUCK_ROWS) -> np.ndarray:
    """Readings in runs of ``rows`` and more of one unchanged value of a source."""
    starts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (source[1:] != source[:-1])])
    lengths = np.diff(np.r_[starts, len(v)])
    return np.repeat(lengths >= rows, lengths)


def scan_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: impossible and stuck readings, excursions ('unsure' if the median's cell doesn't decide), changes in that cell.

    Columns ``_low_field`` and ``_high_field`` are the cells of the source's two middle changes, null without changes.
    """
    for p in _parts(batches):
        for field in BOUNDS:
            c, t, v, good = p.readings(field)
            if not len(c):
                continue
            bad = ~good
            if bad.any():
                yield _out(kind="bound", part=p.number, field=field, vin=p.vins(c[bad]), ts=t[bad], v=v[bad])
            if field in STUCK_FIELDS:
                held = stuck(v, c)
                if held.any():
                    yield _out(kind="stuck", part=p.number, field=field, vin=p.vins(c[held]), ts=t[held], v=v[held])
            cells = [p.per_source(f"_{x}_{field}").astype(np.float64) for x in ("low", "high")]
            known = ~np.isnan(cells[0])
            low, high = (np.where(known, x, 0).astype(np.int64) for x in cells)
            least, most = (np.where(known, TIMES_MEDIAN * x, np.nan) for x in cell_bounds(low, high))
            gc, gt, gv = c[good], t[good], v[good]
            margin = excursions(gv, least[gc], gc)
            sure = margin > most[gc]
            for kind, hit in (("excursion", sure), ("unsure", (margin > 0) & ~sure)):
                if hit.any():
                    yield _out(kind=kind, part=p.number, field=field, vin=p.vins(gc[hit]), ts=gt[hit], v=gv[hit], margin=margin[hit])
            sources, sizes = _changes(gc, gv)
            at = cell_of(sizes)
            near = (at == low[sources]) | (at == high[sources])
            sources, sizes, n = _counted(sources[near], sizes[near])
            if len(n):
                yield _out(kind="middle", part=p.number, field=field, vin=p.vins(sources), v=sizes, n=n)


def _with_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("cell", pa.array(cell_of(b.column(b.schema.get_field_index("v")).to_numpy())))


def seam_flags(pdf):
    """One stretch of edge readings of a source and field without a hole: a few partitions' worth; what they could not see alone."""
    pdf = pdf.sort_values(["part", "pos"])
    v, kind, field = pdf["v"].to_numpy(), pdf["kind"].iloc[0], pdf["field"].iloc[0]
    one, margin = np.zeros(len(v), np.int64), np.full(len(v), np.nan)
    if kind == "edge":
        hit, kind = stuck(v, one) if field in STUCK_FIELDS else one > 0, "stuck"
    else:
        low = pdf["low"].iloc[0]
        least = np.nan if low != low else TIMES_MEDIAN * cell_bounds(np.int64([low]), np.int64([low]))[0][0]
        margin = excursions(v, np.full(len(v), least), one)
        hit, kind = margin > 0, "unsure"
    return pdf[hit].assign(kind=kind, margin=margin[hit])[["kind", "vin", "ts", "field", "v", "margin"]]


def middle_cells(cells: DataFrame) -> DataFrame:
    """(vin, field, low, high, before, first, last): cells of the changes of the two middle ranks, how many changes are smaller, the ranks.

    ``cells`` (vin, field, cell, n) holds a number of rows per source that doesn't grow with its readings.
    """
    key = ["vin", "field"]
    counted = cells.groupBy(*key, "cell").agg(F.sum("n").alias("c"))
    w = Window.partitionBy(*key)
    ranked = counted.withColumn("upto", F.sum("c").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("c").over(w))
    first, last = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    middle = ranked.where((F.col("upto") >= first) & (F.col("upto") - F.col("c") < last))
    ends = [F.min("cell").alias("low"), F.max("cell").alias("high"), F.min(F.col("upto") - F.col("c")).alias("before"), F.min(first).alias("first"), F.min(last).alias("last")]
    return middle.groupBy(*key).agg(*ends)


def exact_medians(values: DataFrame, middle: DataFrame) -> DataFrame:
    """(vin, field, median) from the distinct changes (vin, field, v, n) in the middle cells."""
    key = ["vin", "field"]
    counted = values.groupBy(*key, "v").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    near = counted.join(middle, key).withColumn("upto", F.col("before") + F.sum("n").over(inside)).withColumn("from", F.col("upto") - F.col("n"))
    pick = lambda r: F.max(F.when((F.col("from") < F.col(r)) & (F.col("upto") >= F.col(r)), F.col("v")))
    return near.groupBy(*key).agg(((pick("first") + pick("last")) / 2).alias("median"))


def _judged(kept: DataFrame, wide: DataFrame) -> DataFrame:
    """The kept rows with their source's cells, partition by partition in order.

    The cells are broadcast if they are known to be few. Else the rows are shuffled by (partition, source), groups as bounded as
    partitions are, and put in order again; either way each source of a partition is seen in one stretch.
    """
    if wide.count() <= BROADCAST_SOURCES:
        return kept.join(F.broadcast(wide), "vin", "left")
    pairs = kept.select("_part", "vin").distinct().join(wide, "vin")
    return kept.join(pairs.hint("shuffle_hash"), ["_part", "vin"], "left").sortWithinPartitions("_part", "vin", "ts")


def implausible(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """(vin, ts, field, v, reason): each implausible reading once per reason ('bound', 'excursion', 'stuck').

    Equal rows count once; null and NaN are no readings; rows with a null vin or ts are ignored; an infinite reading is out
    of bounds; a source without any change in a field has no excursions in it. Several different readings at one (vin, ts)
    are taken in order of value, equal ones once; they share a partition. An empty table gives no rows.
    """
    fields = list(BOUNDS)
    clean = [F.when(~F.isnan(f), F.col(f)).alias(f) for f in fields]
    distinct = rows.where(F.col("vin").isNotNull() & F.col("ts").isNotNull()).select("vin", F.col("ts").cast("bigint").alias("ts"), *clean).distinct()
    kept = kept_partitions(distinct, "readings", "vin", "ts", partitions=partitions or partition_count(rows))
    first = written(kept.mapInArrow(scan_changes, SCAN), "changes")
    # changes from one partition to the next: a few rows per partition
    order = Window.partitionBy("vin", "field", "kind").orderBy("part", "pos")
    new_part = F.lag("part").over(order) != F.col("part")
    edges = first.where("kind in ('edge', 'course')")
    step = F.when(new_part, F.abs(F.col("v") - F.lag("v").over(order)))
    across = edges.where("kind = 'course'").select("vin", "field", step.alias("v"), F.lit(1).cast("bigint").alias("n")).where("v > 0")
    across = written(across.mapInArrow(_with_cells, "vin string, field string, v double, n bigint, cell bigint"), "across")
    cells = first.where("kind = 'cell'").select("vin", "field", F.col("pos").alias("cell"), "n").unionByName(across.drop("v"))
    middle = written(middle_cells(cells), "middle")
    # stretches of edge readings without a hole
    hole = F.coalesce((~new_part & (F.lag("pos").over(order) + 1 != F.col("pos"))).cast("int"), F.lit(0))
    stretches = edges.withColumn("hole", hole).withColumn("seg", F.sum("hole").over(order)).join(middle.select("vin", "field", "low"), ["vin", "field"], "left")
    stretches = stretches.select("vin", "field", "kind", "seg", "part", "pos", "ts", "v", "low")
    seams = written(stretches.groupBy("vin", "field", "kind", "seg").applyInPandas(seam_flags, "kind string, vin string, ts bigint, field string, v double, margin double"), "seams")
    wide = middle.groupBy("vin").agg(*[F.max(F.when(F.col("field") == f, F.col(x))).alias(f"_{x}_{f}") for f in fields for x in ("low", "high")])
    scanned = written(_judged(kept, wide).mapInArrow(scan_flags, SCAN).select("kind", "vin", "ts", "field", "v", "margin", "n"), "flags")
    found = scanned.drop("n").where("kind <> 'middle'").unionByName(seams)
    near = across.join(middle, ["vin", "field"]).where((F.col("cell") == F.col("low")) | (F.col("cell") == F.col("high"))).select("vin", "field", "v", "n")
    unsure = found.where("kind = 'unsure'")
    open_sources = unsure.select("vin", "field").distinct()
    medians = exact_medians(scanned.where("kind = 'middle'").select("vin", "field", "v", "n").unionByName(near).join(open_sources, ["vin", "field"], "left_semi"), middle)
    decided = unsure.join(medians, ["vin", "field"]).where(F.col("margin") > TIMES_MEDIAN * F.col("median")).drop("median").withColumn("kind", F.lit("excursion"))
    sure = scanned.drop("n").where("kind in ('bound', 'excursion', 'stuck')").unionByName(seams.where("kind = 'stuck'"))
    return sure.unionByName(decided).select("vin", "ts", "field", "v", F.col("kind").alias("reason")).distinct()
