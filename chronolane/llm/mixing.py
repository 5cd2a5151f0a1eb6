"""Records of several sources mixed to target shares of tokens along a curriculum.

Each source has a weight schedule over the training run, piecewise linear between equally spaced knots; its integral is the
source's share. A record's place in the cumulative tokens of its source, inverted through the integrated schedule, is its
training position; records are range-sorted by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolane.functions import fold_text
from chronolane.llm.tokens import VOCABULARY, token_counts
from chronolane.session import written

TILT = 0.5
BUCKET_ROWS = 50_000
GRID = 64  # times at which a mix is checked


def tilted(shares: dict[str, float], tilt: float = TILT) -> dict[str, list[float]]:
    """A schedule of two knots per source: larger sources weigh more at the start, smaller ones at the end.

    Weights stay non-negative for ``tilt`` up to 0.5, add to the same sum at any time, and average to the share.
    """
    names = sorted(shares, key=lambda s: (-shares[s], s))
    place = {s: 1 - 2 * i / max(1, len(names) - 1) for i, s in enumerate(names)}
    mean = sum(shares[s] * place[s] for s in names) / (sum(shares.values()) or 1)
    return {s: [shares[s] * (1 + tilt * (place[s] - mean)), shares[s] * (1 - tilt * (place[s] - mean))] for s in names}


def integrated(weights: list[float]) -> list[float]:
    """Integral of a schedule from 0 to each knot; time runs from 0 to 1."""
    step, out = 1 / (len(weights) - 1), [0.0]
    for a, b in zip(weights, weights[1:], strict=False):
        out.append(out[-1] + (a + b) / 2 * step)
    return out


def position_of(demand: Column, knots: Column, weights: Column) -> Column:
    """Time at which a source's integrated weight reaches ``demand``; both arrays by knot. Inverts a quadratic per segment."""
    n = F.size(knots) - 1
    j = F.least(F.greatest(F.size(F.filter(knots, lambda k: k <= demand)), F.lit(1)), n)  # 1-based segment
    a, b = F.element_at(weights, j), F.element_at(weights, j + 1)
    rest = demand - F.element_at(knots, j)
    slope = (b - a) * n
    # rest = a t + slope t^2 / 2; the form without cancellation
    t = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (a + F.sqrt(F.greatest(a * a + 2 * slope * rest, F.lit(0.0)))))
    return (j - 1 + F.least(t * n, F.lit(1.0))) / n


def running_totals(rows: DataFrame, by: str, order: Column, size: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``_before``: the sum of ``size`` over the rows of the same ``by`` earlier in ``order`` (a BIGINT hash).

    A source may hold a third of all rows: it is cut into hash buckets of about ``bucket_rows``; running sums in a bucket start
    from the total of the buckets before.
    """
    buckets = max(1, math.ceil(rows.count() / bucket_rows))
    # the hash's range in equal parts: its upper 32 bits, counted from 0, times the number of buckets
    part = F.shiftright((F.shiftright(order, 32) + F.lit(1 << 31)) * F.lit(buckets), 32).cast("int")
    placed = rows.withColumn("_hash", order).withColumn("_part", part)
    sums = placed.groupBy(by, "_part").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(by, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(by, "_part").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return summed.join(offsets, [by, "_part"]).withColumn("_before", F.col("_offset") + F.col("_inside")).drop("_part", "_offset", "_inside", "_hash")


class Mix:
    """A plan: per source its share, tokens at hand and tokens to draw; built from the few rows of the target table."""

    def __init__(self, sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, schedule: dict[str, list[float]] | None = None) -> None:
        named = targets.select(fold_text(F.col("source")).alias("source"), "target_share", "max_repeats")
        have = sized.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
        rows = named.join(have, "source", "left").collect()  # one row per target
        self.target = {r.source: r.target_share for r in rows}
        self.repeats = {r.source: max(0, r.max_repeats or 0) for r in rows}
        self.have = {r.source: r.n_tokens or 0 for r in rows}
        usable = {s: self.target[s] for s in self.target if self.have[s] and self.repeats[s] and self.target[s] > 0}
        whole = sum(usable.values())
        self.share = {s: x / whole for s, x in usable.items()}
        limit = min((self.have[s] * self.repeats[s] / x for s, x in self.share.items()), default=0)
        self.total = math.floor(limit) if total_tokens is None else total_tokens
        self.weights = schedule or tilted(self.share)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for s, share in self.share.items():
            w = self.weights[s]
            knots = integrated(w)
            scale = share / knots[-1]  # any schedule is scaled to its source's share
            rows.append((s, self.repeats[s], self.have[s], share * self.total, [k * scale * self.total for k in knots], [x * scale * self.total for x in w]))
        return spark.createDataFrame(rows, "source string, max_repeats int, have bigint, demand double, knots array<double>, weights array<double>")


def sized_records(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens), sources without case and outer spaces; records without tokens or source are left out."""
    named = rows.select("doc_id", fold_text(F.col("source")).alias("source"), "text")
    counted = token_counts(named, keep=["doc_id", "source"], vocabulary=vocabulary)
    return written(counted.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)), "records")


def mix(rows: DataFrame, targets: DataFrame, total_tokens: int | None = None, schedule: dict[str, list[float]] | None = None, seed: int = 42, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, repeat_no, n_tokens, position), sorted by position.

    Of each source, records in a seeded order, again and again up to ``max_repeats`` times, until its share of the total is
    drawn; a record is drawn if its middle lies within the demand. Without ``total_tokens`` the total is the largest at which
    every source with records reaches its share. Targets of sources without records are divided among the others in
    proportion (``mix_shares`` shows both). A larger ``total_tokens`` leaves short the sources that run out. Texts without
    tokens, and sources without target, aren't drawn. An empty table gives no rows.
    """
    return _mixed(sized_records(rows, vocabulary), targets, total_tokens, schedule, seed)[0]


def _mixed(sized: DataFrame, targets: DataFrame, total_tokens: int | None, schedule, seed: int) -> tuple[DataFrame, Mix]:
    plan = Mix(sized, targets, total_tokens, schedule)
    table = F.broadcast(plan.table(sized.sparkSession))  # a row per target
    order = F.xxhash64(F.lit(seed), "source", "doc_id")
    placed = running_totals(sized, "source", order, "n_tokens").join(table, "source")
    epochs = F.sequence(F.lit(0), F.least(F.col("max_repeats") - 1, F.ceil(F.col("demand") / F.col("have")).cast("int")))
    drawn = placed.withColumn("repeat_no", F.explode(epochs))
    middle = F.col("repeat_no") * F.col("have") + F.col("_before") + F.col("n_tokens") / 2
    drawn = drawn.withColumn("_middle", middle.cast("double")).where(F.col("_middle") < F.col("demand"))
    out = drawn.select("doc_id", "source", "repeat_no", "n_tokens", position_of(F.col("_middle"), F.col("knots"), F.col("weights")).alias("position"))
    return out.orderBy("position", "source", "doc_id", "repeat_no"), plan


def mix_shares(rows: DataFrame, targets: DataFrame, total_tokens: int | None = None, schedule=None, seed: int = 42, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per target: source, target_share, reachable_share, have_tokens, mixed_tokens, actual_share, most_repeats."""
    sized = sized_records(rows, vocabulary)
    drawn, plan = _mixed(sized, targets, total_tokens, schedule, seed)
    spark = rows.sparkSession
    named = spark.createDataFrame([(s, plan.target[s], plan.share.get(s, 0.0), plan.have[s]) for s in plan.target], "source string, target_share double, reachable_share double, have_tokens bigint")
    sums = drawn.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), (F.max("repeat_no") + 1).alias("most_repeats"))
    full = named.join(sums, "source", "left").na.fill(0, ["mixed_tokens", "most_repeats"])
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # a row per target
    return full.withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)))


def mix_check(rows: DataFrame, targets: DataFrame, total_tokens: int | None = None, schedule=None, seed: int = 42, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, share_kept, repeats_kept, schedule_kept) per target, of the mix as drawn.

    ``share_kept``: its tokens are what its reachable share asks for, but for one record. ``repeats_kept``: no record is drawn
    twice with one ``repeat_no`` or more often than allowed, and none is skipped before a repeat. ``schedule_kept``: at each of
    64 equally spaced times, the tokens drawn so far are its integrated schedule, but for one record.
    """
    sized = sized_records(rows, vocabulary)
    drawn, plan = _mixed(sized, targets, total_tokens, schedule, seed)
    drawn = written(drawn, "drawn")
    cell = F.least(F.floor(F.col("position") * GRID), F.lit(GRID - 1)).cast("int")
    cells = drawn.groupBy("source", cell.alias("cell")).agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("m")).collect()  # 64 rows per target
    uses = drawn.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("repeat_no").alias("d"), F.max("repeat_no").alias("last"))
    bad = uses.groupBy("source").agg(F.count_if((F.col("n") != F.col("d")) | (F.col("last") + 1 != F.col("n"))).alias("bad"), F.max("n").alias("most")).collect()
    bad_of = {r.source: (r.bad, r.most) for r in bad}
    out = []
    for s in plan.target:
        mine = {r.cell: r for r in cells if r.source == s}
        total, most = sum(r.t for r in mine.values()), max((r.m for r in mine.values()), default=0)
        want = plan.share.get(s, 0.0) * plan.total
        n_bad, repeats = bad_of.get(s, (0, 0))
        kept, so_far = True, 0
        if s in plan.share:
            w = plan.weights[s]
            knots = integrated(w)
            for i in range(GRID):
                so_far += mine[i].t if i in mine else 0
                x = (i + 1) / GRID
                j = min(int(x * (len(w) - 1)), len(w) - 2)
                u = x - j / (len(w) - 1)
                area = knots[j] + w[j] * u + (w[j + 1] - w[j]) * (len(w) - 1) * u * u / 2
                kept = kept and abs(so_far - area / knots[-1] * want) <= most + 1e-6 * want
        out.append((s, abs(total - want) <= most, n_bad == 0 and repeats <= plan.repeats[s], kept))
    return rows.sparkSession.createDataFrame(out, "source string, share_kept boolean, repeats_kept boolean, schedule_kept boolean")
