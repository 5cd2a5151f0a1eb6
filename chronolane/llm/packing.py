"""Texts packed into boxes of fixed capacity: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.tokens import VOCABULARY, token_counts
from chronolane.session import written

SHARD_ROWS = 50_000
PLACED = "box_kind string, capacity_tokens int, box_id bigint, doc_id bigint, piece_no int, token_from bigint, n_tokens bigint"


class OpenBins:
    """Open bins by remaining capacity. The tree's leaf r counts the bins with r left; an inner node sums its children.

    The tightest bin for an item is the first leaf at or after the item's size that isn't zero: found by going up to the first
    right sibling that isn't zero, then down, in time logarithmic in the capacity.
    """

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, bin_no: int, left: int) -> None:
        self.bins[left].append(bin_no)
        i = left + self.leaves
        while i:
            self.tree[i] += 1
            i >>= 1

    def tightest(self, size: int) -> int:
        """Remaining capacity of the tightest open bin that holds ``size``; -1 if none does."""
        tree, i = self.tree, size + self.leaves
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i ^ 1]):
                i >>= 1
            if i <= 1:
                return -1
            i ^= 1
            while i < self.leaves:
                i <<= 1
                if not tree[i]:
                    i += 1
        return i - self.leaves

    def take(self, left: int) -> int:
        i = left + self.leaves
        while i:
            self.tree[i] -= 1
            i >>= 1
        return self.bins[left].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin number of each item; every size is 1 .. capacity. Equal sizes keep their order."""
    open_bins, out, count = OpenBins(capacity), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
        size = sizes[i]
        left = open_bins.tightest(size)
        if left < 0:
            bin_no, left, count = count, capacity, count + 1
        else:
            bin_no = open_bins.take(left)
        out[i] = bin_no
        if left > size:
            open_bins.put(bin_no, left - size)
    return out


def _pack_shard(boxes: list[tuple[str, int]]):
    def pack(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
        shard = int(pdf["shard"].iloc[0])
        docs, tokens = pdf["doc_id"].tolist(), [int(x) for x in pdf["n_tokens"]]
        out = []
        for kind, capacity in boxes:
            rows, full = [], 0  # doc, piece, from, size; pieces that fill a box alone come first
            for d, n in zip(docs, tokens, strict=True):
                whole = n // capacity if n > capacity else 0
                for p in range(whole):
                    rows.append((full, d, p, p * capacity, capacity))
                    full += 1
            items = [(d, n // capacity, n // capacity * capacity, n % capacity) if n > capacity else (d, 0, 0, n) for d, n in zip(docs, tokens, strict=True)]
            items = [x for x in items if x[3]]
            for b, x in zip(best_fit_decreasing([x[3] for x in items], capacity), items, strict=True):
                rows.append((full + b, *x))
            empty = [(d, 0, 0, 0) for d, n in zip(docs, tokens, strict=True) if not n]
            ids = [(shard << 32) + r[0] for r in rows] + [None] * len(empty)
            flat = [r[1:] for r in rows] + empty
            f = pd.DataFrame(flat, columns=["doc_id", "piece_no", "token_from", "n_tokens"])
            out.append(f.assign(box_kind=kind, capacity_tokens=capacity, box_id=pd.array(ids, dtype="Int64")))
        return pd.concat(out)[["box_kind", "capacity_tokens", "box_id", "doc_id", "piece_no", "token_from", "n_tokens"]]

    return pack


def pack(rows: DataFrame, boxes: DataFrame, vocabulary: str = VOCABULARY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(box_kind, capacity_tokens, box_id, doc_id, piece_no, token_from, n_tokens) for each kind of box.

    Only ids and sizes are shuffled. They are spread evenly, by a hash of both, over shards of about ``shard_rows`` texts, each
    packed on its own: a shard can waste a few boxes at its end, a vanishing part of the thousands it fills. A text longer
    than a box is cut into full boxes and one rest, which is packed like any text; no other text is cut. Texts without tokens
    (null, empty) come out once with a null ``box_id``. Kinds with a null or non-positive capacity are left out. A null
    ``doc_id`` is kept as it is. An empty table gives no rows.
    """
    kinds = [(b.box_kind, b.capacity_tokens) for b in boxes.where("capacity_tokens > 0").select("box_kind", "capacity_tokens").distinct().sort("box_kind", "capacity_tokens").collect()]  # a few rows
    sized = written(token_counts(rows, keep=["doc_id"], vocabulary=vocabulary), "sizes")
    shards = max(1, math.ceil(sized.count() / shard_rows))
    # ids travel as text: a null among integers would turn them into floats
    placed = sized.select(F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).alias("shard"), F.col("doc_id").cast("string").alias("doc_id"), "n_tokens")
    # as many tasks as shards: they are small in bytes, long in work
    packed = placed.repartition(shards, "shard").groupBy("shard").applyInPandas(_pack_shard(kinds), PLACED.replace("doc_id bigint", "doc_id string"))
    return packed.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def box_fill(placed: DataFrame) -> DataFrame:
    """Per kind: boxes used, tokens in them, texts cut, and the filled share."""
    boxed = placed.where(F.col("box_id").isNotNull())
    boxes = boxed.groupBy("box_kind", "capacity_tokens", "box_id").agg(F.sum("n_tokens").alias("t"), F.max(F.when(F.col("piece_no") == 1, 1).otherwise(0)).alias("c"))
    sums = boxes.groupBy("box_kind", "capacity_tokens").agg(F.count("*").alias("n_boxes"), F.sum("t").alias("n_tokens"))
    return sums.withColumn("filled_share", F.round(F.col("n_tokens") / (F.col("n_boxes") * F.col("capacity_tokens")), 6))


def box_check(placed: DataFrame) -> DataFrame:
    """Per kind: texts placed, boxes over their capacity, and texts cut though they fit a box."""
    boxes = placed.where(F.col("box_id").isNotNull()).groupBy("box_kind", "capacity_tokens", "box_id").agg(F.sum("n_tokens").alias("t"))
    over = boxes.groupBy("box_kind").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_over"))
    texts = placed.groupBy("box_kind", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("p"))
    needed = F.greatest(F.ceil(F.col("t") / F.col("capacity_tokens")), F.lit(1))
    cut = texts.groupBy("box_kind").agg(F.count("*").alias("n_texts"), F.count_if(F.col("p") != needed).alias("n_badly_cut"))
    return cut.join(over, "box_kind", "left").select("box_kind", "n_texts", F.coalesce("n_over", F.lit(0)).cast("bigint").alias("n_over"), "n_badly_cut")


def box_bound(placed: DataFrame) -> DataFrame:
    """Per kind whether the boxes used keep the guarantee of best-fit decreasing: 11/9 of the fewest possible, and one more per shard.

    The fewest possible are at least the tokens over the capacity.
    """
    boxed = placed.where(F.col("box_id").isNotNull())
    boxes = boxed.groupBy("box_kind", "capacity_tokens", "box_id").agg(F.sum("n_tokens").alias("t"))
    sums = boxes.groupBy("box_kind", "capacity_tokens").agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.countDistinct(F.shiftright("box_id", 32)).alias("shards"))
    fewest = F.ceil(F.col("t") / F.col("capacity_tokens"))
    return sums.select("box_kind", "capacity_tokens", (F.col("n") <= fewest * 11 / 9 + F.col("shards")).alias("within"), (F.col("n") >= fewest).alias("possible"))
