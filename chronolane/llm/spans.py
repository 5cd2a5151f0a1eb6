"""Long exact spans shared between records, by a de Bruijn graph over content-defined tokens.

A text is cut into tokens at minimizers: of every ``WINDOW`` consecutive ``GRAM``-character k-mers the least hash. A token is
known by its k-mer and the distance to the next, so it depends on content alone, and any shared span of ``MIN_SPAN`` = WINDOW +
GRAM - 1 characters holds a k-mer cut in both records, whatever words or script it is in. K-mers of one text only are dropped;
the rest are the graph's nodes, two following ones its edges. An edge doesn't branch if all occurrences of its first node go on
to its second, at the same distance, and all of the second come from the first; that is counted over all texts (one aggregation)
and joined back to the occurrences (one join). A nonbranching path is the same in every text it occurs in, from end to end, so
each text cuts its own nodes into paths at the branches; following paths from node to node by repeated joins would find the
same paths in as many rounds as the logarithm of the longest.

A path is verified at its source coordinates, by a 128-bit cryptographic digest (BLAKE2b) of the characters there: of the whole
path if it is at least MIN_SPAN long, else of each MIN_SPAN-character window around it. Equal texts are one class with a
representative; they are expanded at the end. What is shuffled are coordinates and digests; of the texts, once, those that hold
a path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolane.session import written

MIN_SPAN = 200
GRAM = 100
WINDOW = MIN_SPAN - GRAM + 1
PAIR_BLOCK = 1000  # members of a group paired in one task, twice that with the other block
PIECE = 1 << 20  # characters of a batch hashed at once; a longer text is hashed alone
LOW = np.uint64((1 << 24) - 1)
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of SplitMix64, published by Steele et al.)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = BASES[which]
    inverse = pow(base, -1, 1 << 64)
    make = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64)
    return make(base), make(inverse)


def window_hashes(points: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """64-bit hashes of all windows of ``k`` code points; equal windows hash alike wherever they lie."""
    n = len(points)
    if n < k:
        return np.zeros(0, np.uint64)
    size = max(PIECE * 2, 1 << n.bit_length())
    up, down = _powers(which, size)
    sums = np.cumsum(_mixed(points.astype(np.uint64) + SEEDS[which]) * down[:n], dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), sums])
    return _mixed((sums[k:] - sums[: n - k + 1]) * up[: n - k + 1])


def sampled(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizers of texts laid end to end, all at least MIN_SPAN long: text number, place in the text, hash."""
    h = window_hashes(points, GRAM)
    at = np.arange(len(h), dtype=np.uint64)
    low = (h & ~LOW) | (LOW - (at & LOW))  # of equal hashes the rightmost is least; the place can be read from the low bits
    size = 1
    while size * 2 <= WINDOW:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = WINDOW - size
    low = np.minimum(low[: len(low) - rest], low[rest:])
    starts = np.cumsum(lengths) - lengths
    counts = lengths - MIN_SPAN + 1
    window = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))  # windows within one text
    place = LOW - (low[window] & LOW)
    found = window + ((place.astype(np.int64) - window) & int(LOW))
    found = np.unique(found)
    text = np.searchsorted(starts, found, side="right") - 1
    return text, found - starts[text], h[found]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def scan_kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        lengths = np.array([len(p) for _, p in held])
        text, pos, h = sampled(np.concatenate([p for _, p in held]), lengths)
        ids = np.array([i for i, _ in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64))], names=["rep", "pos", "h"])

    held, size = [], 0
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p = _points(text)
            if len(p) < MIN_SPAN:
                continue
            held.append((i, p))
            size += len(p)
            if size >= PIECE:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def digests(points: np.ndarray, pos: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each span of characters."""
    raw = memoryview(points.tobytes())
    made = [hashlib.blake2b(raw[4 * p : 4 * (p + n)], digest_size=16).digest() for p, n in zip(pos.tolist(), length.tolist(), strict=True)]
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def _span_scan(edges: bool):
    """Of each text, the content keys of its paths: (rep, pos, len, key1, key2).

    A path of at least MIN_SPAN gives one key. A shorter one gives every MIN_SPAN window that holds it whole: enough to find
    each pair. With ``edges`` there are also all windows that hold the first or the last k-mer of a path, long or short: enough
    to cover each shared character.
    """

    def windows(pos: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        long = length >= MIN_SPAN
        if not edges:
            return (pos + length - MIN_SPAN)[~long], pos[~long]
        firsts, lasts = np.r_[pos + GRAM - MIN_SPAN, pos + length - MIN_SPAN], np.r_[pos, pos + length - GRAM]
        return firsts, lasts

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for rep, text, at, lens in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                points = _points(text)
                pos, length = np.array(at, np.int64), np.array(lens, np.int64)
                long = length >= MIN_SPAN
                if long.any():
                    k = digests(points, pos[long], length[long])
                    out.append((np.full(len(k), rep, np.int64), pos[long], length[long], k[:, 0], k[:, 1]))
                a, z = windows(pos, length)
                a, z = np.maximum(a, 0), np.minimum(z, len(points) - MIN_SPAN)
                ok = z >= a
                if ok.any():
                    mark = np.zeros(len(points) + 2, np.int64)  # every window start in the union of the ranges a .. z
                    np.add.at(mark, a[ok], 1)
                    np.add.at(mark, z[ok] + 1, -1)
                    w = np.flatnonzero(np.cumsum(mark)[: len(points) - MIN_SPAN + 1] > 0)
                    k = digests(points, w, np.full(len(w), MIN_SPAN))
                    out.append((np.full(len(w), rep, np.int64), w, np.full(len(w), MIN_SPAN, np.int64), k[:, 0], k[:, 1]))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int32, np.int32, np.int64, np.int64), strict=True)], names=["rep", "pos", "len", "key1", "key2"])

    return scan


def text_classes(rows: DataFrame) -> DataFrame:
    """(doc_id, rep): texts of at least MIN_SPAN characters; equal texts share the least doc_id as representative."""
    long = rows.where(F.char_length("text") >= MIN_SPAN).select("doc_id", F.sha2("text", 256).alias("_sha"))
    reps = long.groupBy("_sha").agg(F.min("doc_id").alias("rep"))
    return written(long.join(reps, "_sha").select("doc_id", "rep"), "classes")


def compacted_paths(kmers: DataFrame) -> DataFrame:
    """(rep, pos, len): each text's walks over compacted paths of repeated k-mers.

    A link between two nodes joins them if all occurrences of the first go on to the second at the same distance, and all
    occurrences of the second come from the first; the distance is at most GRAM, so the characters between are covered.
    """
    repeated = kmers.groupBy("h").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("h")
    nodes = kmers.join(repeated, "h")
    order = Window.partitionBy("rep").orderBy("pos")

    def link(step):
        gap = F.abs(step("pos").over(order) - F.col("pos"))
        return F.coalesce(F.when(gap <= GRAM, F.xxhash64(step("h").over(order), gap)), F.lit(0).cast("bigint"))

    linked = written(nodes.withColumn("into", link(F.lag)).withColumn("onto", link(F.lead)), "nodes")
    stats = linked.groupBy("h").agg(*[((F.min(c) == F.max(c)) & (F.min(c) != 0)).alias(f"{c}_same") for c in ("into", "onto")])
    marked = linked.join(stats, "h")
    goes_on = F.col("into_same") & F.coalesce(F.lag("onto_same").over(order), F.lit(False))
    numbered = marked.withColumn("_start", F.when(goes_on, 0).otherwise(1)).withColumn("_no", F.sum("_start").over(order))
    ends = numbered.groupBy("rep", "_no").agg(F.min("pos").alias("pos"), F.max("pos").alias("_last"))
    return ends.select("rep", "pos", (F.col("_last") - F.col("pos") + GRAM).cast("int").alias("len"))


def shared_keys(rows: DataFrame, classes: DataFrame, edges: bool) -> DataFrame:
    """(rep, pos, len, key1, key2): verified spans that occur in several different texts."""
    texts = rows.select(F.col("doc_id").alias("rep"), "text").where(F.char_length("text") >= MIN_SPAN)
    copies = classes.where("doc_id <> rep").select(F.col("doc_id").alias("rep"))
    kmers = written(texts.mapInArrow(scan_kmers, "rep bigint, pos int, h bigint").join(copies, "rep", "left_anti"), "kmers")
    walks = compacted_paths(kmers).groupBy("rep").agg(F.collect_list(F.struct("pos", "len")).alias("w"))  # of one text
    walks = walks.select("rep", F.col("w.pos").alias("at"), F.col("w.len").alias("lens"))
    spans = texts.join(walks, "rep").select("rep", "text", "at", "lens").mapInArrow(_span_scan(edges), "rep bigint, pos int, len int, key1 bigint, key2 bigint")
    spans = written(spans, "spans")
    several = spans.groupBy("key1", "key2").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("key1", "key2")
    return written(spans.join(several, ["key1", "key2"]), "shared")


def _pairs(members: DataFrame, by: list[str], block_rows: int = PAIR_BLOCK) -> DataFrame:
    """(a, b): pairs of the members of each group, a < b; what TESTDATA asks for is every pair, each group gives each once.

    A group is cut into blocks of about ``block_rows`` members by hash, and every two blocks meet in a task of their own, so a
    group that holds a third of all rows is paired by many.
    """
    sizes = members.groupBy(*by).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    placed = members.join(sizes, by).withColumn("_mine", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    met = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select(*by, "rep", "_mine", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"))
    a, b = (met.withColumnsRenamed({"rep": n, "_mine": f"_{n}"}) for n in ("a", "b"))
    # two members of one block meet where it meets itself
    return a.join(b, [*by, "_i", "_j"]).where((F.col("a") < F.col("b")) & ((F.col("_i") == F.col("_j")) | (F.col("_a") != F.col("_b")))).select("a", "b")


def sharing_texts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): pairs of different texts, by representative, with MIN_SPAN consecutive characters in common.

    Groups of texts met through several keys are paired once: keys with the same set of texts (two order-free fingerprints and
    the size) are represented by one.
    """
    members = shared_keys(rows, classes, edges=False).select("key1", "key2", "rep").distinct()
    sets = members.groupBy("key1", "key2").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    one = sets.groupBy("n", "x", "y").agg(F.min(F.struct("key1", "key2")).alias("k")).select("k.key1", "k.key2")
    return _pairs(members.join(one, ["key1", "key2"]), ["key1", "key2"]).distinct()


def sharing_pairs(rows: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): different records, smaller id first, with MIN_SPAN consecutive characters in common.

    Null, empty and shorter texts share nothing. ``doc_id`` is unique. An empty table gives no rows.
    """
    texts = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    classes = text_classes(texts)
    between = sharing_texts(texts, classes)
    left, right = classes.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), classes.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    across = between.join(left, "a").join(right, "b").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    copies = classes.join(classes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep"), "rep").select(F.col("rep").alias("g"), F.col("doc_id").alias("rep"))
    inside = _pairs(copies, ["g"]).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))
    return across.unionByName(inside)


def sharing_links(rows: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) of every record: its class of equal texts and how many other classes it shares a span with.

    A text shorter than MIN_SPAN, empty or null is a class of its own without links. The form for corpora with many copies, whose
    pairs would be too many to list.
    """
    texts = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    classes = text_classes(texts)
    between = written(sharing_texts(texts, classes), "links")
    degree = between.select(F.col("a").alias("rep")).unionByName(between.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    sizes = classes.groupBy("rep").agg(F.count("*").alias("n_copies")).join(degree, "rep", "left")
    known = classes.join(sizes, "rep").select("doc_id", F.col("rep").alias("class_id"), "n_copies", "n_links")
    full = texts.select("doc_id").join(known, "doc_id", "left")
    return full.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def shared_passages(rows: DataFrame) -> DataFrame:
    """(doc_id, char_from, char_to): maximal stretches of each record covered by spans that another record holds too.

    A record whose whole text occurs again is covered whole.
    """
    texts = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    classes = text_classes(texts)
    spans = shared_keys(texts, classes, edges=True).select("rep", F.col("pos").alias("a"), (F.col("pos") + F.col("len")).alias("b")).distinct()
    order = Window.partitionBy("rep").orderBy("a", "b")  # of one text
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.withColumn("_new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("_no", F.sum("_new").over(order))
    merged = cut.groupBy("rep", "_no").agg(F.min("a").alias("char_from"), F.max("b").alias("char_to")).drop("_no")
    sizes = classes.groupBy("rep").agg(F.count("*").alias("copies"))
    alone = classes.join(sizes.where("copies = 1").select("rep"), "rep").join(merged, "rep")
    copied = classes.join(sizes.where("copies > 1").select("rep"), "rep").join(texts.select("doc_id", F.char_length("text").alias("char_to")), "doc_id")
    return alone.select("doc_id", "char_from", "char_to").unionByName(copied.select("doc_id", F.lit(0).alias("char_from"), "char_to"))


def shared_shares(rows: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, n_passages, shared_share) for every record; 0 for null, empty and unshared texts."""
    sums = shared_passages(rows).groupBy("doc_id").agg(F.sum(F.col("char_to") - F.col("char_from")).alias("shared_chars"), F.count("*").alias("n_passages"))
    sized = rows.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"))
    full = sized.join(sums, "doc_id", "left").na.fill(0, ["shared_chars", "n_passages"])
    return full.withColumn("shared_share", F.coalesce(F.round(F.col("shared_chars") / F.nullif(F.col("n_chars"), F.lit(0)), 6), F.lit(0.0)))
