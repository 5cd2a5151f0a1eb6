"""Messages delivered more than once: a Bloom filter per UTC day, exact checks only against the stored log of matching days.

The filter is register-blocked: an identifier belongs to one block of its day and sets four bits of the block's 64-bit word.
Ingesting a batch, each block's identifiers pass in order of delivery over its word, which starts as stored: whoever finds all
its bits set is a possible repeat, all others are proved new and done. The word after the last one is what is stored. So the
log, the words and the probing share one shuffle of narrow rows, and only possible repeats are compared with the log.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolane.functions import fold_text
from chronolane.operators.ordered import DAY_MS, arrival_cuts, arrival_slices
from chronolane.session import scratch_path
from chronolane.sources import files
from chronolane.sources.versions import Versions, fresh_name

BLOCKS = 1 << 20  # per day, of a store whose size isn't known beforehand
PER_WORD = 8  # identifiers per 64-bit word if all came on one day: about 2 % false positives; else fewer
PIECE_ROWS = 5_000_000  # of a day's rows, those of one task
FOLDERS = 1024  # days are counted around, so that any day has a folder
CHUNK_ROWS = 500_000
SLICES = 2
ORDER = ("recv_at", "batch_id", "batch_pos")
RANK = "_at bigint, batch_id bigint, batch_pos int, row_id bigint"
KEY = ["_bucket", "_vin", "ts"]
SENT = f"_vin string, ts bigint, {RANK}, _settled boolean"
LOG = f"_bucket int, _piece int, _block int, _vin string, ts bigint, {RANK}, _settled boolean, _maybe boolean, _near boolean, _bits bigint"


def message_key(rows: DataFrame) -> DataFrame:
    """Adds ``_vin`` (spelling folded), ``_bucket`` (UTC day of ``ts``) and drops rows without an identifier."""
    named = rows.where(F.col("vin").isNotNull() & F.col("ts").isNotNull())
    return named.withColumn("_vin", fold_text(F.col("vin"))).withColumn("_bucket", _day())


def _day() -> Column:
    return F.floor(F.col("ts") / F.lit(float(DAY_MS))).cast("int")


def _folder() -> Column:
    return F.pmod(F.col("_bucket"), F.lit(FOLDERS)).cast("int")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("_vin", "ts"), F.lit(blocks)).cast("int")


def _mask() -> Column:
    """Four bits of a 64-bit word, from a second hash."""
    h = F.xxhash64(F.lit("bits"), "ts", "_vin")
    one = F.lit(1).cast("bigint")
    bit = lambda i: F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    return reduce(lambda x, y: x.bitwiseOR(y), [bit(i) for i in range(4)])


def _rank() -> Column:
    return F.struct("_at", "batch_id", "batch_pos", "row_id")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks, where the rows are read, all but the last copy of a message inside one delivery batch.

    So a message sends at most one row per delivery batch and chunk, however often it was repeated in it.
    """

    def number(t: pa.Table, name: str) -> np.ndarray:
        c = t[name].combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        return c.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)  # nulls come first

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        names = t["_vin"].combine_chunks()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        vin = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ts, at, batch, pos, row = (number(t, c) for c in ("ts", "_at", "batch_id", "batch_pos", "row_id"))
        order = np.lexsort((row, pos, at, batch, ts, vin))
        same = np.ones(len(order) - 1, bool)
        for c in (vin, ts, batch):
            same &= c[order][1:] == c[order][:-1]
        settled = np.zeros(len(order), bool)
        settled[order[:-1]] = same  # a later copy of the same batch follows
        for b in t.append_column("_settled", pa.array(settled)).to_batches():
            yield b

    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= CHUNK_ROWS:
            yield from flush(held)
            held, rows = [], 0
    if rows:
        yield from flush(held)


class MessageStore:
    """Identifiers seen so far, below a path of the shared file system; it can be reopened by its path.

    A batch is one folder of the log, split by day; a version (``sources.versions``) lists the folders, so a batch is stored
    whole or not at all. ``blocks`` and ``pieces`` per day are fixed when the store is made.
    """

    def __init__(self, spark: SparkSession, path: str, blocks: int = BLOCKS, pieces: int = 1) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/_versions")
        self.versions.change(lambda state: None if state else {"blocks": blocks, "pieces": pieces, "batches": []})
        state = self.versions.read()[1]
        self.blocks, self.pieces = state["blocks"], state["pieces"]

    def _log(self, batches: list[str], folders: list[int] | None = None) -> DataFrame:
        """One scan of these batches' log; ``folders`` prunes it to days."""
        if not batches:
            return self.spark.createDataFrame([], f"{LOG}, _dir int")
        read = self.spark.read.schema(f"{LOG}, _batch string, _dir int").option("basePath", f"{self.path}/log")
        rows = read.parquet(*[f"{self.path}/log/_batch={b}" for b in batches]).drop("_batch")
        return rows if folders is None else rows.where(F.col("_dir").isin(folders))

    def words(self, batches: list[str], folders: list[int] | None = None) -> DataFrame:
        """(_bucket, _piece, _block, _bits): the filters' words."""
        kept = self._log(batches, folders).where(F.col("_bits").isNotNull())
        return kept.groupBy("_bucket", "_piece", "_block").agg(F.bit_or("_bits").alias("_bits"))

    def _screened(self, batch: DataFrame, words: DataFrame | None) -> DataFrame:
        """The batch's rows with ``_maybe`` (a possible repeat), ``_near`` (its block has one) and, on a block's last row, the word."""
        named = message_key(batch.select("row_id", "vin", "ts", *ORDER))
        at = F.unix_micros(F.col("recv_at").cast("timestamp")).alias("_at")
        sent = named.select("_vin", "ts", at, F.col("batch_id").cast("bigint").alias("batch_id"), F.col("batch_pos").cast("int").alias("batch_pos"), F.col("row_id").cast("bigint").alias("row_id"))
        rows = sent.mapInArrow(_settle, SENT).withColumn("_bucket", _day()).withColumn("_word", F.lit(False))
        # settled copies are only listed: each is a block of its own, without bits
        rows = rows.withColumn("_block", F.when(F.col("_settled"), F.hash("row_id")).otherwise(_block(self.blocks)))
        rows = rows.withColumn("_piece", F.pmod("_block", F.lit(self.pieces))).withColumn("_m", F.when(~F.col("_settled"), _mask()))
        if words is not None:  # a stored word is the first to pass
            mine = {"_bucket": F.col("_bucket"), "_piece": F.col("_piece"), "_block": F.col("_block"), "_m": F.col("_bits"), "_settled": F.lit(False), "_word": F.lit(True)}
            rows = rows.unionByName(words.select(*[mine.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]))
        block = Window.partitionBy("_bucket", "_piece", "_settled", "_block")
        order = block.orderBy(~F.col("_word"), "_at", "batch_id", "batch_pos", "row_id")
        before = F.bit_or("_m").over(order.rowsBetween(Window.unboundedPreceding, -1))
        passed = rows.repartition("_bucket", "_piece").withColumn("_seen", F.coalesce(before, F.lit(0).cast("bigint"))).withColumn("_next", F.lead("_m").over(order))
        found = ~F.col("_word") & ~F.col("_settled") & (F.col("_seen").bitwiseAND(F.col("_m")) == F.col("_m"))
        passed = passed.withColumn("_maybe", found).withColumn("_near", F.max("_maybe").over(block)).where(~F.col("_word"))
        return passed.withColumn("_bits", F.when(F.col("_next").isNull(), F.col("_seen").bitwiseOR(F.col("_m"))))

    def ingest(self, batch: DataFrame, folders: list[int] | None = None) -> DataFrame:
        """Takes a batch (row_id, vin, ts, recv_at, batch_id, batch_pos); gives (row_id, how) of every row to drop.

        ``how`` is 'batch' for a copy inside one delivery batch, 'log' for a repeat that the filter let pass and the log
        confirmed. A dropped row is a row of this batch or the one kept so far. The greatest by (recv_at, batch_id,
        batch_pos), then row_id, stays; nulls come first. ``folders``: the day folders the batch may touch, if known. If another
        writer was faster, the batch is screened again, with what it left.
        """
        while True:
            number, state = self.versions.read()
            earlier = state["batches"]
            if earlier and folders is None:
                folders = [r[0] for r in message_key(batch.select("vin", "ts")).select(_folder()).distinct().collect()]  # at most FOLDERS
            name = fresh_name("m")
            screened = self._screened(batch, self.words(earlier, folders) if earlier else None)
            screened.withColumn("_dir", _folder()).select(*[c.split()[0] for c in LOG.split(", ")], "_dir").write.partitionBy("_dir").parquet(f"{self.path}/log/_batch={name}")
            if self.versions.commit(number + 1, {**state, "batches": [*earlier, name]}):
                return self._drops(name, earlier)
            files.delete(self.spark, f"{self.path}/log/_batch={name}")

    def _drops(self, name: str, earlier: list[str]) -> DataFrame:
        """Possible repeats of a stored batch, verified against the log of their days, and its settled copies."""
        mine = self._log([name])
        possible = mine.where("_maybe")
        ids = possible.select(*KEY).distinct()
        ranked = lambda log: log.where("NOT _settled").join(ids, KEY, "left_semi").select(*KEY, _rank().alias("_rank"))
        same = ranked(mine.where("_near"))  # only rows of blocks with a possible repeat can be what it repeats
        if earlier:
            days = [r[0] for r in possible.select("_dir").distinct().collect()]  # at most FOLDERS
            same = same.unionByName(ranked(self._log(earlier, days)).groupBy(*KEY).agg(F.max("_rank").alias("_rank")))
        # a message has at most one row per delivery batch here
        best = F.max("_rank").over(Window.partitionBy(*KEY))
        repeats = same.withColumn("_best", best).where(~F.col("_rank").eqNullSafe(F.col("_best"))).select("_rank.row_id", F.lit("log").alias("how"))
        return mine.where("_settled").select("row_id", F.lit("batch").alias("how")).unionByName(repeats)


def repeats(rows: DataFrame, slices: int = SLICES, blocks: int | None = None, pieces: int | None = None) -> DataFrame:
    """(row_id, how) of each row of a whole table to drop, by ingesting it in ``slices`` of arrival, equal in rows.

    Rows with a null vin or ts are never dropped; an empty table drops none; other columns don't matter.
    """
    spark = rows.sparkSession
    wanted = rows.select("row_id", "vin", "ts", *ORDER)
    folder = F.pmod(F.floor(F.col("ts") / F.lit(float(DAY_MS))).cast("int"), F.lit(FOLDERS))
    cuts, seen = arrival_cuts(wanted, "recv_at", slices, n=F.count("*"), folders=F.collect_set(folder))
    blocks = blocks or 1 << min(30, max(8, (seen.n // PER_WORD).bit_length()))
    pieces = pieces or -(-seen.n // (3 * PIECE_ROWS)) or 1  # a day may hold a third of all rows
    store = MessageStore(spark, scratch_path(spark, "messages"), blocks, pieces)
    drops = [store.ingest(part, seen.folders) for part in arrival_slices(wanted, "recv_at", cuts)]
    return reduce(lambda x, y: x.unionByName(y), drops)


def repeated_rows(rows: DataFrame, slices: int = SLICES, blocks: int | None = None, pieces: int | None = None) -> DataFrame:
    """``repeats`` without ``how``."""
    return repeats(rows, slices, blocks, pieces).select("row_id")


def once_each(rows: DataFrame, slices: int = SLICES) -> DataFrame:
    """All columns of the rows that stay: one per message, the one that arrived last; rows without an identifier stay too."""
    return rows.join(repeated_rows(rows, slices), "row_id", "left_anti")
