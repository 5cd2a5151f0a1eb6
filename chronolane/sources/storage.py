"""A catalog of series tables: bucketed, sorted Parquet segments with atomic, ordered commits.

Layout of a table: ``_meta.json`` (columns, buckets), ``data/_batch=NAME/_bucket=K/*.parquet``, ``_versions`` (see
``sources.versions``), ``rollup`` and ``dictionary``. A batch gets its place in the order when it is committed, not when its
writer starts; a compacted batch takes the place of the newest batch it replaces. Row positions order the rows of a batch, and
of several rows with one (vin, ts) the last written wins.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.functions import poly_bucket
from chronolane.operators import series
from chronolane.operators.ordered import dense_ids
from chronolane.operators.rollup import BLOCK_ROWS, aggregate_from_zones, downsample_from_zones, zone_map
from chronolane.requests import Aggregate, Downsample, Latest, TimeRange
from chronolane.sources import files
from chronolane.sources.versions import Versions, fresh_name, sweep
from chronolane.types import ColumnType, declared, series_schema

WRITE_OPTIONS = {"compression": "zstd", "parquet.writer.version": "v2"}
KEEP_S = 7 * 86_400  # what vacuum spares: a writer or reader may still use it


def bucket_of(vin: str, buckets: int) -> int:
    """The bucket of one entity, as ``poly_bucket`` computes it."""
    return zlib.crc32(vin.encode()) % buckets


class Snapshot:
    """The live batches of one version, with their places in the order; ``content`` numbers what the table holds."""

    def __init__(self, state: dict) -> None:
        self.batches: dict[str, dict] = state.get("batches", {})
        self.content: int = state.get("content", 0)

    @property
    def unique(self) -> bool:
        return len(self.batches) == 1 and next(iter(self.batches.values()))["unique"]


class TsTable:
    """One table. Reads are lazy DataFrames of the batches committed when they are made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        meta = json.loads(files.read_text(spark, f"{self.path}/_meta.json"))
        self.schema = T.StructType.fromJson(meta["schema"])
        self.buckets: int = meta["buckets"]
        self.versions = Versions(spark, f"{self.path}/_versions")

    # -- commits
    def snapshot(self) -> Snapshot:
        return Snapshot(self.versions.read()[1])

    def _put(self, rows: DataFrame) -> str:
        """Writes rows into a folder of their own; nobody sees it before it is committed."""
        name = fresh_name("b")
        (
            rows.withColumn("_bucket", poly_bucket(F.col("vin"), self.buckets))
            .repartitionByRange("_bucket", "vin", "ts")
            .sortWithinPartitions("_bucket", "vin", "ts", "_pos")
            .write.options(**WRITE_OPTIONS)
            .partitionBy("_bucket")
            .parquet(f"{self.path}/data/_batch={name}")
        )
        return name

    def _drop(self, name: str) -> None:
        files.delete(self.spark, f"{self.path}/data/_batch={name}")

    # -- writing
    def _checked(self, df: DataFrame) -> DataFrame:
        """Exactly the table's columns, cast; a missing column or a type that can't be widened raises."""
        have = {c.lower(): c for c in df.columns}
        out = []
        for f in self.schema:
            if f.name.lower() not in have:
                raise ValueError(f"the rows lack the column {f.name}")
            kind = df.schema[have[f.name.lower()]].dataType
            if kind != f.dataType and not (isinstance(f.dataType, T.LongType) and isinstance(kind, T.IntegerType)):
                raise TypeError(f"{f.name} is {kind.simpleString()}, not {f.dataType.simpleString()}")
            out.append(F.col(f"`{have[f.name.lower()]}`").cast(f.dataType).alias(f.name))
        return df.select(*out)

    def write(self, df: DataFrame, sequence: str | None = None, tag: str | None = None, transaction: tuple[str, int] | None = None) -> int | None:
        """Upserts the rows as one atomic, durable batch. Rows with a null in any column are refused (the job fails).

        ``sequence`` names a column that orders the rows; else their order in ``df`` counts. A batch whose ``tag`` was
        committed before is skipped and gives None, and so is one whose ``transaction`` (writer, number) isn't newer than the
        writer's last. Both are remembered for good, compaction or not, and are checked again when the batch is committed.
        """

        def done(state: dict) -> bool:
            return tag in state.get("tags", []) or transaction is not None and transaction[1] <= state.get("writers", {}).get(transaction[0], -1)

        if done(self.versions.read()[1]):
            return None
        order = F.col(sequence).cast("bigint") if sequence else F.monotonically_increasing_id()
        rows = df.withColumn("_order", order)
        checked = self._checked(rows.drop("_order")).columns
        filled = rows.select(
            *[F.coalesce(F.col(f"`{c}`").cast(self.schema[c].dataType), F.raise_error(F.lit(f"null in {c}"))).alias(c) for c in checked],
            F.col("_order").alias("_pos"),
        )
        name = self._put(filled)

        def add(state: dict) -> dict | None:
            if done(state):
                return None
            place = state.get("content", 0) + 1
            new = {**state, "content": place, "batches": {**state.get("batches", {}), name: {"place": place, "unique": False}}}
            if tag is not None:
                new["tags"] = [*state.get("tags", []), tag]
            if transaction is not None:
                new["writers"] = {**state.get("writers", {}), transaction[0]: transaction[1]}
            return new

        version = self.versions.change(add)
        if version is None:
            self._drop(name)
        return version

    def compact(self) -> int | None:
        """Rewrites the batches there are as one with unique keys; readers see either the old batches or the new one.

        Batches committed meanwhile stay and are newer than the compacted one. If another compaction was faster, nothing changes.
        """
        old = self.snapshot()
        if old.unique or not old.batches:
            return None
        name = self._put(self.read(snapshot=old).withColumn("_pos", F.lit(0).cast("bigint")))

        def swap(state: dict) -> dict | None:
            live = state.get("batches", {})
            if not set(old.batches) <= set(live):
                return None
            place = max(b["place"] for b in old.batches.values())
            return {**state, "batches": {name: {"place": place, "unique": True}, **{n: b for n, b in live.items() if n not in old.batches}}}

        version = self.versions.change(swap)
        if version is None:
            self._drop(name)
        return version

    def vacuum(self, older_than_s: float = KEEP_S) -> int:
        """Deletes what no longer is live and is older than that: folders of batches and rollups, version files. Gives the number of folders."""
        snap = self.snapshot()
        gone = sweep(self.spark, f"{self.path}/data", {f"_batch={n}" for n in snap.batches}, older_than_s)
        state = {n: p for n, p in self._rollups().items() if p["content"] == snap.content}
        gone += sweep(self.spark, f"{self.path}/rollup", {"_index", *(p["folder"] for p in state.values())}, older_than_s)
        self.versions.prune(older_than_s)
        return gone

    # -- reading
    def segments(self, vins: list[str] | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """All committed rows with ``_batch``, ``_pos`` and ``_bucket``; with ``vins`` only their buckets are listed and read."""
        snap = snapshot or self.snapshot()
        full = T.StructType([*self.schema.fields, T.StructField("_pos", T.LongType()), T.StructField("_batch", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        if not snap.batches:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/_batch={n}" for n in snap.batches])
        if vins is not None:
            buckets = sorted({bucket_of(v, self.buckets) for v in vins})
            rows = rows.where(F.col("_bucket").isin(buckets) & F.col("vin").isin(vins))
        return rows

    def read(self, vins: list[str] | None = None, lower: int | None = None, upper: int | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """The table's rows, last write per (vin, ts), of one snapshot. Key filters lie below the dedup and reach the scan."""
        snap = snapshot or self.snapshot()
        rows = self.segments(vins, snap)
        if lower is not None:
            rows = rows.where(F.col("ts") >= lower)
        if upper is not None:
            rows = rows.where(F.col("ts") < upper)
        names = [f.name for f in self.schema]
        if snap.unique or not snap.batches:
            return rows.select(*names)
        places = F.create_map(*[F.lit(x) for n, b in snap.batches.items() for x in (n, b["place"])])
        rows = rows.withColumn("_seq", F.struct(F.element_at(places, F.col("_batch")).alias("place"), "_pos")).drop("_batch", "_pos", "_bucket")
        return series.resolve_upserts(rows, "_seq").select(*names)

    # -- queries
    def latest(self, request: Latest) -> DataFrame:
        return series.latest(self.read(None if request.vins is None else list(request.vins)), request)

    def time_range(self, request: TimeRange) -> DataFrame:
        return series.time_range(self.read([request.vin], request.lower, request.upper), request)

    def point(self, vin: str, times: list[int], columns: tuple[str, ...] = ()) -> DataFrame:
        """The rows of one entity at exactly these times; only its bucket is read, and in it only row groups that can hold them."""
        rows = self.read([vin], min(times, default=0), max(times, default=-1) + 1).where(F.col("ts").isin(times))
        return rows.select("vin", "ts", *(columns or [f.name for f in self.schema if f.name not in ("vin", "ts")]))

    def _with_rollup(self, request: Aggregate) -> tuple[DataFrame, DataFrame | None]:
        """Rows and rollup of the same snapshot."""
        snap = self.snapshot()
        return self.read([request.vin], request.lower, request.upper, snap), self.rollup(snapshot=snap)

    def aggregate(self, request: Aggregate) -> DataFrame:
        """From the rollup, if one was built of the present rows, raw rows being read for cut blocks only; else from rows.

        An AVG from block sums may differ from a row-wise one in the last digits.
        """
        rows, zones = self._with_rollup(request)
        return series.aggregate(rows, request) if zones is None else aggregate_from_zones(rows, zones, request)

    def downsample(self, request: Downsample) -> DataFrame:
        """From the rollup as far as whole blocks decide, as ``aggregate``; else from rows."""
        rows, zones = self._with_rollup(request)
        return series.downsample(rows, request) if zones is None else downsample_from_zones(rows, zones, request)

    # -- rollups, dictionary and size
    def _rollups(self) -> dict[str, dict]:
        where = f"{self.path}/rollup/_index"
        return {n: json.loads(files.read_text(self.spark, f"{where}/{n}")) for n in files.names(self.spark, where) if n.endswith(".json")}

    def build_rollup(self, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """Writes the zone map of the present rows and returns it; ``rollup`` refuses it after a later write, not after a compaction."""
        snap = self.snapshot()
        if (zones := self.rollup(block_rows, snap)) is None:
            folder = fresh_name(f"r{block_rows}")
            made = zone_map(self.read(snapshot=snap), block_rows).repartitionByRange("vin", "blk").sortWithinPartitions("vin", "blk")
            made.write.options(**WRITE_OPTIONS).parquet(f"{self.path}/rollup/{folder}")
            files.make_dir(self.spark, f"{self.path}/rollup/_index")
            files.write_new(self.spark, f"{self.path}/rollup/_index/{block_rows}-{snap.content}.json", json.dumps({"folder": folder, "content": snap.content}))
            zones = self.rollup(block_rows, snap)
        return zones

    def rollup(self, block_rows: int = BLOCK_ROWS, snapshot: Snapshot | None = None) -> DataFrame | None:
        snap = snapshot or self.snapshot()
        index = f"{self.path}/rollup/_index/{block_rows}-{snap.content}.json"
        if not files.exists(self.spark, index):
            return None
        return self.spark.read.parquet(f"{self.path}/rollup/{json.loads(files.read_text(self.spark, index))['folder']}")

    def _dictionary(self, state: dict) -> DataFrame:
        if not state.get("folders"):
            return self.spark.createDataFrame([], "vin string, vin_id int")
        return self.spark.read.schema("vin string, vin_id int").parquet(*[f"{self.path}/dictionary/{f}" for f in state["folders"]])

    def dictionary(self) -> DataFrame:
        """(vin, vin_id), stored. Ids are dense and never change: entities that are new since the last call get the next ones, in their own order."""
        log = Versions(self.spark, f"{self.path}/dictionary/_versions")
        while True:
            number, state = log.read()
            known = self._dictionary(state)
            new = self.read().select("vin").distinct().join(known.select("vin"), "vin", "left_anti")
            folder, size = fresh_name("d"), state.get("size", 0)
            dense_ids(new, "vin", "vin_id").withColumn("vin_id", (F.col("vin_id") + size).cast("int")).write.parquet(f"{self.path}/dictionary/{folder}")
            added = self._dictionary({"folders": [folder]}).count()
            if not added:
                files.delete(self.spark, f"{self.path}/dictionary/{folder}")
                return known
            new_state = {"folders": [*state.get("folders", []), folder], "size": size + added}
            if log.commit(number + 1, new_state):
                return self._dictionary(new_state)
            files.delete(self.spark, f"{self.path}/dictionary/{folder}")  # another writer was faster: its ids count

    def stored_bytes(self) -> int:
        return sum(files.size(self.spark, f"{self.path}/data/_batch={n}") for n in self.snapshot().batches)

    def compression(self) -> DataFrame:
        """One row (n_rows, raw_bytes, stored_bytes, ratio). Raw: 8 bytes of ``ts`` and each double, 4 of an int, a string's own."""
        fixed = {T.IntegerType: 4, T.LongType: 8, T.DoubleType: 8}
        cells = [F.octet_length(f.name) if isinstance(f.dataType, T.StringType) else F.lit(fixed[type(f.dataType)]) for f in self.schema]
        width = cells[0]
        for c in cells[1:]:
            width = width + c
        sums = self.read().agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(width), F.lit(0)).cast("bigint").alias("raw_bytes"))
        sums = sums.withColumn("stored_bytes", F.lit(self.stored_bytes()).cast("bigint"))
        return sums.withColumn("ratio", F.col("stored_bytes") / F.nullif(F.col("raw_bytes"), F.lit(0)))


class TsCatalog:
    """Tables below one directory, which must exist."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        if not files.is_dir(spark, path):
            raise FileNotFoundError(path)
        self.spark, self._path = spark, path.rstrip("/")

    @property
    def path(self) -> str:
        return self._path

    def create_table(self, name: str, columns: dict[str, ColumnType], buckets: int = 32) -> TsTable:
        meta = {"schema": json.loads(series_schema(columns).json()), "buckets": buckets}
        files.make_dir(self.spark, f"{self._path}/{name}")
        if not files.write_new(self.spark, f"{self._path}/{name}/_meta.json", json.dumps(meta)):
            raise FileExistsError(f"table {name} exists")
        return TsTable(self.spark, f"{self._path}/{name}")

    def table(self, name: str) -> TsTable:
        if not files.exists(self.spark, f"{self._path}/{name}/_meta.json"):
            raise KeyError(name)
        return TsTable(self.spark, f"{self._path}/{name}")

    def tables(self) -> list[str]:
        return [n for n in files.names(self.spark, self._path) if files.exists(self.spark, f"{self._path}/{n}/_meta.json")]

    def shutdown(self) -> None:
        """Nothing is pending: every committed batch is durable. Cached data are released."""
        self.spark.catalog.clearCache()


def columns_of(df: DataFrame) -> dict[str, ColumnType]:
    return declared(df.schema)
