"""Store of occupancy bins with snapshots.

Every refresh writes new files and then one manifest that names all files of the
new snapshot: the bins of each (interval, day), the chunk ledger and the registry
of source spaces. A manifest is created under the next number and only if nobody
else has created it, and counts only when complete. So bins and ledger change
together, a reader keeps the snapshot it has opened, and a refresh that fails
before its manifest has changed nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from py4j.protocol import Py4JJavaError

from roamlens.functions.times import ts
from roamlens.operators.chunks import (
    LEDGER_SCHEMA, align_gaps, bins_of_days, coverage_gaps, days_of, drop_stale, stale_chunks,
)
from roamlens.operators.tree import (
    BIN, bin_changes, classify_spaces, delta_rollup, descendants, flow_changes, source_flows,
)
from roamlens.session import durable

BINS_SCHEMA = (
    "space_id INT, interval_begin_time TIMESTAMP_NTZ, own_connections LONG, number_connections LONG,"
    " interval_seconds INT, day DATE"
)
SOURCES_SCHEMA = "space_id INT, interval_seconds INT"


class Snapshot:
    """What one manifest names. ``parts`` is {"interval/day": id of the files}."""

    def __init__(
        self, store: BinStore, version: int, parts: dict[str, str], ledger: str | None, sources: str | None,
        batches: dict[str, int] | None = None,
    ):
        self.store, self.version, self.parts = store, version, parts
        self._ledger, self._sources = ledger, sources
        self.batches = batches or {}  # the last batch of each stream that writes here

    def _table(self, kind: str, name: str | None, schema: str) -> DataFrame:
        spark = self.store.spark
        if name is None:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.store.path}/{kind}/{name}")

    def ledger(self) -> DataFrame:
        return self._table("ledger", self._ledger, LEDGER_SCHEMA)

    def sources(self, interval_s: int) -> DataFrame:
        """(space_id): every space that has had sessions in this dataset."""
        found = self._table("sources", self._sources, SOURCES_SCHEMA)
        return found.where(F.col("interval_seconds") == interval_s).select("space_id")

    def bins(self, interval_s: int | None = None, days: Iterable[date] | None = None) -> DataFrame:
        """The stored bins; only the files of the asked interval and days are opened."""
        wanted = None if days is None else {d.isoformat() for d in days}
        paths = []
        for part, name in sorted(self.parts.items()):
            interval, day = part.split("/")
            if interval_s in (None, int(interval)) and (wanted is None or day in wanted):
                paths.append(self.store.part_path(int(interval), day, name))
        spark = self.store.spark
        if not paths:
            return spark.createDataFrame([], BINS_SCHEMA)
        # the schema is given: partition columns come from the paths, nothing is opened to infer types
        found = spark.read.option("basePath", f"{self.store.path}/bins").schema(BINS_SCHEMA + ", snapshot STRING").parquet(*paths)
        return found.drop("snapshot")


class BinStore:
    """Occupancy bins of any number of intervals under ``path``, a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def part_path(self, interval_s: int, day: str, name: str) -> str:
        return f"{self.path}/bins/interval_seconds={interval_s}/day={day}/snapshot={name}"

    def _file(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def _versions(self) -> list[int]:
        fs, folder = self._file(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[:12]) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest complete snapshot, or the given one."""
        for v in reversed(self._versions()):
            if version in (None, v):
                text = "\n".join(r.value for r in self.spark.read.text(self._manifest(v)).collect())
                try:
                    m = json.loads(text)
                except ValueError:  # its writer has not come to the end
                    continue
                return Snapshot(self, v, m["parts"], m["ledger"], m["sources"], m["batches"])
        if version is not None:
            raise ValueError(f"no snapshot {version}")
        return Snapshot(self, 0, {}, None, None)

    def write_table(self, df: DataFrame, kind: str) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{kind}/{name}")
        return name

    def write_bins(self, rows: DataFrame, interval_s: int, days: Iterable[date]) -> dict[str, str | None]:
        """Write the bins of whole days; {"interval/day": id, or None where no bin is left}."""
        name = uuid.uuid4().hex
        (
            rows.select(*BIN, "own_connections", "number_connections")
            .withColumns({"interval_seconds": F.lit(interval_s), "day": F.to_date("interval_begin_time"), "snapshot": F.lit(name)})
            .repartition("day").write.mode("append").partitionBy("interval_seconds", "day", "snapshot").parquet(f"{self.path}/bins")
        )
        written = {}
        for d in days:
            fs, folder = self._file(self.part_path(interval_s, d.isoformat(), name))
            written[f"{interval_s}/{d.isoformat()}"] = name if fs.exists(folder) else None
        return written

    def commit(
        self, base: Snapshot, written: dict[str, str | None], ledger: str | None = None, sources: str | None = None,
        batch: tuple[str, int] | None = None,
    ) -> Snapshot:
        """Make what was written the newest snapshot; an error if another has come in since ``base``."""
        parts = {k: v for k, v in (base.parts | written).items() if v is not None}
        batches = base.batches | dict([batch] if batch else [])
        manifest = {"parts": parts, "ledger": ledger or base._ledger, "sources": sources or base._sources, "batches": batches}
        version = max([0, *self._versions()]) + 1
        if self.snapshot().version != base.version:
            raise RuntimeError("the store has changed since it was read: refresh again")
        fs, target = self._file(self._manifest(version))
        try:
            out = fs.create(target, False)
        except (Py4JJavaError, PySparkException) as e:
            raise RuntimeError("another refresh was faster: refresh again") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return Snapshot(self, version, parts, manifest["ledger"], manifest["sources"], batches)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the newest ``keep`` snapshots names; returns how many folders."""
        kept = [self.snapshot(v) for v in self._versions()[-keep:]]
        named = {self.part_path(int(k.split("/")[0]), k.split("/")[1], n) for s in kept for k, n in s.parts.items()}
        named |= {f"{self.path}/{kind}/{n}" for s in kept for kind, n in (("ledger", s._ledger), ("sources", s._sources))}
        gone = 0
        for pattern in ("bins/*/*/*", "ledger/*", "sources/*"):
            fs, found = self._file(f"{self.path}/{pattern}")
            for f in fs.globStatus(found) or []:
                full = f.getPath().toUri().getPath()
                if f.isDirectory() and not any(full.endswith(n.split(":", 1)[-1]) for n in named):
                    gone += bool(fs.delete(f.getPath(), True))
        return gone


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """(space_id, interval_begin_time, number_connections, interval_seconds, day) of the newest snapshot."""
    return BinStore(spark, path).snapshot().bins().drop("own_connections").where("number_connections > 0")


def _days(*frames: DataFrame) -> list[date]:
    """Days of some bins: at most one per day of the range, however many bins."""
    found: set[date] = set()
    for df in frames:
        found |= {r.day for r in df.select(F.to_date("interval_begin_time").alias("day")).distinct().collect()}
    return sorted(found)


def update_days(
    state: Snapshot, own: DataFrame, spaces: DataFrame | None, busy: DataFrame, tree: DataFrame, interval_s: int, days: list[date],
) -> tuple[dict[str, str | None], str | None]:
    """Write the days in which bins change; (what was written, id of the new registry if it grew).

    ``own`` are the recomputed bins of source spaces on ``days``, for ``spaces``
    (None: all); ``busy`` the spaces with sessions. The stored bins of these days
    are compared with them; see ``apply_changes``.
    """
    old = _own(state, interval_s, days)
    if spaces is not None:
        inside = spaces.select("space_id").distinct()
        old, own = old.join(inside, "space_id", "left_semi"), own.join(inside, "space_id", "left_semi")
    return apply_changes(state, durable(bin_changes(old, own)), busy, tree, interval_s)


def _own(state: Snapshot, interval_s: int, days: Iterable[date] | None = None) -> DataFrame:
    return state.bins(interval_s, days).where("own_connections > 0").select(*BIN, F.col("own_connections").alias("number_connections"))


def apply_changes(
    state: Snapshot, changes: DataFrame, busy: DataFrame, tree: DataFrame, interval_s: int,
) -> tuple[dict[str, str | None], str | None]:
    """Carry changes of source bins (space_id, interval_begin_time, change) through the store.

    They run along the flows of the registered sources into every space above, also
    above the refreshed subtree. New sources change flows: bins of the spaces
    concerned move on all their stored days. Files of other days are neither read
    nor written.
    """
    store = state.store
    known = durable(state.sources(interval_s))
    fresh = durable(busy.select("space_id").where("space_id IS NOT NULL").distinct().join(known, "space_id", "left_anti"))
    grown = known.unionByName(fresh)
    flows = durable(source_flows(tree, grown))
    moved = stored = registry = None
    if not fresh.isEmpty():
        moved = durable(flow_changes(source_flows(tree, known), flows))
        stored = _own(state, interval_s)
        others = state._table("sources", state._sources, SOURCES_SCHEMA).where(F.col("interval_seconds") != interval_s)
        registry = store.write_table(grown.withColumn("interval_seconds", F.lit(interval_s)).unionByName(others).coalesce(1), "sources")
    delta = durable(delta_rollup(changes, flows, moved, stored))
    touched = _days(changes, delta)
    if not touched:
        return {}, registry
    zero = F.lit(0).cast("long")
    rows = (
        state.bins(interval_s, touched).select(*BIN, "own_connections", "number_connections")
        .unionByName(changes.select(*BIN, F.col("change").alias("own_connections"), zero.alias("number_connections")))
        .unionByName(delta.select(*BIN, zero.alias("own_connections"), F.col("change").alias("number_connections")))
        .groupBy(*BIN).agg(F.sum("own_connections").alias("own_connections"), F.sum("number_connections").alias("number_connections"))
        .where("own_connections <> 0 OR number_connections <> 0")
    )
    return store.write_bins(rows, interval_s, touched), registry


def refresh_occupancy(
    s: DataFrame, tree: DataFrame, root: int, path: str, interval_s: int, start, end, completed_at, force: bool = False,
) -> Snapshot:
    """Bring the store up to date for the subtree of ``root`` in [start, end).

    Stale chunks leave the ledger first, so late sessions are counted; then the
    gaps that remain, widened to whole days, are recomputed for the spaces with
    sessions and those registered earlier, and the changes are carried to all
    spaces above. ``force`` recomputes the whole window, for sessions that were
    removed or corrected. Data, ledger and registry become visible together.
    """
    store = BinStore(s.sparkSession, path)
    state = store.snapshot()
    spaces = classify_spaces(tree, s, root, start, end)
    inside = durable(descendants(tree, root).select("space_id"))
    registered = state.sources(interval_s).join(inside, "space_id", "left_semi").withColumn("space_type", F.lit("source"))
    spaces = durable(
        spaces.unionByName(registered).groupBy("space_id").agg(F.max("space_type").alias("space_type"))  # 'source' wins
    )
    stale = stale_chunks(state.ledger(), s, tree, root, interval_s, start, end)
    ledger = durable(drop_stale(state.ledger(), stale))
    gaps = durable(align_gaps(coverage_gaps(ledger, spaces, interval_s, start, end, force)))
    asked = days_of(gaps)
    days = sorted(r.day for r in asked.collect())
    busy = spaces.where("space_type = 'source'")
    written, registry = update_days(state, bins_of_days(s, asked, interval_s), busy, busy, tree, interval_s, days)
    done = gaps.join(spaces, "space_id").select(
        "space_id", F.lit(interval_s).alias("interval_seconds"),
        F.col("gap_start").alias("chunk_start"), F.col("gap_end").alias("chunk_end"),
        "space_type", F.lit("COMPLETED").alias("status"), ts(completed_at).alias("completed_at"),
    )
    return store.commit(state, written, store.write_table(ledger.unionByName(done).coalesce(1), "ledger"), registry)
