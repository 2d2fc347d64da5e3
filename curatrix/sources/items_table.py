"""The items table in layers of buckets: a merge reads the stored layers where they lie, shuffles the batch alone and appends a layer.

Each layer is a Parquet table bucketed and sorted by ``dedup_hash``, as Spark's catalog knows them; the first is the base, later ones hold the items that a
merge has made or changed. Of an item the newest layer counts. After ``MOST_LAYERS`` merges the layers are written as a new base. A pointer, a row for each
state, names the layers; what it doesn't name is not part of the table, so that a merge which fails changes nothing.

One writer is assumed: Parquet has no transactions, and of two merges at once the later pointer would win.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scores import derive_confidence
from ..functions.times import iso
from ..operators.ingest import FACTS, OCCURRENCES, REASONS
from ..storage import drop_folder, has_files, remove, stored

KEY = "dedup_hash"
#: Merges after which layers become a new base.
MOST_LAYERS = 8


class ItemsTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, most_layers: int = MOST_LAYERS):
        """buckets: of a new table; one that is there keeps its own. Some 256 MB of items each at its final size keep a bucket within a task."""
        self.spark, self.path, self.most_layers = spark, path.rstrip("/"), most_layers
        self.buckets = state.buckets if (state := self._state()) else buckets

    # Layers.

    def _state(self):
        if not has_files(self.spark, f"{self.path}/pointer"):
            return None
        return self.spark.read.parquet(f"{self.path}/pointer").orderBy(F.desc("n")).first()

    def _point(self, layers: list[str], schema: str, token: str | None = None, tallies: dict[str, int] | None = None) -> None:
        state = self._state()
        n = state.n + 1 if state else 1
        row = self.spark.createDataFrame([(n, layers, schema, self.buckets, token, tallies)], "n long, layers array<string>, schema string, buckets int, token string, tallies map<string,long>")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")

    def tallies(self) -> DataFrame:
        """(n, token, tallies): what each merge counted while it wrote, in order."""
        return self.spark.read.parquet(f"{self.path}/pointer").filter("tallies IS NOT NULL").select("n", "token", "tallies").orderBy("n")

    def _name(self, layer: str) -> str:
        return "items_" + re.sub(r"\W", "_", f"{self.path}_{layer}")[-100:]

    def _register(self, layer: str, schema: str) -> DataFrame:
        """The layer as a bucketed table; a session that did not write it tells the catalog of it first."""
        name = self._name(layer)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(schema)))
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{layer}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, layer: str, dealt: bool) -> None:
        """dealt: the rows lie by bucket already."""
        rows = rows if dealt else rows.repartition(self.buckets, KEY)
        writer = rows.write.mode("append").format("parquet").option("compression", "zstd").option("path", f"{self.path}/{layer}")
        writer.bucketBy(self.buckets, KEY).sortBy(KEY).saveAsTable(self._name(layer))

    def layers(self) -> list[DataFrame]:
        """Oldest first."""
        state = self._state()
        return [self._register(layer, state.schema) for layer in state.layers] if state else []

    def _current(self, layers: list[DataFrame]) -> list[DataFrame]:
        """Each layer without the items that a newer one has; layers lie by bucket, so that nothing is shuffled."""
        out = []
        for k, layer in enumerate(layers):
            for newer in layers[k + 1 :]:
                layer = layer.join(newer.select(F.col(KEY).alias("newer_hash")), F.col(KEY) == F.col("newer_hash"), "left_anti")
            out.append(layer)
        return out

    def read(self) -> DataFrame | None:
        """The items; None before the first merge."""
        parts = self._current(self.layers())
        out = parts[0] if parts else None
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    # Merging.

    def touched(self, batch: DataFrame) -> DataFrame:
        """The stored items that a batch (column dedup_hash) falls on, of the newest layer each. Only the batch's hashes are sent."""
        keys = batch.select(F.col(KEY).alias("batch_hash")).distinct().repartition(self.buckets, "batch_hash")
        out = None
        for age, layer in enumerate(self.layers()):
            found = layer.join(keys, F.col(KEY) == F.col("batch_hash")).drop("batch_hash").withColumn("age", F.lit(age))
            out = found if out is None else out.unionByName(found)
        newest = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("age")))
        return out.withColumn("nth", newest).filter("nth = 1").drop("nth", "age")

    def merge(self, batch: DataFrame, token: str | None = None) -> dict[str, int]:
        """Merge normalised items (operators.ingest.normalize) as ``merge_items`` does; merging a batch twice changes nothing more.

        Returns the batch's tallies: landed, rejected by reason (``reject_unknown_source`` ...), inserted and duplicates. They are observed on the
        plans that write, so that no row is read for them, and stand in the pointer. token: the name of a batch; one that the pointer knows
        is not merged again, and its tallies are those of the first time.
        """
        if token and self._state() and (told := self.tallies().filter(F.col("token") == token).first()):
            return dict(told.tallies)
        seen, made = Observation(), Observation()
        reasons = {f"reject_{r}": F.count_if(F.coalesce("reject_reason", F.lit("")) == r).alias(f"reject_{r}") for r in REASONS}
        normal = stored(batch.observe(seen, F.count(F.lit(1)).alias("landed"), *reasons.values()), "normalised")
        fresh = stored(first_and_sightings(normal), "batch")
        remove(normal)
        layers = self.layers()
        changed = merged(fresh, self.touched(fresh) if layers else None, marked=True)
        changed = changed.observe(made, F.count_if("is_new").alias("inserted")).drop("is_new")
        layer = f"layer-{uuid.uuid4().hex}"
        self._write(changed, layer, dealt=False)
        remove(fresh)
        tallies = {k: int(v) for k, v in (seen.get | made.get).items()}
        tallies["duplicates"] = tallies["landed"] - tallies["inserted"] - sum(tallies[r] for r in reasons)
        state = self._state()
        self._point([*(state.layers if state else []), layer], self.spark.table(self._name(layer)).schema.json(), token, tallies)
        if len(layers) + 1 > self.most_layers:
            self.compact()
        return tallies

    def compact(self) -> None:
        """Write the layers as one base and drop them. Each layer's rows stay in their buckets."""
        state, layers = self._state(), self.layers()
        base = f"base-{uuid.uuid4().hex}"
        for part in self._current(layers):
            self._write(part, base, dealt=True)
        self._point([base], self.spark.table(self._name(base)).schema.json())
        for layer in state.layers:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(layer)}")
            drop_folder(self.spark, f"{self.path}/{layer}")


def first_and_sightings(batch: DataFrame) -> DataFrame:
    """Of each hash of a batch of normalised items the first item (columns FACTS) and ``seen``: the first sighting of each source and URL, in order.

    The sightings of a hash are made distinct before they are gathered, so that a hot hash gathers no more than its sources and URLs.
    """
    rows = batch.filter("reject_reason IS NULL").withColumn("at", F.struct("batch_id", "pos", "source_id"))
    each = rows.groupBy(KEY, F.col("source_id").alias("seen_source"), F.col("canonical_url").alias("seen_url")).agg(F.min(F.struct("at", iso(F.col("fetched_at")).alias("seen_at"))).alias("first"))
    gathered = each.groupBy(F.col(KEY).alias("of_hash")).agg(F.array_sort(F.collect_list(F.struct(F.col("first.at").alias("at"), F.col("seen_source").alias("source_id"), F.col("seen_url").alias("url"), F.col("first.seen_at").alias("seen_at")))).alias("all"))
    best = rows.groupBy(KEY).agg(F.min_by(F.struct(*FACTS), "at").alias("x"))
    seen = F.transform("all", lambda s: F.struct(s["source_id"].alias("source_id"), s["url"].alias("url"), s["seen_at"].alias("seen_at")))
    return best.join(gathered, F.col(KEY) == F.col("of_hash")).select(KEY, "x.*", seen.cast(OCCURRENCES).alias("seen"))


def merged(fresh: DataFrame, old: DataFrame | None, marked: bool = False) -> DataFrame:
    """The items that ``fresh`` (first_and_sightings) makes or changes, given the stored ones of its hashes; marked: with ``is_new``."""
    others = lambda seen, source: F.filter(seen, lambda s: s["source_id"] != source)
    if old is None:
        every = [F.lit(True).alias("is_new")] if marked else []
        return fresh.select(KEY, *FACTS, F.lit(0).alias("analysis_stage"), F.lit(None).cast("string").alias("confidence"), others(F.col("seen"), F.col("source_id")).alias("also_seen_in"), *every)
    new = fresh.select(F.col(KEY).alias("new_hash"), *(F.col(c).alias(f"new_{c}") for c in FACTS), "seen")
    both = new.join(old, F.col("new_hash") == F.col(KEY), "left")
    known, there = F.col(KEY).isNotNull(), F.coalesce("also_seen_in", F.array().cast(OCCURRENCES))
    fact = {c: F.when(known, F.col(c)).otherwise(F.col(f"new_{c}")) for c in FACTS}
    added = F.filter(others(F.col("seen"), fact["source_id"]), lambda s: ~F.exists(there, lambda o: (o["source_id"] == s["source_id"]) & o["url"].eqNullSafe(s["url"])))
    stage = F.coalesce("analysis_stage", F.lit(0))
    seen = F.concat(there, added)
    confidence = F.when(stage < 2, F.col("confidence")).otherwise(derive_confidence(fact["authority"], F.size(seen)))
    made = {KEY: F.col("new_hash")} | fact | {"analysis_stage": stage, "confidence": confidence, "also_seen_in": seen}
    return both.select(*((made[c] if c in made else F.col(c)).alias(c) for c in old.columns), *([(~known).alias("is_new")] if marked else []))
