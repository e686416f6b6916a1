"""Lineage that is persisted in versions: a run that is repeated adds nothing, and one that is broken off leaves the last version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from schemaloom.functions.scratch import delete_path, read_text, written


class VersionConflict(Exception):
    """Another application has written this version in the meantime."""


class LineageStore:
    """Rows by model in a shared folder, as snapshots that a manifest each names.

    ``add`` compares the content of each model with what the last version holds of it, by the number of
    its rows and two sums of 64-bit hashes, whatever their order. Models that are new or differ are written as one run, and a
    small table says which run holds each model now; a manifest of the next number then names both.
    A version is there once its manifest is, so what was broken off before is never read; ``tidy``
    deletes it. Models that an addition does not mention stay. A null model is a model of its own.
    Rows of a version are read by a join with the table of models, and ``most_runs`` runs are
    rewritten as one.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "model", most_runs: int = 16):
        self.spark, self.path, self.key, self.most_runs = spark, path.rstrip("/"), key, most_runs

    def _listed(self) -> list[str]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []

    def versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self._listed() if n.startswith("manifest-") and n.endswith(".json"))

    def _state(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if version is None and not known:
            return None
        number = known[-1] if version is None else version
        if number not in known:
            raise ValueError(f"{self.path} has no version {number}")
        return json.loads(read_text(self.spark, f"{self.path}/manifest-{number:08d}.json"))

    def _models(self, state: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{state['models']}")

    def contents(self, version: int | None = None) -> DataFrame | None:
        """The rows of the last version, or of another one; None where nothing has been added yet."""
        state = self._state(version)
        if state is None:
            return None
        schema = StructType.fromJson(state["schema"])
        if not state["runs"]:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{r}").withColumn("__run", F.lit(r)) for r in state["runs"]]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        held = self._models(state).select(F.col("key").alias("__key"), F.col("run").alias("__held"))
        return rows.join(held, rows[self.key].eqNullSafe(F.col("__key")) & (F.col("__run") == F.col("__held")), "left_semi").drop("__run")

    def _digest(self, rows: DataFrame) -> DataFrame:
        cells = [x for c in rows.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
        sums = [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
        return rows.groupBy(F.col(self.key).alias("key")).agg(F.count(F.lit(1)).alias("n"), *sums)

    def add(self, rows: DataFrame) -> int:
        """Add the models of ``rows`` that are new or differ; returns how many these are. Without any there is no new version, but for a first one."""
        state = self._state()
        if state and StructType.fromJson(state["schema"]).simpleString() != rows.schema.simpleString():
            raise ValueError(f"{self.path} holds {StructType.fromJson(state['schema']).simpleString()}")
        number, run = (state["version"] + 1 if state else 1), f"run-{uuid.uuid4().hex}"
        own = written(rows, f"{self.path}/own-{uuid.uuid4().hex}")  # read twice below, and must be the same rows then
        digest = self._digest(own)
        if state:
            old = self._models(state)
            same = digest["key"].eqNullSafe(old["key"]) & (digest["n"] == old["n"]) & (digest["h1"] == old["h1"]) & (digest["h2"] == old["h2"])
            digest = digest.join(old, same, "left_anti")
        fresh = written(digest.withColumn("run", F.lit(run)), f"{self.path}/fresh-{uuid.uuid4().hex}", small=True)
        n = fresh.count()
        if n or not state:
            changed = fresh.select(F.col("key").alias("__key"))
            written(own.join(changed, own[self.key].eqNullSafe(F.col("__key")), "left_semi"), f"{self.path}/{run}")
            models = f"models-{uuid.uuid4().hex}"
            if state:
                kept = self._models(state).alias("o").join(fresh.alias("f"), F.col("o.key").eqNullSafe(F.col("f.key")), "left_anti")
                fresh = kept.unionByName(fresh)
            written(fresh, f"{self.path}/{models}", small=True)
            self._save({"version": number, "models": models, "runs": [*(state["runs"] if state else []), run], "schema": rows.schema.jsonValue()})
        self.tidy()
        if n and len(self._state()["runs"]) > self.most_runs:
            self.compact()
        return n

    def compact(self) -> None:
        """Rewrite what the last version holds as one run, in a version of its own."""
        state = self._state()
        run, models = f"run-{uuid.uuid4().hex}", f"models-{uuid.uuid4().hex}"
        written(self.contents(), f"{self.path}/{run}", small=True)
        written(self._models(state).withColumn("run", F.lit(run)), f"{self.path}/{models}", small=True)
        self._save({**state, "version": state["version"] + 1, "models": models, "runs": [run]})

    def _save(self, state: dict) -> None:
        """The manifest appears whole under a name that is never replaced."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{state['version']:08d}.json")
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest-{uuid.uuid4().hex}")
        system = target.getFileSystem(conf)
        stream = system.create(fresh)
        stream.write(json.dumps(state).encode())
        stream.close()
        if system.exists(target) or not system.rename(fresh, target):
            system.delete(fresh, False)
            raise VersionConflict(f"{self.path} has version {state['version']} already")

    def expire(self, keep: int = 1) -> None:
        """Forget all but the last ``keep`` versions, and delete what only they named."""
        for number in self.versions()[: -max(1, keep)]:
            delete_path(self.spark, f"{self.path}/manifest-{number:08d}.json")
        self.tidy()

    def tidy(self) -> int:
        """Delete the folders that no version names; returns how many. One application adds at a time."""
        states = [self._state(v) for v in self.versions()]
        named = {x for s in states for x in (s["models"], *s["runs"])}
        stray = [n for n in self._listed() if n not in named and n.split("-")[0] in ("run", "models", "own", "fresh", "_manifest")]
        for name in stray:
            delete_path(self.spark, f"{self.path}/{name}")
        return len(stray)
