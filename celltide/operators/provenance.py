"""Run provenance: manifests as tables, lineage of artifacts, staleness, and the batch driver."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celltide.functions import scalars as S

ITEM = "struct<path:string,size:bigint,mtime:double,produced_by:string>"
STAGE = (
    "struct<status:string,started_at:string,finished_at:string,duration_s:double,code:map<string,string>,"
    f"params:map<string,string>,metrics:map<string,double>,extra:map<string,string>,calibration:map<string,string>,"
    f"io:struct<inputs:array<{ITEM}>,outputs:array<{ITEM}>>>"
)
MANIFEST = f"struct<schema:string,population:map<string,string>,stages:map<string,{STAGE}>>"


def read_manifests(spark: SparkSession, path: str, pattern: str = "stage_manifest.json") -> DataFrame:
    """population_id, output_dir, position, stage, entry: one row per recorded stage, in manifest order."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    where = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    parsed = files.select(where.alias("output_dir"), F.from_json("value", MANIFEST).alias("p"))
    rows = parsed.select(
        "output_dir",
        F.coalesce(F.col("p.population")["population_id"], S.basename(F.regexp_replace("output_dir", "/output$", ""))).alias("population_id"),
        F.posexplode(F.map_entries("p.stages")).alias("position", "e"),
    )
    return rows.select("population_id", "output_dir", "position", F.col("e.key").alias("stage"), F.col("e.value").alias("entry"))


def run_io(stages: DataFrame) -> DataFrame:
    """population_id, stage, position, direction, path, size, mtime, produced_by of every recorded file."""
    parts = [
        stages.select("population_id", "output_dir", "stage", "position", F.lit(d).alias("direction"), F.explode(f"entry.io.{d}s").alias("i"))
        for d in ("input", "output")
    ]
    return parts[0].union(parts[1]).select(
        "population_id", "output_dir", "stage", "position", "direction", "i.path", "i.size", "i.mtime", "i.produced_by"
    )


def producers(io: DataFrame) -> DataFrame:
    """path, stage: the last stage, in manifest order, that wrote it."""
    outputs = io.filter("direction = 'output'")
    return outputs.groupBy("population_id", "path").agg(F.max_by("stage", "position").alias("stage"))


def stage_edges(io: DataFrame) -> DataFrame:
    """population_id, upstream, artifact, downstream: inputs another stage produced."""
    return io.filter("direction = 'input' and produced_by is not null and produced_by <> '' and produced_by <> stage").select(
        "population_id", F.col("produced_by").alias("upstream"), F.col("path").alias("artifact"), F.col("stage").alias("downstream")
    )


def producer_mismatches(io: DataFrame) -> DataFrame:
    """Inputs whose stated producer isn't the recorded one."""
    known = producers(io).select("population_id", "path", F.col("stage").alias("recorded"))
    return io.filter("direction = 'input' and produced_by is not null").join(known, ["population_id", "path"]).filter("recorded <> produced_by")


def stale(io: DataFrame, current: DataFrame, keys: Sequence[str] = ("population_id", "path")) -> DataFrame:
    """Inputs that changed since they were read: another size, or a later mtime. Files not there, and inputs without a recorded mtime, are skipped."""
    now = current.select(*keys, F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"))
    met = io.filter("direction = 'input' and mtime is not null").join(now, list(keys))
    return met.filter(~F.col("size").eqNullSafe(F.col("size_now")) | (F.col("mtime_now") > F.col("mtime")))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, size, mtime of every file below `path`, and of directories: total size and last mtime."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("us"))
    )
    files = files.withColumn("mtime", F.col("us") / 1e6).drop("us")
    folder = F.regexp_replace("path", "/[^/]*$", "/")
    return files.unionByName(files.groupBy(folder.alias("path")).agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime")))


def stage_table(stages: DataFrame, key_pattern: str | None = None, stale_inputs: DataFrame | None = None) -> DataFrame:
    """One row per (population, stage): keys, timings, code, numbers of files, staleness, params, metrics and extra as maps."""
    old = (
        stale_inputs.select("population_id", "stage").distinct().withColumn("stale", F.lit(True))
        if stale_inputs is not None
        else None
    )
    io = F.col("entry.io")
    out = stages.select(
        "population_id",
        "stage",
        "entry.status",
        "entry.started_at",
        "entry.finished_at",
        "entry.duration_s",
        F.col("entry.code")["sha256"].alias("code_sha256"),
        F.when(io.isNotNull(), F.size(F.coalesce("entry.io.inputs", F.array().cast(f"array<{ITEM}>")))).alias("n_inputs"),
        F.when(io.isNotNull(), F.size(F.coalesce("entry.io.outputs", F.array().cast(f"array<{ITEM}>")))).alias("n_outputs"),
        "entry.params",
        "entry.metrics",
        "entry.extra",
    )
    if old is not None:
        out = out.join(old, ["population_id", "stage"], "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    return S.parsed_keys(out, "population_id", key_pattern) if key_pattern else out


def flattened(table: DataFrame, *maps: str) -> DataFrame:
    """Map columns spread into columns of their keys; a column the table already has wins."""
    for m in maps:
        keys = [r[0] for r in table.select(F.explode(F.map_keys(m))).distinct().orderBy(F.lit(1)).collect()]
        table = table.withColumns({k: F.col(m)[k] for k in keys if k not in table.columns})
    return table.drop(*maps)


def last_calibration(stages: DataFrame, stage: str | None = None) -> DataFrame:
    """The last recorded calibration of each population (of one stage, if named)."""
    rows = stages.filter("entry.calibration is not null")
    rows = rows if stage is None else rows.filter(F.col("stage") == stage)
    return rows.groupBy("population_id").agg(F.max_by("entry.calibration", "position").alias("calibration"))


def openlineage(stages: DataFrame, namespace: str = "celltide") -> DataFrame:
    """value: one OpenLineage RunEvent of JSON per stage run; COMPLETE if its status is unset or ok, else FAIL."""
    dataset = lambda d: F.transform(
        F.coalesce(F.col(f"entry.io.{d}s"), F.array().cast(f"array<{ITEM}>")),
        lambda i: F.struct(F.lit(namespace).alias("namespace"), i["path"].alias("name")),
    )
    ok = F.col("entry.status").isNull() | (F.col("entry.status") == "ok")
    run = F.sha2(F.concat_ws("/", "population_id", "stage", "entry.started_at"), 256)
    run_id = F.concat_ws("-", *[F.substring(run, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    event = F.struct(
        F.when(ok, "COMPLETE").otherwise("FAIL").alias("eventType"),
        F.coalesce("entry.finished_at", "entry.started_at").alias("eventTime"),
        F.struct(run_id.alias("runId")).alias("run"),
        F.struct(F.lit(namespace).alias("namespace"), F.concat_ws(".", "population_id", "stage").alias("name")).alias("job"),
        dataset("input").alias("inputs"),
        dataset("output").alias("outputs"),
        F.lit("celltide").alias("producer"),
    )
    return stages.select(F.to_json(event).alias("value"))


# ---------------------------------------------------------------- recording


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


class StageContext:
    """Records one stage's run into a folder's manifest, replaced atomically."""

    def __init__(self, output_dir: str, stage: str, population_id: str | None = None, schema: str = "celltide.stage/v1"):
        self.dir, self.stage, self.schema = output_dir, stage, schema
        self.population_id = population_id or os.path.basename(os.path.normpath(output_dir))
        self.entry: dict = {"started_at": _now(), "params": {}, "metrics": {}, "extra": {}, "io": {"inputs": [], "outputs": []}}
        self._began = datetime.now(UTC)

    @property
    def manifest_path(self) -> str:
        return os.path.join(self.dir, "stage_manifest.json")

    def manifest(self) -> dict:
        if not os.path.exists(self.manifest_path):
            return {}
        with open(self.manifest_path, encoding="utf-8") as f:
            return json.load(f)

    def _fingerprint(self, path: str) -> dict:
        full = os.path.join(self.dir, path)
        if os.path.isdir(full):
            found = [os.path.join(d, n) for d, _, ns in os.walk(full) for n in ns]
            return {"path": path.rstrip("/") + "/", "size": sum(map(os.path.getsize, found)), "mtime": max(map(os.path.getmtime, found), default=0.0)}
        return {"path": path, "size": os.path.getsize(full), "mtime": os.path.getmtime(full)} if os.path.exists(full) else {"path": path}

    def log_params(self, **values) -> None:
        self.entry["params"].update({k: str(v) for k, v in values.items()})

    def log_metrics(self, **values) -> None:
        self.entry["metrics"].update({k: float(v) for k, v in values.items()})

    def input_path(self, path: str) -> str:
        by = {i["path"]: n for n, e in self.manifest().get("stages", {}).items() for i in e.get("io", {}).get("outputs", [])}
        item = self._fingerprint(path)
        if item["path"] in by:
            item["produced_by"] = by[item["path"]]
        self.entry["io"]["inputs"].append(item)
        return os.path.join(self.dir, path)

    def output_path(self, path: str) -> str:
        self.entry["io"]["outputs"].append({"path": path})
        return os.path.join(self.dir, path)

    def finish(self, status: str = "ok") -> dict:
        self.entry["io"]["outputs"] = [self._fingerprint(o["path"]) for o in self.entry["io"]["outputs"]]
        self.entry |= {"status": status, "finished_at": _now(), "duration_s": round((datetime.now(UTC) - self._began).total_seconds(), 1)}
        whole = self.manifest()
        whole.setdefault("schema", self.schema)
        whole.setdefault("population", {"population_id": self.population_id})
        whole.setdefault("stages", {})[self.stage] = self.entry
        self._write(whole)
        return self.entry

    def clear(self, stage: str) -> None:
        """Delete a stage's recorded outputs, unless another stage claims them too, and its entry."""
        whole = self.manifest()
        entry = whole.get("stages", {}).pop(stage, None)
        claimed = {o["path"] for e in whole.get("stages", {}).values() for o in e.get("io", {}).get("outputs", [])}
        for o in (entry or {}).get("io", {}).get("outputs", []):
            full = os.path.join(self.dir, o["path"])
            if o["path"] not in claimed and os.path.isfile(full):
                os.remove(full)
        self._write(whole)

    def _write(self, whole: dict) -> None:
        os.makedirs(self.dir, exist_ok=True)
        temporary = self.manifest_path + ".tmp"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(whole, f, indent=1)
        os.replace(temporary, self.manifest_path)


def scale(
    sources: Sequence, run: Callable[[object, str], object], output: str, naming: Callable[[object], str] | None = None, max_workers: int = 4, exist_ok: bool = False
) -> dict:
    """Runs `run(source, folder)` for every source, several Spark jobs at a time; failures are kept apart.

    Returns results and errors by name. Each run plans its own queries; the cluster's scheduler shares the executors.
    """

    def default(source) -> str:
        if isinstance(source, bool) or not isinstance(source, (int, str)):
            raise ValueError(f"cannot name an execution after {source!r}")
        if isinstance(source, int):
            return f"execution_{source}"
        return os.path.splitext(os.path.basename(source.split("?", 1)[0]))[0]

    names = [(naming or default)(s) for s in sources]
    if len(set(names)) < len(names):
        raise ValueError("two sources have the same execution name")
    done: dict = {"results": {}, "errors": {}}

    def one(name: str, source) -> None:
        folder = os.path.join(output, name)
        if os.path.exists(folder) and not exist_ok:
            done["errors"][name] = FileExistsError(folder)
            return
        os.makedirs(folder, exist_ok=True)
        try:
            done["results"][name] = run(source, folder)
        except Exception as e:  # isolated by design: the batch goes on
            done["errors"][name] = e

    with ThreadPoolExecutor(max_workers) as pool:
        list(pool.map(one, names, sources))
    return done


def next_index(files: DataFrame, path: str = "path") -> int:
    """One above the largest numeric stem, 0 if there is none."""
    number = S.stem(F.col(path)).try_cast(T.LongType())
    return files.agg(F.coalesce(F.max(number) + 1, F.lit(0))).first()[0]
