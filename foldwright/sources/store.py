"""A feature store with numbered commits.

Rows are written under a run of their own and count only once the run is committed: the commit's number is the name of
a file that can be created once.  Readers see the runs of the commits there are (or of the first so many), so a run that
was killed leaves nothing to see, a repeated one is found committed, and of two that append at once the later sees
the other's rows before it commits its own.  A commit records what its model's rows must agree in.
"""

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import canonical_json, table_fingerprint
from ..operators import checks
from . import tables


class StaleBase(RuntimeError):
    """Another run was committed since the snapshot that an append was based on."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if there is one.  As exclusive as the file system's create without overwrite."""
    where, fs = _fs(spark, path)
    try:
        out = fs.create(where, False)
    except Exception as e:
        if fs.exists(where):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The records of all commits in order, one for each run that appended: ``version, run, models``."""
    where, fs = _fs(spark, f"{path}/commits")
    if not fs.exists(where):
        return []
    found = spark.read.option("wholetext", True).text(f"{path}/commits").select(F.input_file_name().alias("name"), "value").collect()
    records = [{"version": int(re.search(r"v(\d+)\.json$", r["name"])[1]), **json.loads(r["value"])} for r in found]
    return sorted(records, key=lambda r: r["version"])


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of the first ``version`` commits (all, by default); None if there is none."""
    runs = [r["run"] for r in commits(spark, path) if version is None or r["version"] <= version]
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/run={r}" for r in runs]).drop("run") if runs else None


def contracts(rows: DataFrame) -> dict[str, dict]:
    """What the rows of each model agree in: the width of each vector column and the provenance.  Rows of one model that differ are refused."""
    vectors = [f.name for f in rows.schema if isinstance(f.dataType, T.ArrayType)]
    shape = rows.select("model_id", *[F.size(c).alias(c) for c in vectors], canonical_json(F.col("provenance")).alias("provenance")).groupBy("model_id").agg(
        *[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in [*vectors, "provenance"]], F.count("*").alias("n"))
    out = {}
    for r in shape.collect():  # a row for each model
        if any(r[c]["low"] != r[c]["high"] for c in [*vectors, "provenance"]):
            raise ValueError("rows of one model differ in width or provenance")
        out[r["model_id"]] = {c: r[c]["low"] for c in [*vectors, "provenance"]}
    return out


def append(rows: DataFrame, path: str, run: str, metadata: dict[str, str] | None = None, base: int | None = None) -> int:
    """Append the rows that the store lacks as one commit and return its version.

    ``run``: a name (letters, digits, ``-``, ``_``) that a repeated append uses again; if it is committed, nothing happens.
    ``metadata``: what else must stay the same for these models.  Rows whose width, provenance or metadata differ
    from the store's, and rows that come twice, are refused.  ``base``: the version the caller has seen; if there
    is a later one, ``StaleBase``.  Without it the append is tried anew on what another run committed meanwhile.
    """
    spark = rows.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
        raise ValueError("a run's name has letters, digits, - and _")
    if not rows.groupBy("sample", "model_id").count().where("count > 1").isEmpty():
        raise ValueError("rows come twice")
    new = {m: {**c, "metadata": metadata or {}} for m, c in contracts(rows).items()}
    while True:
        done = commits(spark, path)
        for r in done:
            if r["run"].rsplit("--", 1)[0] == run:
                return r["version"]
            for m, c in r["models"].items():
                if m in new and c != new[m]:
                    raise ValueError(f"width, provenance or metadata of {m} differ from the store")
        version = done[-1]["version"] if done else 0
        if base is not None and version != base:
            raise StaleBase(f"the store is at version {version}")
        stored = snapshot(spark, path)
        todo = rows if stored is None else rows.join(stored.where("completed").select("sample", "model_id"), ["sample", "model_id"], "left_anti")
        name = f"{run}--{version + 1}"
        todo.select(*rows.columns).write.mode("overwrite").partitionBy("model_id").parquet(f"{path}/data/run={name}")
        if _create(spark, f"{path}/commits/v{version + 1:010d}.json", json.dumps({"run": name, "models": new})):
            return version + 1
        if base is not None:
            raise StaleBase(f"version {version + 1} was committed meanwhile")


def publish(parts: dict[str, DataFrame], path: str) -> int:
    """Write tables that belong together as one set, whole or not at all, and return its version.

    The tables lie under a name of their own until the set's commit, which holds the fingerprint of each, is created.
    """
    spark, run = next(iter(parts.values())).sparkSession, uuid.uuid4().hex
    record = {"run": run, "models": {}, "tables": {}}
    for name, df in parts.items():
        df.write.parquet(f"{path}/data/set={run}/{name}")
        seal = table_fingerprint(spark.read.schema(df.schema).parquet(f"{path}/data/set={run}/{name}")).first()
        record["tables"][name] = {"n_rows": seal["n_rows"], "digest": seal["digest"], "schema": df.schema.json()}
    while True:
        version = max((r["version"] for r in commits(spark, path)), default=0) + 1
        if _create(spark, f"{path}/commits/v{version:010d}.json", json.dumps(record)):
            return version


def published(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last set (or of ``version``); a table that is not what was published, by its fingerprint, is an error."""
    found = [r for r in commits(spark, path) if version is None or r["version"] == version]
    if not found:
        raise ValueError("nothing was published")
    out = {}
    for name, seal in found[-1]["tables"].items():
        out[name] = spark.read.schema(T.StructType.fromJson(json.loads(seal["schema"]))).parquet(f"{path}/data/set={found[-1]['run']}/{name}")
        now = table_fingerprint(out[name]).first()
        if (now["n_rows"], now["digest"]) != (seal["n_rows"], seal["digest"]):
            raise ValueError(f"{name} is not the table that was published")
    return out


def complete(spark: SparkSession, path: str, samples: DataFrame, model_id: str, width: int, columns: list[str]) -> int:
    """Mark a model complete at the present version if every rule of ``validate_features`` holds, else raise."""
    done = commits(spark, path)
    store = snapshot(spark, path)
    if store is None:
        raise ValueError("the store is empty")
    checks.require(tables.validate_features(store.where(F.col("model_id") == model_id), samples, width, columns))
    _create(spark, f"{path}/complete/{model_id}-v{done[-1]['version']:010d}", "")
    return done[-1]["version"]


def completed_at(spark: SparkSession, path: str, model_id: str) -> int | None:
    """The version at which a model was last marked complete; None if it never was."""
    where, fs = _fs(spark, f"{path}/complete")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    found = [int(m[1]) for n in names if (m := re.fullmatch(rf"{re.escape(model_id)}-v(\d+)", n))]
    return max(found, default=None)
