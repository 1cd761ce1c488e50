"""Which files two runs consumed: an index of file identities by path, what changed between two, and the rules on them.

Identities are rows of ``role, path, size_bytes, sha256``.  A file is its path, its size and its digest together: two
files of one content are two files, and a lost one of them is lost.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checks
from .folds import numbered

FINGERPRINT = ["role", "key", "size_bytes", "sha256"]


def path_key(path: Column) -> Column:
    """The path that two spellings share: no ``file:`` before it, ``/`` between its parts, ``.``, ``..`` and empty parts resolved, in lower case."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "(?i)^file:/*", "/")
    none = F.array().cast("array<string>")
    step = lambda done, part: (F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
                               .otherwise(F.concat(done, F.array(part))))
    rooted = F.when(plain.startswith("/"), "/").otherwise("")
    return F.lower(F.concat(rooted, F.array_join(F.aggregate(F.split(plain, "/"), none, step), "/")))


def identity_index(identities: DataFrame) -> DataFrame:
    """``role, key, size_bytes, sha256, path``: each fingerprint once, under the smallest of its spellings."""
    return (identities.withColumns({"key": path_key(F.col("path")), "sha256": F.upper("sha256"), "size_bytes": F.col("size_bytes").cast("long")})
            .groupBy(*FINGERPRINT).agg(F.min("path").alias("path")))


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows ``role, status, path, new_path, size_bytes, sha256, new_size_bytes, new_sha256`` for every file that is not in both runs.

    ``changed``: the path is in both, with another size or content; ``moved``: a content that is lost under one path and
    added under another, couples in the order of a digest of the paths; ``lost`` and ``added``: the rest.
    """
    a, b = identity_index(first), identity_index(second)
    old = a.join(b, FINGERPRINT, "left_anti")
    new = b.join(a, FINGERPRINT, "left_anti").select("role", "key", *[F.col(c).alias(f"new_{c}") for c in ("path", "size_bytes", "sha256")])
    both = old.join(new, ["role", "key"], "full_outer")
    changed = both.where("path is not null and new_path is not null").withColumn("status", F.lit("changed"))
    lost, added = both.where("new_path is null"), both.where("path is null")
    lost = numbered(lost.select("role", "key", "path", "size_bytes", "sha256"), ["role", "size_bytes", "sha256"], F.md5(F.col("key").cast("binary")), "key", "place")
    added = numbered(added.select("role", "new_path", "key", F.col("new_size_bytes").alias("size_bytes"), F.col("new_sha256").alias("sha256")),
                     ["role", "size_bytes", "sha256"], F.md5(F.col("key").cast("binary")), "key", "place").drop("key")
    pairs = lost.drop("key").join(added, ["role", "size_bytes", "sha256", "place"], "full_outer")
    status = F.when(F.col("path").isNull(), "added").when(F.col("new_path").isNull(), "lost").otherwise("moved")
    here, there = F.col("path").isNotNull(), F.col("new_path").isNotNull()
    rest = pairs.select("role", status.alias("status"), "path", "new_path", F.when(here, F.col("size_bytes")).alias("size_bytes"), F.when(here, F.col("sha256")).alias("sha256"),
                        F.when(there, F.col("size_bytes")).alias("new_size_bytes"), F.when(there, F.col("sha256")).alias("new_sha256"))
    return changed.select(*rest.columns).unionByName(rest)


def _same(first: DataFrame, second: DataFrame, name: str) -> DataFrame:
    """Fingerprints of one side alone; a role that has files on one side alone, and an empty side, fail too."""
    a, b = identity_index(first).withColumn("_left", F.lit(1)), identity_index(second).withColumn("_right", F.lit(1))
    both = a.drop("path").join(b.drop("path"), FINGERPRINT, "full_outer")
    alone = F.sum((F.col("_left").isNull() | F.col("_right").isNull()).cast("long"))
    empty = (F.count("_left") == 0).cast("long") + (F.count("_right") == 0).cast("long")
    return checks.check_row(both, name, F.when(F.count("*") == 0, 1).otherwise(F.greatest(alone, empty)))


def same_lineage(first: DataFrame, second: DataFrame) -> DataFrame:
    """Check row: two runs consumed exactly the same files."""
    return _same(first, second, "same inputs")


def exact_inputs(observed: DataFrame, given: DataFrame) -> DataFrame:
    """Check row: a run consumed exactly the given files; one that consumed none fails."""
    return _same(observed, given, "inputs are the given files")


def bound_paths(consumed: DataFrame, produced: DataFrame) -> DataFrame:
    """Check row: every path that was consumed is one that the stage before recorded, under whatever role or content; a stage that recorded none fails."""
    known = produced.select(path_key(F.col("path")).alias("key")).distinct().withColumn("_known", F.lit(1))
    wanted = consumed.select(path_key(F.col("path")).alias("key")).distinct().withColumn("_wanted", F.lit(1))
    both = wanted.join(known, "key", "full_outer")
    missing = F.sum((F.col("_wanted").isNotNull() & F.col("_known").isNull()).cast("long"))
    return checks.check_row(both, "inputs are recorded", F.when(F.count("_known") == 0, F.greatest(F.coalesce(missing, F.lit(0)), F.lit(1))).otherwise(missing))


def consumed_of_produced(consumed: DataFrame, produced: DataFrame) -> DataFrame:
    """Check row: every consumed file is one that the stage before produced, unchanged."""
    on = ["key", "size_bytes", "sha256"]
    loose = identity_index(consumed).select(*on).distinct().join(identity_index(produced).select(*on).distinct(), on, "left_anti")
    return checks.check_row(loose, "inputs were produced", F.count("*"))
