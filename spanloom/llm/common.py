"""Helpers shared by the operators: scratch tables in the cluster's shared folder and worker-side file lookup."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}  # folders of local sessions that name none, by application


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset (local tests) a temp folder."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        name = spark.sparkContext.applicationId
        if name not in _LOCAL:
            _LOCAL[name] = tempfile.mkdtemp(prefix="spanloom-")
        base = _LOCAL[name]
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_limit(rows: int, least: int = 20_000, most: int = 10_000) -> int:
    """Rows from which a key is hot: at most `most` keys of `rows` rows can be, whatever the data."""
    return max(least, 2 * rows // most)


def join_hot(left: DataFrame, right: DataFrame, key: str, limit: int, how: str = "inner") -> DataFrame:
    """left joined by key with right, which has a row a key and `n`, the key's rows in left. Keys with over `limit` rows, few by
    `hot_limit`, are broadcast, so no task gets all rows of one; the others meet in a shuffle. how: inner or left."""
    hot = right.where(F.col("n") > limit).drop("n")
    frequent = left.join(F.broadcast(hot), key)
    others = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col("n") <= limit).drop("n"), key, how)
    return frequent.unionByName(others)


def join_salted(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, salt: Column, how: str = "inner") -> DataFrame:
    """left joined by key with right in one shuffle each: a key in hot (key, parts; few rows) is dealt over so many parts by `salt`, a
    hash of what tells its rows apart, and its row of right goes to each."""
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    few = F.broadcast(hot.select(key, F.col("parts").cast("long").alias("_parts")))
    dealt = left.join(few, key, "left").withColumn("_part", F.pmod(salt, parts)).drop("_parts")
    copied = right.join(few, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt.join(copied.hint("shuffle_hash"), [key, "_part"], how).drop("_part")  # right has a row a key, so a task's share is small


class Memo(dict):
    """Results by piece of text, bounded in bytes: emptied when full, and long pieces are not kept."""

    def __init__(self, limit: int = 256 << 20, longest: int = 256):
        super().__init__()
        self.limit, self.longest, self.held = limit, longest, 0

    def __missing__(self, piece: str) -> bytes:
        packed, n = self.made(piece), len(piece)
        if n <= self.longest:
            self.held += 200 + 20 * n  # the most that n characters and their ids take
            if self.held > self.limit:
                self.clear()
                self.held = 200 + 20 * n
            self[piece] = packed
        return packed


def vocabulary_file(name: str) -> str:
    """A tokenizer file by absolute path, or by its name in the installed public vocabulary package (resolved where it runs)."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
