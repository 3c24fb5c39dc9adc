"""Segment and window tables kept between jobs, uploads, and typed settings.

A store is a log of runs: each save or removal adds a run of rows and of marks for the media it replaces, and a manifest that names the runs in order, made
only if it isn't there. A medium's rows are those of the last run that marks it. Runs are merged when they become many.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, fields

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types that are taken in.
ALLOWED = ("mp4", "mov", "mkv", "webm", "avi", "m4v", "flv", "mp3", "wav", "m4a", "aac", "flac", "ogg", "opus")
BATCH = 16


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which all executors share; in local runs without it a temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spanloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows in a scratch table, so that what follows doesn't run them again."""
    folder = scratch(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


PART_BYTES = 4 << 20  # of texts in a file whose words a task sorts
PARTS = "spanloom.media_parts"


def parts(spark: SparkSession, path: str) -> int:
    """Over how many partitions the media of a table are dealt: by its size, so that a task's words fit its memory, and never fewer than Spark's own number, as joins would deal
    them again. What is written of them later in the session is dealt alike."""
    fs, p = _fs(spark, path)
    least = max(int(spark.conf.get(c, None) or 1) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    n = max(least, -(-fs.getContentSummary(p).getLength() // PART_BYTES))
    spark.conf.set(PARTS, str(n))
    return n


def by_medium(spark: SparkSession) -> None:
    """Joins on a medium and more (time buckets, identifiers) take rows that are dealt by medium as they lie. Set for the session, as the plan needs it when it runs."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def dealt(rows: DataFrame, name: str, key: str = "media_id", parts: int | None = None) -> DataFrame:
    """Rows in a scratch table in buckets by medium, so that what follows neither runs nor deals them again."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get(PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch(spark, name)
    made = "spanloom_" + folder.rsplit("/", 1)[1].replace("-", "_")
    rows.repartition(parts, key).write.bucketBy(parts, key).option("path", folder).saveAsTable(made)
    by_medium(spark)
    return spark.table(made)


MOST_RUNS = 16  # runs that a reader meets before they are merged into one


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _fs(spark, f"{folder}/manifest")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()) if fs.exists(path) else []


def _live(spark: SparkSession, folder: str) -> tuple[int, list[str]]:
    """The newest whole manifest: its number and its runs, oldest first. One that is still being written, or was cut off, has no last line yet and is passed over."""
    for version in reversed(_versions(spark, folder)):
        lines = [r["value"] for r in spark.read.text(f"{folder}/manifest/{version:012d}").collect()]  # a line a run
        if lines and lines[-1] == "end":
            return version, lines[:-1]
    return 0, []


def _publish(spark: SparkSession, folder: str, version: int, runs: list[str]) -> bool:
    """Make `runs` the newest manifest; false if another writer was first. The file is created only if there is none, so of two writers one wins."""
    fs, path = _fs(spark, f"{folder}/manifest/{version:012d}")
    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray(("\n".join([*runs, "end"]) + "\n").encode()))
    out.close()
    return True


def _commit(spark: SparkSession, folder: str, run: str) -> None:
    """Add a run behind all others. Whoever comes second reads the manifest of the first and tries the next number."""
    while True:
        version, runs = _live(spark, folder)
        if _publish(spark, folder, max([version, *_versions(spark, folder)]) + 1, [*runs, run]):
            return


def _marked(media: DataFrame, folder: str, run: str) -> None:
    media.select("media_id").distinct().write.parquet(f"{folder}/marks/run={run}")


def save(rows: DataFrame, folder: str, index: str, batch: int = BATCH) -> None:
    """Rows of media in batches by their index, as a new run: media that are saved again replace what was there, other media stay, and only the rows that are
    saved are written. A reader sees a store without the run or with all of it."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    numbered = rows.withColumn("batch", F.floor(F.col(index) / batch)).sortWithinPartitions("media_id", index)
    numbered.write.parquet(f"{folder}/rows/run={run}")
    _marked(spark.read.parquet(f"{folder}/rows/run={run}"), folder, run)
    _commit(spark, folder, run)
    if len(_live(spark, folder)[1]) > MOST_RUNS:
        compact(spark, folder)


def remove(spark: SparkSession, folder: str, media: DataFrame) -> None:
    """Take media (media_id) out of a store: a run of marks without rows."""
    if not _live(spark, folder)[1]:
        return
    run = uuid.uuid4().hex
    _marked(media, folder, run)
    _commit(spark, folder, run)


def remove_everywhere(spark: SparkSession, folders: Sequence[str], media: DataFrame) -> None:
    """Take media out of every store that holds something made of them. Stores without them are left as they are; what is already gone stays gone, so a call
    that was cut off is made again."""
    gone = written(media.select("media_id").distinct(), "gone")
    for folder in folders:
        remove(spark, folder, gone)


def compact(spark: SparkSession, folder: str) -> None:
    """Merge all runs into one. If another writer commits meanwhile, its run stays behind the merged one. Files of merged runs stay for readers that began before."""
    _, before = _live(spark, folder)
    run = uuid.uuid4().hex
    visible = _visible(spark, folder, before)
    if visible is None:
        return
    visible.drop("run").write.parquet(f"{folder}/rows/run={run}")
    _marked(spark.read.parquet(f"{folder}/rows/run={run}"), folder, run)
    while True:
        version, runs = _live(spark, folder)
        if runs[: len(before)] != before:
            return  # another writer merged them
        if _publish(spark, folder, max([version, *_versions(spark, folder)]) + 1, [run, *runs[len(before) :]]):
            return


def _visible(spark: SparkSession, folder: str, runs: list[str], media: Sequence | None = None) -> DataFrame | None:
    """Rows whose run is the last that marks their medium."""
    fs, _ = _fs(spark, folder)
    held = [r for r in runs if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows/run={r}"))]
    if not held:
        return None
    read = lambda kind, names: spark.read.option("basePath", f"{folder}/{kind}").option("mergeSchema", "true").parquet(*(f"{folder}/{kind}/run={r}" for r in names))
    place = F.array_position(F.array(*map(F.lit, runs)), F.col("run").cast("string"))  # runs are few: they are merged
    wanted = (lambda df: df.where(F.col("media_id").isin(*media))) if media is not None else (lambda df: df)
    last = wanted(read("marks", runs)).groupBy("media_id").agg(F.max_by("run", place).cast("string").alias("_last"))
    rows = wanted(read("rows", held)).withColumn("run", F.col("run").cast("string"))
    return rows.join(last, "media_id").where("run = _last").drop("_last")


def drop(spark: SparkSession, folder: str) -> bool:
    """Delete a whole store; false if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def load(spark: SparkSession, folder: str, media: Sequence[int] | None = None) -> DataFrame:
    """The saved rows, of some media if named."""
    rows = _visible(spark, folder, _live(spark, folder)[1], media)
    if rows is None:
        raise FileNotFoundError(f"nothing was saved in {folder}")
    return rows.drop("run", "batch")


def save_jobs(jobs: DataFrame, folder: str) -> None:
    """Finished jobs (id, ...) as JSON, a row an object, their status set to done; `views.segments_of_jobs` reads them."""
    jobs.withColumn("status", F.lit("done")).write.mode("append").json(folder)


def save_texts(texts: DataFrame, folder: str, text: str) -> None:
    """A text file for each row's medium (media_id, text column), in a folder of its own."""
    texts.select("media_id", F.col(text).alias("value")).write.mode("overwrite").partitionBy("media_id").text(folder)


def uploads(files: DataFrame, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """Files (path, length) of a type that is taken and not empty, with their suffix."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("suffix", suffix).where(F.col("suffix").isin(*allowed) & (F.col("length") > 0))


@dataclass(frozen=True)
class Settings:
    """Settings read from ``spanloom.<name>`` of the session; a switch is on for 1, true, yes and on."""

    min_ms: int = 15_000
    max_ms: int = 180_000
    most_excluded: float = 0.25
    hook_anchor: bool = True
    topic_completion: bool = True

    @classmethod
    def read(cls, spark: SparkSession) -> "Settings":
        got = {}
        for f in fields(cls):
            text = spark.conf.get(f"spanloom.{f.name}", None)
            if text is not None:
                got[f.name] = text.strip().lower() in ("1", "true", "yes", "on") if isinstance(f.default, bool) else type(f.default)(text)
        return cls(**got)
