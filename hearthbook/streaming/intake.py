"""Files and entries as streams: content de-duplication, idempotent imports, late versions and daily sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from hearthbook.functions.checks import extension
from hearthbook.operators.merge import insert_ignore
from hearthbook.operators.written import exists
from hearthbook.streaming.lots import typed_state

# The file endings that the library takes in, those of downloads under way, and its largest file.
SUPPORTED, UNDER_WAY, MOST_BYTES = (".png", ".jpg", ".jpeg", ".pdf", ".csv", ".xlsx"), (".tmp", ".part", ".crdownload", ".download"), 256 << 20


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files of a flat folder: path, size, modified, content and its hash."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*").load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("hash"))


def first_of_content(files: DataFrame, key: str = "hash", time: str | None = None, within: str = "1 day") -> DataFrame:
    """Each content once, however often it is seen.

    With a timestamp column as ``time``, a stream remembers a content until its watermark,
    ``within`` behind the newest row, has passed it: copies that come closer together are
    dropped, and the state does not grow for ever.
    """
    if time is None or not files.isStreaming:
        return files.dropDuplicates([key])
    return files.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


class Looks(DataSource):
    """A stream of looks at a flat folder: every batch lists all its files as (look, path, size, modified).

        spark.dataSource.register(Looks)
        spark.readStream.format("looks").load("/shared/inbox")
    """

    @classmethod
    def name(cls) -> str:
        return "looks"

    def schema(self) -> str:
        return "look long, path string, size long, modified timestamp"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Looker(self.options["path"])


class _Looker(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _listed(self, look: int):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        return [(look, f.path, f.size, f.mtime.replace(tzinfo=None) if f.mtime else None) for f in system.get_file_info(fs.FileSelector(path)) if f.is_file]

    def initialOffset(self) -> dict:
        return {"look": 0}

    def read(self, start: dict):
        look = start["look"] + 1
        return iter(self._listed(look)), {"look": look}

    def readBetweenOffsets(self, start: dict, end: dict):
        """After a restart an unfinished look is taken anew: what a file was then is not known any more."""
        return iter(self._listed(end["look"]))


class Sightings(StatefulProcessor):
    """How often in a row a file was seen with one size and time, and whether it was given out so."""

    def __init__(self, least: int):
        self.least = least

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "size long, at long, times int, taken boolean")

    def handleInputRows(self, key, rows, timerValues):
        size, at, times, taken = self.seen.get() if self.seen.exists() else (None, None, 0, False)
        for row in sorted(rows, key=lambda r: r["look"]):
            if (row["size"], row["at"]) != (size, at):
                size, at, times, taken = row["size"], row["at"], 0, False
            times = min(times + 1, self.least)
            if times == self.least and not taken:
                taken = True
                yield Row(path=key[0], size=size, at=at)
        self.seen.update((size, at, times, taken))

    def close(self) -> None:
        pass


def whole_files(looks: DataFrame, least: int = 2) -> DataFrame:
    """looks (look, path, size, modified) as a stream -> (path, size, modified) of each file once ``least`` looks in a row found it alike.

    A file that changes later is given again, once it rests.  Lock files, downloads
    under way, unsupported kinds and files of no or too many bytes are left out.  The
    state store is as for ``lots.stream``.
    """
    typed_state(looks.sparkSession)
    wanted = looks.where(_state_of(F.col("path"), F.col("size")).isNull()).select("look", "path", "size", F.unix_micros("modified").alias("at"))
    rested = wanted.groupBy("path").transformWithState(statefulProcessor=Sightings(least), outputStructType="path string, size long, at long", outputMode="Append", timeMode="None")
    return rested.select("path", "size", F.timestamp_micros("at").alias("modified"))


def _state_of(path: Column, size: Column) -> Column:
    """Why a file is not taken in: ignored, unsupported or rejected; else null."""
    name = F.lower(F.substring_index(path, "/", -1))
    passing = name.startswith("~$") | F.exists(F.array(*map(F.lit, UNDER_WAY)), lambda e: F.endswith(name, e))
    return F.when(passing, "ignored").when(~extension(path).isin(*SUPPORTED), "unsupported").when(~size.between(1, MOST_BYTES), "rejected")


#: Parts of an import table; a batch reads those of its own accounts.
PARTS = 64


def import_batch(spark: SparkSession, target: str):
    """A foreachBatch sink that appends entries whose fingerprint target does not have; replays add nothing.

    target is partitioned by a hash of the account, and only the parts that the
    batch's accounts fall in are read, of them the two key columns.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(["account_id", "fingerprint"]).withColumn("part", F.pmod(F.xxhash64("account_id"), F.lit(PARTS)).cast("int"))
        rows = rows.persist()
        try:
            named = [r["part"] for r in rows.select("part").distinct().collect()]  # PARTS at most
            have = spark.read.parquet(target).where(F.col("part").isin(named)).select("account_id", "fingerprint") if exists(spark, target) else rows.select("account_id", "fingerprint").limit(0)
            insert_ignore(have, rows, ["account_id", "fingerprint"]).where("outcome = 'inserted'").drop("outcome").write.mode("append").partitionBy("part").parquet(target)
        finally:
            rows.unpersist()

    return write


def settled(spark: SparkSession, folder_: str, seen: DataFrame | None, least: int = 2) -> DataFrame:
    """One look at a flat folder: (path, size, modified, sightings, status) against the last look.

    A file is ready once ``least`` looks in a row found it with the same size and
    time; until then it is pending.  Lock files and downloads under way are ignored,
    other kinds unsupported, oversized ones rejected; Spark does not list empty ones.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder_).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if seen is not None:
        before = seen.select("path", F.col("size").alias("had"), F.col("modified").alias("had_at"), F.col("sightings").alias("times"))
        files = files.join(before, "path", "left")
    else:
        files = files.withColumns({"had": F.lit(None).cast("long"), "had_at": F.lit(None).cast("timestamp"), "times": F.lit(None).cast("int")})
    same = F.coalesce((F.col("had") == F.col("size")) & (F.col("had_at") == F.col("modified")), F.lit(False))
    times = F.when(same, F.col("times") + 1).otherwise(1)
    status = F.coalesce(_state_of(F.col("path"), F.col("size")), F.when(times >= least, "ready").otherwise("pending"))
    return files.select("path", "size", "modified", times.cast("int").alias("sightings"), status.alias("status"))


def current_version(history: DataFrame) -> DataFrame:
    """(file, hash, captured): late captures join the history, the newest stays current."""
    return history.groupBy("file").agg(F.max_by("hash", "captured").alias("hash"), F.count("*").alias("versions"))


def missing(known: DataFrame, listed: DataFrame, complete: bool) -> DataFrame:
    """Known files that a listing lacks; an incomplete listing proves nothing."""
    return known.join(listed, "file", "left_anti") if complete else known.limit(0)


def daily(entries: DataFrame, delay: str = "1 day") -> DataFrame:
    """Sums per day and type of a stream of (ts, event_type, value), with a watermark."""
    return entries.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")
