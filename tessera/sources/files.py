"""File and text sources."""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import strings


def scan_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Regular files at any depth: path, modificationTime, length, content (read only if it is used)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def with_suffix(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Files of the given extensions in either case, ordered by path."""
    return files.where(strings.extension(F.col("path")).isin([s.lower().lstrip(".") for s in suffixes])).orderBy("path")


def describe_files(files: DataFrame, prefix: str = "") -> DataFrame:
    """Inventory columns of scanned files."""
    path = strings.strip_prefix(F.regexp_replace("path", "^file:/+", "/"), prefix)
    return files.select(
        path.alias("path"),
        F.unix_millis("modificationTime").alias("last_modified"),
        F.col("length"),
        F.sha2("content", 256).alias("sha256"),
    )


def plain_path(path: str) -> str:
    """A path as scans give it, without the scheme of local files."""
    return re.sub("^file:/+", "/", path)


def place(path: Column, top: str) -> Column:
    """A scanned file's folder below `top` and its extension: the names of part files differ from run to run."""
    below = strings.strip_prefix(F.regexp_replace(path, "^file:/+", "/"), plain_path(top) + "/")
    return F.regexp_replace(below, r"/part-[^/]*?(\.[a-z]+)$", "$1")


def path_entries(path: Column) -> Column:
    """The folders that lead to a file, outermost first, and the file."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """The lines of a text at a path, or of all texts below it."""
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)


def process_list(lines_: DataFrame) -> DataFrame:
    """`<pid> <description>` lines; others are left out."""
    pid, rest = strings.first_token(F.col("value")), strings.after_first_blank(F.col("value"))
    return lines_.where(pid.rlike("^[0-9]+$")).select(pid.cast("int").alias("pid"), rest.alias("description"))


def matching_processes(processes: DataFrame, part: str, own: str) -> DataFrame:
    """Processes whose description has `part`, without those that have `own`."""
    return processes.where(F.col("description").contains(part) & ~F.col("description").contains(own))


def csv_watts(lines_: DataFrame) -> DataFrame:
    """Adds the whole watts (truncated) of `<number> W` lines; null where there is no number."""
    return lines_.withColumn("watts", F.split(F.trim("value"), " ")[0].try_cast("double").cast("int"))


def meter_power(json: DataFrame, column: str = "json") -> DataFrame:
    """Total active power out of a meter's status; null where it is missing."""
    return json.withColumn("total_act_power", F.expr(f"try_cast(get_json_object({column}, \"$['em:0'].total_act_power\") as double)"))


# Outcomes of reading a typed object.
READ, DEFAULTED, NO_DEFAULT = "ReadFileSuccessful", "DefaultConstructorSuccessful", "NoDefaultConstructor"


def typed_json(raw: DataFrame, schema: str, defaults: dict | None) -> DataFrame:
    """Column `json` bound to a schema; rows that cannot be read take the defaults, if there are any.

    `outcome` tells which way a row went.
    """
    parsed = raw.withColumn("_o", F.from_json("json", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("json").isNotNull() & F.col("_o").isNotNull() & F.col("_o._bad").isNull()
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    columns = [F.when(good, F.col(f"_o.{n}")).otherwise(F.lit((defaults or {}).get(n))).alias(n) for n in names]
    outcome = F.when(good, READ).otherwise(DEFAULTED if defaults is not None else NO_DEFAULT)
    return parsed.select(*[c for c in raw.columns if c != "json"], *columns, outcome.alias("outcome"))


# ------------------------------------------------------------------ framed byte streams


class _Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class _FrameReader(DataSourceStreamReader):
    """Replays length-prefixed blocks of one file: a stand-in for a socket or named pipe."""

    def __init__(self, path: str, per_batch: int):
        self.path, self.per_batch, self._at = path, per_batch, 0

    def _total(self) -> int:
        with open(self.path, "rb") as f:
            n = 0
            while len(head := f.read(4)) == 4:
                f.seek(struct.unpack(">i", head)[0], 1)
                n += 1
            return n

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self._at = min(self._total(), self._at + self.per_batch)
        return {"frame": self._at}

    def partitions(self, start: dict, end: dict):
        return [_Part(self.path, start["frame"], end["frame"])]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            n = 0
            while n < partition.end and len(head := f.read(4)) == 4:
                body = f.read(struct.unpack(">i", head)[0])
                if n >= partition.begin:
                    yield (n, body)
                n += 1


class FrameSource(DataSource):
    """`spark.readStream.format("tessera_frames")`: options path and framesPerBatch; rows (seq, frame)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_frames"

    def schema(self) -> str:
        return "seq long, frame binary"

    def streamReader(self, schema):  # noqa: N802
        return _FrameReader(self.options["path"], int(self.options.get("framesperbatch", "1000")))


def write_frames(path: str, frames: list[bytes]) -> None:
    with open(path, "wb") as f:
        for x in frames:
            f.write(struct.pack(">i", len(x)) + x)


def ingest_points(requests: DataFrame) -> DataFrame:
    """GPS points pushed as request parameters: text cut to 255 characters, numbers read leniently."""
    text = lambda c: F.substring(c, 1, 255).alias(c)
    number = lambda c, kind: F.expr(f"try_cast(substring({c}, 1, 255) as {kind})").alias(c)
    return requests.select(
        text("usertoken"), *[number(c, "float") for c in ("lat", "lon", "spd", "acc", "dir", "batt")], F.coalesce(strings.lenient_long(F.col("sat")), F.lit(0)).cast("int").alias("sat"),
        *[text(c) for c in ("desc", "alt", "time", "prov", "aid", "ser")],
        F.col("stime").cast("long").alias("stime"),
    )


def ingest_samples(requests: DataFrame, now=None) -> DataFrame:
    """Counter samples; the server's clock stamps them (pinned by `now` in tests)."""
    stamp = F.unix_timestamp() if now is None else F.lit(now)
    return requests.select(F.substring("name", 1, 255).alias("name"), F.substring("value", 1, 255).alias("value"), stamp.cast("string").alias("time"))
