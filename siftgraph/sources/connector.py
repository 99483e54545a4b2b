"""Captured payload folders as a Spark data source, ``captures``, to read as a table or as a stream.

A folder holds files of JSON lines, one captured answer each, below
``source=<name>/day=<yyyy-mm-dd>/``. A row gives where the answer came from (source, day,
file, line), what was asked (``domain``), when, and the payload as text. A line that
isn't such an object, has no domain, or holds a payload above ``maxBytes`` gives a row too,
with its ``problem`` and without a payload: nothing is dropped and nothing fails.

Folders are listed on the driver, by the parts of the path that filters on ``source``
and ``day`` leave over; files are read by the tasks, in runs of about ``splitBytes``, by
Arrow's file systems (local, HDFS, S3 and the like), a line at a time and a batch of rows
at once. The stream's offset is the newest file that it has seen, by time of change and
name; ``settleSeconds`` keeps younger files for a later batch where clocks differ.

    spark.dataSource.register(CaptureSource)
    spark.read.format("captures").load(folder).where("source = 'rdap' and day >= '2024-01-01'")
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

SCHEMA = "source string, day date, domain string, captured_at timestamp, payload string, problem string, file string, line long"
ARROW = pa.schema([("source", pa.string()), ("day", pa.date32()), ("domain", pa.string()), ("captured_at", pa.timestamp("us", tz="UTC")), ("payload", pa.string()), ("problem", pa.string()), ("file", pa.string()), ("line", pa.int64())])
BATCH = 2_000


def longest_line(most: int) -> int:
    """The longest line that is held: a payload's limit with room for escapes, a megabyte at least."""
    return max(6 * most, 1 << 20)




@dataclass(frozen=True)
class Captured:
    """One file: its place, size and time of change, and what its folders say."""

    path: str
    size: int
    changed_ns: int
    source: str
    day: date


@dataclass
class Files(InputPartition):
    files: tuple[Captured, ...]


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Listing:
    """A folder's files, pruned by what is asked of ``source`` and ``day``."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.tests: list[tuple[str, str, object]] = []

    def keeps(self, column: str, value) -> bool:
        ops = {"=": lambda a, b: a == b, "in": lambda a, b: a in b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        return all(ops[op](value, other) for c, op, other in self.tests if c == column)

    def take(self, f: Filter) -> bool:
        """Whether a filter is one that the folders can answer whole; it is then kept."""
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column not in ("source", "day"):
            return False
        if isinstance(f, In):
            self.tests.append((column, "in", tuple(v for v in f.value if v is not None)))
        elif type(f) in kinds and f.value is not None:
            self.tests.append((column, kinds[type(f)], f.value))
        else:
            return False
        return True

    def files(self) -> list[Captured]:
        system, root = _at(self.path)
        out = []
        for name, folder in self._below(system, root, "source="):
            if not self.keeps("source", name):
                continue
            for day, inner in self._below(system, folder, "day="):
                at = date.fromisoformat(day)
                if self.keeps("day", at):
                    found = system.get_file_info(fs.FileSelector(inner))
                    out += [Captured(x.path, x.size, x.mtime_ns, name, at) for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._"]
        return sorted(out, key=lambda c: c.path)

    @staticmethod
    def _below(system: fs.FileSystem, folder: str, prefix: str) -> list[tuple[str, str]]:
        from urllib.parse import unquote

        infos = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [(unquote(x.base_name.removeprefix(prefix)), x.path) for x in infos if x.type == fs.FileType.Directory and x.base_name.startswith(prefix)]


def grouped(files: list[Captured], split: int) -> list[Files]:
    """Files in runs of about ``split`` bytes; a larger file is a run of its own."""
    out: list[list[Captured]] = []
    size = split
    for f in files:
        if size + f.size > split:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f.size
    return [Files(tuple(x)) for x in out]


def captured(line: bytes, most: int) -> tuple[str | None, datetime | None, str | None, str | None]:
    """(domain, captured_at, payload, problem) of a line."""
    if len(line) > longest_line(most):
        return None, None, None, "line too long"
    try:
        row = json.loads(line)
    except ValueError:
        return None, None, None, "not JSON"
    if not isinstance(row, dict):
        return None, None, None, "not an object"
    domain, payload, at, problem = row.get("domain"), row.get("payload"), row.get("captured_at"), None
    try:
        at = datetime.fromisoformat(at) if at else None
        at = at.replace(tzinfo=timezone.utc) if at and at.tzinfo is None else at
    except (TypeError, ValueError):
        at, problem = None, "captured_at isn't a time"
    if not isinstance(domain, str) or not domain.strip():
        domain, problem = None, "no domain"
    if payload is not None and not isinstance(payload, str):
        payload = json.dumps(payload, ensure_ascii=False)
    if payload is not None and len(payload.encode("utf-8", "surrogatepass")) > most:
        problem = "payload too large"
    return domain, at, None if problem else payload, problem


def rows(files: tuple[Captured, ...], root: str, most: int) -> Iterator[pa.RecordBatch]:
    system, _ = _at(root)
    batch: list[tuple] = []
    size = 0
    for f in files:
        with system.open_input_stream(f.path) as raw:
            for n, line in enumerate(_lines(raw, longest_line(most))):
                if line.strip():
                    batch.append((f.source, f.day, *captured(line, most), f.path, n))
                    size += len(line)
                if len(batch) >= BATCH or size > most * 16:
                    yield _arrow(batch)
                    batch, size = [], 0
    if batch:
        yield _arrow(batch)


def _lines(raw, longest: int) -> Iterator[bytes]:
    """The lines of a file; of one above ``longest`` a byte more than that, so that no line fills the memory."""
    rest, long = b"", False
    while block := raw.read(1 << 20):
        parts = (rest + block).split(b"\n")
        for k, part in enumerate(parts[:-1]):
            if not (k == 0 and long):
                yield part
        long = long and len(parts) == 1
        rest = parts[-1]
        if len(rest) > longest:
            if not long:
                yield rest[: longest + 1]
            rest, long = b"", True
    if rest and not long:
        yield rest


def _arrow(batch: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), ARROW)], schema=ARROW)


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listing = Listing(options["path"])
        self.most, self.split = int(options.get("maxbytes", 1 << 20)), int(options.get("splitbytes", 64 << 20))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.listing.take(f):
                yield f

    def partitions(self) -> list[Files]:
        return grouped(self.listing.files(), self.split)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        return rows(partition.files if partition else (), self.listing.path, self.most)  # None: no files at all


class CaptureStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.listing = Listing(options["path"])
        self.most, self.split = int(options.get("maxbytes", 1 << 20)), int(options.get("splitbytes", 64 << 20))
        self.settle = float(options.get("settleseconds", 0))

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        newest = max(((f.changed_ns, f.path) for f in self.listing.files() if f.changed_ns <= until), default=(0, ""))
        return {"changed": newest[0], "path": newest[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        lo, hi = (start["changed"], start["path"]), (end["changed"], end["path"])
        return grouped([f for f in self.listing.files() if lo < (f.changed_ns, f.path) <= hi], self.split)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        return rows(partition.files if partition else (), self.listing.path, self.most)  # None: no files at all


def _plain(options) -> dict[str, str]:
    return {k.lower(): v for k, v in options.items()}


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(_plain(self.options))

    def streamReader(self, schema: StructType) -> CaptureStream:
        return CaptureStream(_plain(self.options))


def read(spark, path: str, **options):
    """The folder as a table; filters on ``source`` and ``day`` prune its folders."""
    spark.dataSource.register(CaptureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("captures").options(**options).load(path)


def stream(spark, path: str, **options):
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("captures").options(**options).load(path)


def write(answers, path: str) -> None:
    """Answers (source, day, domain, captured_at, payload) as a captured folder; adds to one that exists."""
    from pyspark.sql import functions as F

    at = F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.to_json(F.struct("domain", at.alias("captured_at"), "payload"))
    answers.select(line.alias("value"), "source", "day").write.mode("append").partitionBy("source", "day").text(path)
