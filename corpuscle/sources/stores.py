"""Sources of Spark's Python data source API, for stores that Spark has no reader for. Paths are of folders that driver and executors both mount.

* `paged_store`: a table of an SQLite file (catalogues, manifests, ledgers). Reading is planned: the order of row numbers is cut into as many ranges as asked, each range is one task, and a task reads page after
  page behind the last number it has seen, so no page is counted off from the beginning. Comparisons with constants, lists and null tests go into the store's own WHERE.
* `progress_log`: a stream over a growing log of lines. An offset is a byte at which a line begins; what lies between two offsets is read in ranges of bounded size, so a batch that is repeated reads the same lines. A line counts when its end is written.
* `committed_lines`: a folder of JSON lines. Tasks write files of their own aside; a commit moves them in and puts one manifest beside them in a single rename. Readers go by manifests, so rows of a job that died, or of a task that ran twice, are not seen.

    for source in stores.SOURCES: spark.dataSource.register(source)
    spark.read.format("paged_store").option("path", p).option("table", "files").load()
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

#: Rows of a page, ranges of a table, and bytes of a log that one task reads.
PAGE, RANGES, LOG_BYTES = 20_000, 8, 1 << 20
_KINDS = {"INT": T.LongType(), "REAL": T.DoubleType(), "FLOA": T.DoubleType(), "DOUB": T.DoubleType(), "BLOB": T.BinaryType()}


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


@dataclass
class KeyRange(InputPartition):
    """Row numbers from `first` up to but not `end`; no end is the last range."""

    first: object
    end: object


class PagedStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_store"

    def schema(self) -> T.StructType:
        with _opened(self.options["path"]) as c:
            rows = c.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(r[1], next((k for p, k in _KINDS.items() if (r[2] or "").upper().startswith(p)), T.StringType())) for r in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.table = options["path"], options["table"]
        self.ranges, self.page = int(options.get("ranges", RANGES)), int(options.get("page", PAGE))
        self.columns = schema.names
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters) -> Iterator:
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            plain = lambda v: isinstance(v, (int, float, str)) and not isinstance(v, bool)
            if column in self.columns and type(f) in signs and plain(f.value):
                self.where.append(f"{_name(column)} {signs[type(f)]} ?")
                self.values.append(f.value)
            elif column in self.columns and isinstance(f, In) and all(map(plain, f.value)) and len(f.value) < 500:
                self.where.append(f"{_name(column)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif column in self.columns and isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{_name(column)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            else:
                yield f

    def _condition(self, *more: str) -> str:
        return " AND ".join([*self.where, *more]) or "1"

    def partitions(self) -> list[KeyRange]:
        with _opened(self.path) as c:
            cut = c.execute(f"SELECT min(k) FROM (SELECT rowid AS k, ntile({self.ranges}) OVER (ORDER BY rowid) AS part FROM {_name(self.table)} WHERE {self._condition()}) GROUP BY part ORDER BY 1", self.values).fetchall()
        firsts = [r[0] for r in cut]
        return [KeyRange(a, z) for a, z in zip(firsts, [*firsts[1:], None]) if a != z] or [KeyRange(None, None)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        if partition.first is None:
            return
        last, sign = partition.first, ">="
        with _opened(self.path) as c:
            while True:
                more, values = [f"rowid {sign} ?"], [last]
                if partition.end is not None:
                    more, values = [*more, "rowid < ?"], [*values, partition.end]
                rows = c.execute(f"SELECT {', '.join(['rowid', *map(_name, self.columns)])} FROM {_name(self.table)} WHERE {self._condition(*more)} ORDER BY rowid LIMIT {self.page}", [*self.values, *values]).fetchall()
                yield from (r[1:] for r in rows)
                if len(rows) < self.page:
                    return
                last, sign = rows[-1][0], ">"


@dataclass
class Bytes(InputPartition):
    first: int
    end: int


class ProgressLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "progress_log"

    def schema(self) -> str:
        return "i long, n long, done long, skip long, err long"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return ProgressReader(self.options["path"], int(self.options.get("bytes", LOG_BYTES)))


class ProgressReader(DataSourceStreamReader):
    #: What a line of progress looks like.
    FORM = re.compile(rb"^\[(\d+)/(\d+)\].*?done=(\d+).*?skip=(\d+).*?err=(\d+)")

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        """After the last whole line."""
        if not os.path.exists(self.path):
            return {"byte": 0}
        with open(self.path, "rb") as f:
            end = f.seek(0, os.SEEK_END)
            while end > 0:
                start = max(0, end - 4096)
                f.seek(start)
                k = f.read(end - start).rfind(b"\n")
                if k >= 0:
                    return {"byte": start + k + 1}
                end = start
        return {"byte": 0}

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        a, z = start["byte"], end["byte"]
        return [Bytes(k, min(k + self.size, z)) for k in range(a, z, self.size)]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        """The lines that begin in the range."""
        with open(self.path, "rb") as f:
            f.seek(partition.first)
            if partition.first > 0:
                f.seek(partition.first - 1)
                f.readline()  # the one before, unless it ends here
            while f.tell() < partition.end:
                if m := self.FORM.match(f.readline()):
                    yield tuple(map(int, m.groups()))


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class CommittedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return LinesWriter(self.options["path"], overwrite)


def committed_files(path: str) -> list[str]:
    """The files that count, by manifest: those of the last overwriting one and of all after it."""
    out: list[str] = []
    for m in sorted(x for x in os.listdir(path) if re.fullmatch(r"commit-\d{9}\.json", x)):
        with open(f"{path}/{m}") as f:
            told = json.load(f)
        out = [*([] if told["overwrite"] else out), *(f"{path}/data/{n}" for n in told["files"])]
    return out


class LinesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[T.Row]) -> Written:
        aside = f"{self.path}/aside"
        os.makedirs(aside, exist_ok=True)
        name, rows = f"{uuid.uuid4().hex}.jsonl", 0
        with open(f"{aside}/{name}", "w") as f:
            for r in iterator:
                f.write(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) + "\n")
                rows += 1
        return Written(name, rows)

    def commit(self, messages: list) -> None:
        os.makedirs(f"{self.path}/data", exist_ok=True)
        files = [m.name for m in messages if m is not None and m.rows]
        for n in files:
            os.replace(f"{self.path}/aside/{n}", f"{self.path}/data/{n}")
        number = max((int(x[7:16]) for x in os.listdir(self.path) if x.startswith("commit-")), default=-1) + 1
        draft = f"{self.path}/aside/{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            json.dump({"overwrite": self.overwrite, "files": files}, f)
        os.link(draft, f"{self.path}/commit-{number:09d}.json")  # fails if another job took the number
        self._clear([*messages, Written(os.path.basename(draft), 0)])

    def abort(self, messages: list) -> None:
        self._clear(messages)

    def _clear(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(f"{self.path}/aside/{m.name}"):
                os.remove(f"{self.path}/aside/{m.name}")


SOURCES = (PagedStore, ProgressLog, CommittedLines)
