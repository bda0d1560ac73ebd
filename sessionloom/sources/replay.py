"""Stored rows replayed as a stream with offsets and a limit of rows per batch (Python Data Source API)."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    """Rows ``lo`` to ``hi`` of one row group."""

    file: str
    group: int
    lo: int
    hi: int


class Listing:
    """Row groups of a Parquet file or folder in order of file names; a row's address is its number in that order."""

    def __init__(self, path: str):
        self.fs, base = _open(path)
        found = [i for i in self.fs.get_file_info(pafs.FileSelector(base, recursive=True))] if self.fs.get_file_info(base).type == pafs.FileType.Directory else [self.fs.get_file_info(base)]
        self.files = sorted(i.path for i in found if i.is_file and i.path.endswith(".parquet"))
        self.groups, sizes = [], []
        for f in self.files:
            m = pq.read_metadata(f, filesystem=self.fs)
            for g in range(m.num_row_groups):
                self.groups.append((f, g))
                sizes.append(m.row_group(g).num_rows)
        self.starts = [0, *accumulate(sizes)]

    @property
    def rows(self) -> int:
        return self.starts[-1]

    def pieces(self, lo: int, hi: int) -> list[Piece]:
        first = max(0, bisect.bisect_right(self.starts, lo) - 1)
        out = []
        for (f, g), a, b in zip(self.groups[first:], self.starts[first:], self.starts[first + 1:]):
            if a >= hi:
                break
            if max(a, lo) < min(b, hi):
                out.append(Piece(f, g, max(a, lo) - a, min(b, hi) - a))
        return out


class _Rows:
    """Reads a piece as Arrow batches of the wanted columns."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(self.schema)
        fs, _ = _open(self.path)
        at = 0
        with fs.open_input_file(partition.file) as handle:
            for b in pq.ParquetFile(handle).iter_batches(8192, row_groups=[partition.group], columns=want.names):
                part = b.slice(max(0, partition.lo - at), max(0, min(partition.hi - at, len(b)) - max(0, partition.lo - at)))
                at += len(b)
                if len(part):
                    yield pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) for f in want], schema=want)
                if at >= partition.hi:
                    return


class ReplayReader(_Rows, DataSourceReader):
    def partitions(self) -> list[Piece]:
        found = Listing(self.path)
        return found.pieces(0, found.rows)


class ReplayStreamReader(_Rows, DataSourceStreamReader):
    """Offsets are row numbers.

    Spark asks for the newest offset before each batch; each answer is at most
    ``rows`` beyond the one before. Answers are noted as empty files in ``notes``,
    so a restarted query goes on above them; which rows a batch holds is decided
    by the offsets in Spark's own checkpoint, so no row is lost or given twice.
    """

    def __init__(self, path: str, schema: StructType, rows: int, notes: str):
        super().__init__(path, schema)
        self.rows, self.listing = rows, None
        self.note_fs, self.notes = _open(notes)
        self.note_fs.create_dir(self.notes, recursive=True)

    def _noted(self) -> list[int]:
        return [int(i.base_name) for i in self.note_fs.get_file_info(pafs.FileSelector(self.notes)) if i.base_name.isdigit()]

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        noted = max(self._noted(), default=0)
        if self.listing is None or noted >= self.listing.rows:  # all given: look for new files
            self.listing = Listing(self.path)
        row = max(noted, min(noted + self.rows, self.listing.rows))
        if row > noted:
            self.note_fs.open_output_stream(f"{self.notes}/{row:020d}").close()
        return {"row": row}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if self.listing is None or end["row"] > self.listing.rows:
            self.listing = Listing(self.path)
        return self.listing.pieces(start["row"], end["row"])

    def commit(self, end: dict) -> None:
        for row in self._noted():
            if row < end["row"]:
                self.note_fs.delete_file(f"{self.notes}/{row:020d}")


class Replay(DataSource):
    """``format("replay")``: options ``path``; for streams also ``rows`` (per batch) and ``notes`` (a folder the query owns).

    Files must not change while they are replayed; new ones must sort after the
    old. For streams the default trigger is meant: ``availableNow`` asks for one
    offset only, so it would stop after one batch.
    """

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> StructType:
        found = Listing(self.options["path"])
        return from_arrow_schema(pq.read_schema(found.files[0], filesystem=found.fs))

    def reader(self, schema: StructType) -> ReplayReader:
        return ReplayReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> ReplayStreamReader:
        rows = int(self.options["rows"])
        if rows < 1:
            raise ValueError("rows must be at least 1")
        return ReplayStreamReader(self.options["path"], schema, rows, self.options["notes"])


def read_replay(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    spark.dataSource.register(Replay)
    r = spark.read.format("replay").option("path", path)
    return (r.schema(schema) if schema is not None else r).load()


def stream_replay(spark: SparkSession, path: str, rows: int, notes: str, schema: StructType | None = None) -> DataFrame:
    spark.dataSource.register(Replay)
    r = spark.readStream.format("replay").option("path", path).option("rows", rows).option("notes", notes)
    return (r.schema(schema) if schema is not None else r).load()
