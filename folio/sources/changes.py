"""Changes of the files under a folder as a stream: a data source whose offsets are listings.

A listing is written to the source's own folder under the shared one, numbered; an offset is a number. The rows between two offsets are the difference
of their listings: files that came (add), changed size or time (modify) or went (delete). Since listings are kept, a stream that is restarted
from its checkpoint gives a batch that was begun again with the same rows, and loses nothing that happened meanwhile but states that no listing saw.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from folio.storage import open_fs

NAME = "folio_file_changes"
SCHEMA = "path string, op string, size long, mtime double"
#: Rows of changes that one task gives.
ROWS = 10_000


class _Slice(InputPartition):
    def __init__(self, before: str | None, after: str, part: int, parts: int) -> None:
        self.before, self.after, self.part, self.parts = before, after, part, parts


def _ignored(path: str, extensions: tuple[str, ...], ignored: tuple[str, ...]) -> bool:
    steps = path.split("/")
    return any(s.startswith(".") or s.lower() in ignored for s in steps) or (bool(extensions) and path.rpartition(".")[2].lower() not in extensions)


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.log = options["path"].rstrip("/"), options["listings"].rstrip("/")
        self.extensions = tuple(x.strip().lower() for x in options.get("extensions", "md,html,htm").split(",") if x.strip())
        self.ignored = tuple(x.strip().lower() for x in options.get("ignored", "").split(",") if x.strip())

    def initialOffset(self) -> dict:
        return {"listing": -1}  # nothing: the first batch has all files as new

    def latestOffset(self) -> dict:
        """The number of a listing like what is there now: the last one if nothing has changed, else a new one."""
        fs, inner = open_fs(self.log)
        fs.create_dir(inner, recursive=True)
        numbers = _numbers(fs, inner)
        now = self._list()
        last = numbers[-1] if numbers else -1
        if (_read(fs, inner, last) if last >= 0 else {}) == now:
            return {"listing": last}
        with fs.open_output_stream(f"{inner}/{last + 1}.tmp") as out:
            out.write(json.dumps(now, sort_keys=True).encode())
        fs.move(f"{inner}/{last + 1}.tmp", f"{inner}/{last + 1}.json")
        return {"listing": last + 1}

    def _list(self) -> dict[str, list]:
        from pyarrow.fs import FileSelector

        fs, inner = open_fs(self.root)
        found = fs.get_file_info(FileSelector(inner, recursive=True, allow_not_found=True))
        files = {f.path[len(inner.rstrip("/")) + 1 :]: f for f in found if f.is_file}
        return {p: [f.size, f.mtime_ns / 1e9] for p, f in sorted(files.items()) if not _ignored(p, self.extensions, self.ignored)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["listing"] == end["listing"]:
            return []
        fs, inner = open_fs(self.log)
        n = len(_read(fs, inner, end["listing"])) + (len(_read(fs, inner, start["listing"])) if start["listing"] >= 0 else 0)
        parts = max(1, -(-n // ROWS))
        before = f"{self.log}/{start['listing']}.json" if start["listing"] >= 0 else None
        return [_Slice(before, f"{self.log}/{end['listing']}.json", i, parts) for i in range(parts)]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        import zlib

        old, new = (_load(p) if p else {} for p in (partition.before, partition.after))
        rows = []
        for path in sorted(old.keys() | new.keys()):
            if old.get(path) != new.get(path) and zlib.crc32(path.encode()) % partition.parts == partition.part:
                op = "add" if path not in old else "delete" if path not in new else "modify"
                rows.append((path, op, *(new.get(path) or (None, None))))
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)], names=["path", "op", "size", "mtime"])

    def commit(self, end: dict) -> None:
        """Listings before the one that a restart would begin at aren't needed."""
        fs, inner = open_fs(self.log)
        for number in _numbers(fs, inner):
            if number < end["listing"] - 1:
                fs.delete_file(f"{inner}/{number}.json")


def _numbers(fs, inner: str) -> list[int]:
    from pyarrow.fs import FileSelector

    return sorted(int(f.base_name[:-5]) for f in fs.get_file_info(FileSelector(inner)) if f.base_name.endswith(".json"))


def _read(fs, inner: str, number: int) -> dict[str, list]:
    with fs.open_input_stream(f"{inner}/{number}.json") as stream:
        return json.loads(stream.read())


def _load(path: str) -> dict[str, list]:
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner) as stream:
        return json.loads(stream.read())


class ChangeSource(DataSource):
    """Options: ``path``, ``listings`` (a folder of this stream's own, as lasting as its checkpoint), ``extensions`` and ``ignored`` names (with commas)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeReader(dict(self.options))


def file_changes(spark: SparkSession, path: str, listings: str, extensions: tuple[str, ...] = ("md", "html", "htm"), ignored: tuple[str, ...] = ()):
    """A stream (path, op: add, modify or delete, size, mtime) of what changes under ``path``; paths are relative. Names that begin with a dot and ``ignored`` ones are left out.

    A file that changes twice between two batches has one row, one that came and went none: listings see states. ``drain`` ends the stream after all that is there now."""
    spark.dataSource.register(ChangeSource)
    reader = spark.readStream.format(NAME).option("path", path).option("listings", listings)
    return reader.option("extensions", ",".join(extensions)).option("ignored", ",".join(ignored)).load()


def drain(query) -> None:
    """Takes in what is there now, then stops: no batch is cut off."""
    query.processAllAvailable()
    query.stop()
