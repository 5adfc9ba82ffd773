"""A streaming source of lines from files that grow, with a cursor of (file, byte).

A folder's text files are read from where the last batch ended to their last line end;
a half line waits for the rest. The offset holds the places in the last ``settled`` files
(days, in order of their names) and the name of the last file before them: files up to
that name are final, are read to their end in the batch that settles them, and leave the
offset, so the cursor stays small while files come and go. Offsets are in the query's
checkpoint, so what was read is read once, line by line, after a restart too. Large
growths are cut at line ends into parts of about ``part_bytes``, one task each; tasks read
their byte ranges with pyarrow's file systems, by the path's scheme.

Cases: empty lines are lines without text and are left out; a last line without its end
waits, for ever if need be; what is added to a final file is not read; bytes that are no UTF-8 are replaced; a file that shrinks is
an error, as its cursor means nothing any more; a missing folder is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PART_BYTES, SETTLED = 8 << 20, 2
#: Bytes that are searched for a line end at a time.
STEP = 1 << 16


def _open(folder: str):
    """(file system, path) of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@dataclass
class Span(InputPartition):
    file: str
    start: int
    end: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.part, self.settled = int(options.get("part_bytes", PART_BYTES)), int(options.get("settled", SETTLED))
        self.suffix = options.get("suffix", ".jsonl")

    def _sizes(self) -> dict[str, int]:
        from pyarrow import fs

        system, path = _open(self.folder)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.is_file and f.base_name.endswith(self.suffix)}

    def _line_end(self, file: str, start: int, stop: int) -> int:
        """The place after the last line end between two places, or the first of them."""
        system, path = _open(self.folder)
        with system.open_input_file(f"{path}/{file}") as f:
            while stop > start:
                at = max(start, stop - STEP)
                f.seek(at)
                cut = f.read(stop - at).rfind(b"\n")
                if cut >= 0:
                    return at + cut + 1
                stop = at
        return start

    def initialOffset(self) -> dict:
        return {"done": "", "at": {}}

    def latestOffset(self) -> dict:
        sizes = self._sizes()
        names = sorted(sizes)
        done = names[-self.settled - 1] if len(names) > self.settled else ""
        return {"done": done, "at": {f: self._line_end(f, 0, sizes[f]) for f in names if f > done}}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        final = {f: self._line_end(f, 0, n) for f, n in self._sizes().items() if start["done"] < f <= end["done"]}
        for file, stop in sorted((final | end["at"]).items()):
            at = start["at"].get(file, 0)
            if at > stop:
                raise ValueError(f"{file} is shorter than what was read of it")
            while at < stop:
                cut = stop if stop - at <= self.part else self._line_end(file, at, at + self.part)
                cut = stop if cut == at else cut  # a line longer than a part
                out.append(Span(file, at, cut))
                at = cut
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        system, path = _open(self.folder)
        with system.open_input_file(f"{path}/{partition.file}") as f:
            f.seek(partition.start)
            at = partition.start
            for line in f.read(partition.end - partition.start).split(b"\n"):
                if line.strip(b"\r"):
                    yield partition.file, at, line.rstrip(b"\r").decode("utf-8", "replace")
                at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").load(folder)``: (file, at, line)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def growing_lines(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(file, at, line): a stream of the complete lines of a folder's files; ``at`` is the line's first byte."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").options(**options).load(folder)
