"""Filing lists as a data source of Spark: paged, with an early stop and filters that reach the reader.

A file holds lines ``ticker TAB page TAB json``, the pages of a ticker one after the other from the newest on; the JSON is a page's parallel
arrays. Each file is a task. Filters on form, ticker and filing date are applied while pages are read; once a page reaches
back before the least filing date that is asked for, the ticker's older pages are passed over without being parsed.

    spark.dataSource.register(SubmissionSource)
    spark.read.format("submissions").load(folder).where("form = '10-K' and filingDate >= '2024-01-01'")

Filters reach the reader where ``spark.sql.python.filterPushdown.enabled`` is true; without it Spark applies them afterwards and all
pages are read. Spark 4.1 keeps the filters of a loaded DataFrame's last plan for a later plan without any, so load anew for each
query. Pages with another set of fields than the schema's, or with arrays of unequal length, are errors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from factloom.sources.submissions import COLUMNS

PUSHED = ("form", "ticker", "filingDate")


@dataclass
class File(InputPartition):
    path: str


class SubmissionSource(DataSource):
    """Options: ``path``, and ``extra``: further fields, comma-separated, that a page may have and that are not read."""

    @classmethod
    def name(cls) -> str:
        return "submissions"

    def schema(self) -> str:
        return "ticker string, page int, pos int, " + ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema) -> DataSourceReader:
        return SubmissionReader(self.options["path"], tuple(filter(None, self.options.get("extra", "").split(","))))


class SubmissionReader(DataSourceReader):
    def __init__(self, path: str, extra: tuple[str, ...] = ()):
        self.path, self.extra = path, extra
        self.allowed: dict[str, set[str]] = {}
        self.least = ""
        self.above = ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if isinstance(f, (EqualTo, In)) and name in PUSHED:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.allowed[name] = self.allowed.get(name, values) & values
            elif isinstance(f, GreaterThanOrEqual) and name == "filingDate":
                self.least = max(self.least, f.value)
            elif isinstance(f, GreaterThan) and name == "filingDate":
                self.above = max(self.above, f.value)
            else:
                yield f  # Spark's to apply

    def _files(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        return system, sorted(i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and not i.base_name.startswith(("_", ".")))

    def partitions(self) -> list[File]:
        return [File(p) for p in self._files()[1]]

    def taken(self, row: dict[str, str]) -> bool:
        return all(row[n] in values for n, values in self.allowed.items()) and (row["filingDate"] or "") >= self.least and (not self.above or (row["filingDate"] or "") > self.above)

    def read(self, partition: File) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        done = None
        with system.open_input_stream(partition.path) as stream:
            for ticker, page, text in lines(stream):
                if ticker == done or ticker not in self.allowed.get("ticker", {ticker}):
                    continue
                columns = page_columns(text, f"{partition.path}: page {page} of {ticker}", self.extra)
                oldest = None
                for pos, values in enumerate(zip(*(columns[c] for c in COLUMNS), strict=True)):
                    row = {"ticker": ticker, **dict(zip(COLUMNS, values, strict=True))}
                    filed = row["filingDate"] or ""
                    oldest = filed if oldest is None or filed < oldest else oldest
                    if self.taken(row):
                        yield (ticker, page, pos, *values)
                if oldest is not None and (oldest < self.least or self.above and oldest <= self.above):
                    done = ticker  # older pages hold nothing that is asked for


def lines(stream, size: int = 1 << 20) -> Iterator[tuple[str, int, str]]:
    """(ticker, page, json) of a stream, a piece of it at a time."""
    rest = b""
    while piece := stream.read(size):
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield _line(line)
    if rest:
        yield _line(rest)


def _line(line: bytes) -> tuple[str, int, str]:
    ticker, page, text = line.decode("utf-8").split("\t", 2)
    return ticker, int(page), text


def page_columns(text: str, where: str, extra: tuple[str, ...] = ()) -> dict[str, list]:
    """The arrays of a page; an error names what does not fit the closed schema."""
    page = json.loads(text)
    if not isinstance(page, dict):
        raise ValueError(f"{where} is no object")
    missing, strange = [c for c in COLUMNS if c not in page], [c for c in page if c not in (*COLUMNS, *extra)]
    if missing or strange:
        raise ValueError(f"{where}: missing {missing}, unknown {strange}")
    if not all(isinstance(page[c], list) for c in COLUMNS) or len({len(page[c]) for c in COLUMNS}) > 1:
        raise ValueError(f"{where}: columns differ in length: {({c: len(page[c]) if isinstance(page[c], list) else None for c in COLUMNS})}")
    return page
