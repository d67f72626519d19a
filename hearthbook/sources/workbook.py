"""A Spark data source for folders of XLSX workbooks: a partition per file, a row per sheet row.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("sheet", "2026").load("/shared/exports")

Only the sheets that the options name are parsed.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hearthbook.sources import tabular

SCHEMA = "path string, sheet string, row int, cells array<string>, note string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookSource(DataSource):
    """Options: path (a file or folder of pyarrow's file systems), sheet (one name) or sheets (a JSON list); by default all sheets.

    Columns: path, sheet, row (from 1), cells as text, and note, which is set in rows
    without cells: what a reader should know of a sheet, or why a file cannot be read.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options)


class WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.wanted = json.loads(options["sheets"]) if "sheets" in options else [options["sheet"]] if "sheet" in options else None

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = self._system()
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise ValueError(f"no such file or folder: {self.path}")
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(f.path) for f in sorted(files, key=lambda f: f.path) if f.is_file and f.path.lower().endswith(".xlsx")]

    def read(self, partition: _File):
        system, _ = self._system()
        with system.open_input_file(partition.path) as opened:
            content = opened.read()
        try:
            names = tabular.sheet_names(content) if self.wanted is None else self.wanted
        except tabular._BROKEN as broken:
            yield partition.path, None, 0, None, str(broken) or type(broken).__name__
            return
        for name in names:
            try:
                rows, notes = tabular.read_xlsx(content, name)
            except tabular._BROKEN as broken:
                yield partition.path, name, 0, None, str(broken) or type(broken).__name__
                continue
            for note in notes:
                yield partition.path, name, 0, None, note
            for k, cells in enumerate(rows, 1):
                yield partition.path, name, k, cells, None
