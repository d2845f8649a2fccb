"""Workbooks as a Python data source: one partition a sheet, header rows found by the columns they must name.

``pandas.read_excel`` and the engine it needs are called on the executors only; finding a header works on any
matrix of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import MissingColumnsError
from ..functions.text import snake_name


def find_header(rows: Sequence[Sequence], columns: Sequence[str]) -> int:
    """The first row that holds all the names, compared in snake case."""
    want = {snake_name(c) for c in columns}
    for i, row in enumerate(rows):
        if want <= {snake_name(str(x)) for x in row if x is not None}:
            return i
    raise MissingColumnsError(f"no row names {sorted(want)}")


def sheet_table(rows: Sequence[Sequence], header: int = 0, find_by: Sequence[str] | None = None, standardize: bool = True) -> tuple[list[str], list[list]]:
    """Names and rows below the header of a sheet given as a matrix."""
    at = find_header(rows, find_by) if find_by else header
    names = [str(x) for x in rows[at]]
    return [snake_name(n) for n in names] if standardize else names, [list(r) for r in rows[at + 1 :]]


class ExcelDataSource(DataSource):
    """Options: path, sheet (all if absent), header, find_by (comma-separated), columns (the schema's names)."""

    @classmethod
    def name(cls) -> str:
        return "excel"

    def schema(self) -> str:
        return "sheet string, row bigint, name string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _ExcelReader(self.options)


class _ExcelReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def _sheets(self) -> list[str]:
        import pandas as pd

        return pd.ExcelFile(self.options["path"]).sheet_names

    def partitions(self):
        return [InputPartition(s) for s in ([self.options["sheet"]] if "sheet" in self.options else self._sheets())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pandas as pd

        matrix = pd.read_excel(self.options["path"], sheet_name=partition.value, header=None, dtype=object)
        rows = matrix.where(matrix.notna(), None).values.tolist()
        find_by = self.options.get("find_by")
        names, body = sheet_table(rows, int(self.options.get("header", 0)), find_by.split(",") if find_by else None)
        for i, row in enumerate(body):
            for name, value in zip(names, row):
                yield snake_name(partition.value), i, name, None if value is None else str(value)


def read_excel(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Cells as (sheet, row, name, value); pivot a sheet with ``long_to_wide``."""
    spark.dataSource.register(ExcelDataSource)
    reader = spark.read.format("excel").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def _of_sheet(option, sheet: str, sheets: Sequence[str]):
    """An option for one sheet: itself, or its entry in a dictionary by raw or snake-case names."""
    if not isinstance(option, dict):
        return option
    known = {snake_name(s) for s in sheets}
    unknown = [k for k in option if snake_name(k) not in known]
    if unknown:
        raise KeyError(f"no sheets {unknown}")
    return {snake_name(k): v for k, v in option.items()}.get(snake_name(sheet))


def workbook_tables(spark: SparkSession, sheets: dict[str, Sequence[Sequence]], standardize_columns=True, headers=0, column_names=None, index_columns=None, find_header_by_columns=None, ignore_sheets_with_no_header: bool = False) -> dict[str, DataFrame]:
    """Every sheet, given as a matrix, as a table of strings, by snake-case name; options may differ by sheet.

    ``index_columns`` come first. A sheet whose header is not found is an error, or left out.
    """
    out, names = {}, list(sheets)
    for sheet, rows in sheets.items():
        option = lambda o, sheet=sheet: _of_sheet(o, sheet, names)
        try:
            columns, body = sheet_table(rows, option(headers) or 0, option(find_header_by_columns), bool(option(standardize_columns)))
        except MissingColumnsError:
            if ignore_sheets_with_no_header:
                continue
            raise
        columns = list(option(column_names) or columns)
        text = [[None if x is None else str(x) for x in row] for row in body]
        df = spark.createDataFrame(text, ", ".join(f"`{c}` string" for c in columns))
        first = [snake_name(c) if option(standardize_columns) else c for c in option(index_columns) or []]
        out[snake_name(sheet)] = df.select(*first, *[c for c in columns if c not in first])
    return out


def read_workbook(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """``workbook_tables`` of a file on the driver; needs an engine that pandas can read workbooks with."""
    import pandas as pd

    sheets = pd.read_excel(path, sheet_name=None, header=None, dtype=object)
    return workbook_tables(spark, {n: m.where(m.notna(), None).values.tolist() for n, m in sheets.items()}, **options)
