"""Running a per-page parser over Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from inkferry.shipping import ship_package

FLUSH_CHARS = 8_000_000
RECURSION_LIMIT = 10_000  # ample for the depth that the page tree allows


def ddl(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"ARRAY<{ddl(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return f"STRUCT<{', '.join(f'{f.name}: {ddl(f.type)}' for f in kind)}>"
    if pa.types.is_boolean(kind):
        return "BOOLEAN"
    return "INT" if pa.types.is_int32(kind) else "STRING"


def map_pages(
    pages: DataFrame,
    keep: tuple[str, ...],
    inputs: tuple[str, ...],
    fields: dict[str, pa.DataType],
    parse: Callable[..., dict],
) -> DataFrame:
    """Call `parse(*inputs)` once per row; output `keep`, `fields` and `parse_error`.

    A page that cannot be parsed gives NULL fields and a message instead of failing the job. Output
    is flushed by the size of the text read, so long pages do not pile up in one batch.
    """
    kept = [f"`{name}` {pages.schema[name].dataType.simpleString()}" for name in keep]
    parsed_fields = [f"{name} {ddl(kind)}" for name, kind in fields.items()]
    schema = ", ".join([*kept, *parsed_fields, "parse_error STRING"])
    names = [*keep, *fields, "parse_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(RECURSION_LIMIT)
        for batch in batches:
            arguments = [batch.column(name) for name in inputs]
            columns: dict[str, list] = {name: [] for name in (*fields, "parse_error")}
            start, chars = 0, 0
            for row in range(batch.num_rows):
                values = [column[row].as_py() for column in arguments]
                try:
                    parsed, error = parse(*values), None
                except Exception as problem:  # one odd page must not stop the others
                    parsed, error = {}, f"{type(problem).__name__}: {problem}"
                for name in fields:
                    columns[name].append(parsed.get(name))
                columns["parse_error"].append(error)
                chars += sum(len(v) for v in values if v)
                if chars >= FLUSH_CHARS or row + 1 == batch.num_rows:
                    arrays = [batch.column(name).slice(start, row + 1 - start) for name in keep]
                    arrays += [pa.array(columns[name], type=kind) for name, kind in fields.items()]
                    arrays.append(pa.array(columns["parse_error"], type=pa.string()))
                    yield pa.RecordBatch.from_arrays(arrays, names)
                    start, chars = row + 1, 0
                    for done in columns.values():
                        done.clear()

    ship_package(pages.sparkSession)
    return pages.mapInArrow(run, schema)
