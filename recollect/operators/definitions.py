"""Functions, classes and methods of Python files as chunks, found once for each distinct content."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "hash string, name string, kind string, start_line int, end_line int, parameters array<string>, calls array<string>"


#: Characters of a file that are parsed at once, at least; definitions of a batch of rows.
PART, ROWS_OUT = 1 << 14, 1000
#: Lines that begin a definition outside of all others. A statement before one has ended, or doesn't parse up to there.
_BEGIN = re.compile(r"^(?:@|(?:async[ \t]+)?def\b|class\b)", re.M)


def trees(text: str) -> Iterator[tuple[ast.Module, int]]:
    """Trees of successive parts of a file that parse by themselves, and the lines before each: as a part that parses has closed all
    brackets, texts and blocks, its statements are those that the whole file has there. A part that doesn't parse is doubled; the
    last error is that of the whole file."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    begin, line, size = 0, 0, PART
    while True:
        found = _BEGIN.search(text, begin + size) if begin + size < len(text) else None
        end = found.start() if found else len(text)
        try:
            tree = ast.parse(text[begin:end])
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            if end == len(text):
                raise
            size = 2 * (end - begin)
            continue
        yield tree, line
        if end == len(text):
            return
        line += text.count("\n", begin, end)
        begin, size = end, PART


def definitions_of(text: str) -> Iterator[tuple]:
    """(name, kind, first line, last line, parameters, calls of the body) of a file, part by part; an error if it can't be parsed."""

    def visit(node: ast.AST, parents: list[str], before: int) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inside = isinstance(child, ast.ClassDef)
                kind = "class" if inside else "method" if parents else "function"
                names = [] if inside else [a.arg for a in (*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs)]
                calls = [ast.unparse(c.func) for part in child.body for c in ast.walk(part) if isinstance(c, ast.Call)]
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                yield ".".join([*parents, child.name]), kind, before + first, before + child.end_lineno, names, calls
                yield from visit(child, [*parents, child.name], before)
            else:
                yield from visit(child, parents, before)

    for tree, before in trees(text):
        yield from visit(tree, [], before)


def batches_of(key: str, text: str) -> list[pa.RecordBatch]:
    """The definitions of a file in batches of ROWS_OUT rows; the whole file if it can't be parsed, which its last part tells."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in ROWS.split(", ")])
    out, rows = [], []
    try:
        for row in definitions_of(text):
            rows.append((key, *row))
            if len(rows) == ROWS_OUT:
                out.append(batch(rows))
                rows = []
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        out, rows = [], [(key, "", "file", 1, text.count("\n") + 1, [], [])]
    return [*out, batch(rows)] if rows else out


def chunk_definitions(files: DataFrame) -> DataFrame:
    """(file_path, name, kind, start_line, end_line, parameters, calls) of files (file_path, content)."""
    hashed = files.withColumn("hash", F.sha2("content", 256))
    distinct = hashed.groupBy("hash").agg(F.min("content").alias("content"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time
                yield from batches_of(batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or "")

    found = distinct.select("hash", "content").mapInArrow(run, ROWS)
    return hashed.select("file_path", "hash").join(found.hint("merge"), "hash").drop("hash")
