"""Delimited text without a task that reads a whole file: records may hold line ends in quotes.

Whether a line begins inside quotes hangs on all lines before it. Each line is taken as a
function of that one bit, a split as its lines' composition; the splits' functions are
composed in order (a row a split), and then every split knows how it begins. A record that
passes the end of a split leaves a piece on each side, and only such pieces are shuffled.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the first file from which its form is told.
HEAD = 256 * 1024
_WHOLE, _PIECE = 0, 1


def head_lines(spark: SparkSession, path: str) -> list[str]:
    """The first lines, up to HEAD characters, of the first file by name that has more than blank ones: a task without rows may write an empty file."""
    lines = spark.read.text(path)
    files = sorted(lines.inputFiles())
    if not files:
        return []
    of = lambda name: _head(lines.where(F.col("_metadata.file_path") == name))  # noqa: E731  names are encoded, so they are no paths to read
    head = of(files[0])
    if any(x.strip() for x in head):
        return head
    name = lines.where(F.rlike("value", F.lit(r"\S"))).agg(F.min("_metadata.file_path")).first()[0]
    return head if name is None else of(name)


def _head(lines: DataFrame) -> list[str]:
    first = lines.where("_metadata.file_block_start = 0").select(F.substring("value", 1, HEAD).alias("value"))
    out, size = [], 0
    for row in first.limit(2000).toLocalIterator():
        size += len(row.value) + 1
        out.append(row.value)
        if size >= HEAD:
            break
    return out


def ends_inside(line: str, inside: bool, sep: str, quote: str, escape: str) -> bool:
    """Whether the line ends inside quotes. A quote opens at a field's begin only; what follows a closing one up to the separator is part of the field."""
    i = 0
    marks = None if escape == quote else re.compile(f"{re.escape(escape)}.|{re.escape(quote)}", re.DOTALL)
    while True:
        if inside:
            if marks is None:
                j = line.find(quote, i)
                if j >= 0 and line.startswith(quote, j + 1):
                    i = j + 2
                    continue
            else:
                found = marks.search(line, i)
                if found and found[0] != quote:
                    i = found.end()
                    continue
                j = found.start() if found else -1
            if j < 0:
                return True
            inside, i = False, j + 1
        elif line.startswith(quote, i):
            inside, i = True, i + 1
            continue
        k = line.find(sep, i)
        if k < 0:
            return False
        i = k + len(sep)


def _plain(value: Column, sep: str, quote: str, escape: str) -> Column:
    """The line without its escaped characters and whole quoted fields; a quote in what is left may leave the line open."""
    if escape != quote:
        value = F.regexp_replace(value, re.escape(escape) + ".", "")
    value = F.replace(value, F.lit(quote * 2), F.lit(""))
    return F.regexp_replace(value, f"(^|{re.escape(sep)}){re.escape(quote)}[^{re.escape(quote)}]*{re.escape(quote)}(?={re.escape(sep)}|$)", "$1")


def fields_in(record: Column, sep: str, quote: str, escape: str) -> Column:
    """Number of fields of a record."""
    if escape != quote:
        record = F.regexp_replace(record, f"(?s){re.escape(escape)}.", "")
    record = F.replace(record, F.lit(quote * 2), F.lit(""))
    bare = F.regexp_replace(record, f"(?s)(^|{re.escape(sep)}){re.escape(quote)}[^{re.escape(quote)}]*{re.escape(quote)}", "$1")
    return F.size(F.split(bare, re.escape(sep), -1))


def spans_lines(lines: DataFrame, sep: str, quote: str = '"', escape: str = '"') -> bool:
    """Whether some record may go over a line's end: a line has a quote that is not part of a whole quoted field."""
    return not lines.where(F.contains("value", F.lit(quote)) & F.contains(_plain(F.col("value"), sep, quote, escape), F.lit(quote))).isEmpty()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Rows of (file, block, value) by split; a task may read several."""
    for batch in batches:
        start = 0
        files, blocks = batch.column(0), batch.column(1)
        while start < batch.num_rows:
            key = (files[start].as_py(), blocks[start].as_py())
            same = pc.and_(pc.equal(files, key[0]), pc.equal(blocks, key[1]))
            rest = pc.index(same.slice(start), pa.scalar(False)).as_py()
            end = batch.num_rows if rest < 0 else start + rest
            yield key, batch.slice(start, end - start)
            start = end


def records(lines: DataFrame, sep: str, quote: str = '"', escape: str = '"') -> tuple[DataFrame, int]:
    """(rows of record, first, number of records that never end) from ``value`` lines read as text; ``first`` marks each file's first record.

    Line ends inside quotes are ``\\n``, blank lines outside are left out.
    """
    named = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, closes = None, [False, True], False

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([ends[0]]), pa.array([ends[1]]), pa.array([closes])], ["file", "block", "outside", "inside", "closes"])

        for key, rows in _chunks(batches):
            if key != now:
                if now is not None:
                    yield told()
                now, ends, closes = key, [False, True], False
            values = rows.column(2)
            for line in values.filter(pc.match_substring(values, quote)).to_pylist():
                ends = [ends_inside(line, e, sep, quote, escape) for e in ends]
                closes = closes or not ends[1]
        if now is not None:
            yield told()

    splits = sorted(tuple(r) for r in named.mapInArrow(functions, "file string, block long, outside boolean, inside boolean, closes boolean").collect())  # a row a split
    begins: dict[tuple[str, int], tuple[bool, int]] = {}  # how a split begins, and the split whose last record is open then
    unended: list[tuple[str, int]] = []
    file, inside, opened = None, False, 0
    for name, block, outside_end, inside_end, closes in splits:
        if name != file:
            unended += [(file, opened)] if inside else []
            file, inside, opened = name, False, block
        begins[name, block] = (inside, opened)
        opened = block if closes or not inside else opened  # unless the split lies in one record from end to end
        inside = inside_end if inside else outside_end
    unended += [(file, opened)] if inside else []
    shared = lines.sparkSession.sparkContext.broadcast(begins)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, open_lines, out, number, tail = None, False, [], [], 0, False

        def put(kind: int, origin: int) -> None:
            out.append((now[0], origin, now[1], kind, number, "\n".join(open_lines), now[1] == 0 and number == 0))

        def told() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["file", "origin", "block", "kind", "number", "record", "first"])

        def close() -> None:
            if open_lines:  # the split ends in a record
                put(_PIECE, shared.value[now][1] if tail else now[1])

        for key, rows in _chunks(batches):
            if key != now:
                close()
                now, number, open_lines = key, 0, []
                inside = tail = shared.value[key][0]
            values = rows.column(2)
            quoted = pc.match_substring(values, quote).to_pylist()
            for line, has in zip(values.to_pylist(), quoted, strict=True):
                if not inside and not has and not line.strip():
                    continue
                open_lines.append(line)
                if has:
                    inside = ends_inside(line, inside, sep, quote, escape)
                if not inside:
                    put(_PIECE if tail else _WHOLE, shared.value[now][1] if tail else now[1])
                    number, open_lines, tail = number + 1, [], False
            if len(out) > 10_000:
                yield told()
                out = []
        if now is not None:
            close()
        if out:
            yield told()

    made = named.mapInArrow(joined, "file string, origin long, block long, kind int, number long, record string, first boolean")
    whole = made.where(F.col("kind") == _WHOLE).select("record", "first")
    pieces = made.where(F.col("kind") == _PIECE)
    for name, origin in unended:  # at most one a file
        pieces = pieces.where(~((F.col("file") == name) & (F.col("origin") == origin)))
    together = pieces.groupBy("file", "origin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "number", "record"))), lambda x: x["record"]), "\n").alias("record"), F.bool_or("first").alias("first"))
    return whole.unionByName(together.select("record", "first")), len(unended)


def typed(texts: DataFrame) -> DataFrame:
    """Columns of text as whole numbers, numbers, booleans, dates or times where all their values are; one pass."""
    forms = {
        "bigint": r"[-+]?\d{1,18}",
        "double": r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|NaN|[-+]?Inf(inity)?",
        "boolean": r"(?i)true|false",
        "date": r"\d{4}-\d{2}-\d{2}",
        "timestamp": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[-+]\d{2}:?\d{2})?",
    }
    checks = []
    for i, c in enumerate(texts.columns):
        x = F.trim(F.col(f"`{c}`"))
        checks += [F.coalesce(F.bool_and(F.when(x.isNotNull(), x.rlike(f"^({p})$") & x.try_cast(t).isNotNull())), F.lit(False)).alias(f"{t}{i}") for t, p in forms.items()]
        checks.append(F.coalesce(F.bool_and(F.when(x.isNotNull(), x.try_cast("int").isNotNull())), F.lit(False)).alias(f"int{i}"))
    found = texts.agg(*checks).first()
    out = []
    for i, c in enumerate(texts.columns):
        kind = next((t for t in forms if found[f"{t}{i}"]), None)
        kind = "int" if kind == "bigint" and found[f"int{i}"] else kind
        out.append(F.trim(F.col(f"`{c}`")).try_cast(kind).alias(c) if kind else F.col(f"`{c}`"))
    return texts.select(*out)


def first_record(lines: list[str], sep: str, quote: str = '"', escape: str = '"') -> list[str]:
    """Fields of the first record in a head of lines."""
    inside, taken = False, []
    for line in lines:
        if not taken and not line.strip():
            continue
        taken.append(line)
        inside = ends_inside(line, inside, sep, quote, escape)
        if not inside:
            break
    if not taken:
        return []
    text = "\n".join(taken).lstrip("﻿")
    if len(sep) > 1:
        return text.split(sep)
    return next(csv.reader([text] if "\n" not in text else text.splitlines(keepends=True), delimiter=sep, quotechar=quote, doublequote=escape == quote, escapechar=None if escape == quote else escape), [])
