"""CSV with line breaks inside quoted cells, read by as many tasks as the files have splits.

Whether a line begins a record depends on all quotes before it, so a split alone cannot tell. Two scans do:

1. every split is read under both assumptions, that it begins outside or inside a quoted cell. It reports how it would end
   and how many records would begin in it, one row a split;
2. the reports are folded in file order, which settles every split's assumption and the number of its first record;
3. the second scan cuts records. One that goes on beyond its split leaves fragments, which are put together by record number;
   only then is a third scan needed, for the fragments alone.

The reports are as many as the splits that the driver schedules anyway. A record's number, hence ``_ord``, is its place in the
files in the order of their paths, whatever the splits.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import ORD

REPORT = "file string, block bigint, outside_after boolean, inside_after boolean, starts_outside bigint, starts_inside bigint, head string"


def line_step(sep: str = ",") -> Callable[[str, bool], bool]:
    """Whether a quoted cell is open after a line, given whether one is open before it.

    A quote opens a cell only as its first character; a doubled quote inside one is text. What stands between a closing quote
    and the next separator belongs to the cell and opens nothing.
    """
    def step(line: str, inside: bool) -> bool:
        at = 0
        while True:
            if inside:
                end = line.find('"', at)
                while end >= 0 and line.startswith('"', end + 1):
                    end = line.find('"', end + 2)
                if end < 0:
                    return True
                inside, at = False, end + 1
            elif line.startswith('"', at):
                inside, at = True, at + 1
                continue
            at = line.find(sep, at)
            if at < 0:
                return False
            at += 1

    return step


def _segments() -> Callable[[pa.RecordBatch], Iterator[tuple[str, int, pa.Array, list[int]]]]:
    """Cuts a batch into stretches of one split: (file, block, lines, places of lines with a quote)."""
    def cut(batch: pa.RecordBatch):
        import numpy as np
        import pyarrow.compute as pc

        if not batch.num_rows:
            return
        files, blocks = batch.column(1).dictionary_encode(), batch.column(2).to_numpy(zero_copy_only=False)
        codes = files.indices.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            lines = batch.column(0).slice(low, high - low)
            quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()
            yield files.dictionary[int(codes[low])].as_py(), int(blocks[low]), lines, quoted

    return cut


def _survey(step, cut):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(key, states, starts, head, open_head):
            row = [key[0], key[1], *states, *starts, None if open_head or head is None else "\n".join(head)]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            names = ["file", "block", "outside_after", "inside_after", "starts_outside", "starts_inside", "head"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        key, states, starts, head, open_head = None, [False, True], [0, 0], None, False
        for batch in batches:
            for file, block, lines, quoted in cut(batch):
                if key != (file, block):
                    if key is not None:
                        yield report(key, states, starts, head, open_head)
                    key, states, starts = (file, block), [False, True], [0, 0]
                    head, open_head = ([], True) if block == 0 else (None, False)
                if open_head:  # the header, which may hold line breaks itself
                    inside = bool(head)
                    for i in range(len(lines)):
                        head.append(lines[i].as_py())
                        inside = step(head[-1], inside)
                        if not inside:
                            open_head = False
                            break
                at = 0
                for i in [*quoted, len(lines)]:
                    for a in (0, 1):
                        starts[a] += 0 if states[a] else i - at
                    if i < len(lines):
                        line = lines[i].as_py()
                        for a in (0, 1):
                            starts[a] += not states[a]
                        after = [step(line, s) for s in (False, True)] if states[0] != states[1] else [step(line, states[0])] * 2
                        states = [after[s] for s in states]
                    at = i + 1
        if key is not None:
            yield report(key, states, starts, head, open_head)

    return run


def _cut_records(step, cut, plan, fragments: bool):
    """Records of every split by ``plan``: whole ones, or else the fragments of those that cross an edge."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(numbers, texts, block):
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([block] * len(numbers), pa.int64()), pa.array(texts, pa.string())],
                                              names=["record", "block", "text"])

        key, inside, number, parts, foreign = None, False, 0, [], False
        for batch in batches:
            for file, block, lines, quoted in cut(batch):
                numbers, texts = [], []
                if key != (file, block):
                    if fragments and parts:
                        yield out([number - 1], ["\n".join(parts)], key[1])
                    key, parts = (file, block), []
                    inside, number = plan.value[key]
                    foreign = inside  # the record that is open belongs to an earlier split
                at = 0
                for i in [*quoted, len(lines)]:
                    if i > at:  # lines without a quote
                        if inside:
                            parts += lines.slice(at, i - at).to_pylist()
                        else:
                            if not fragments:
                                numbers += range(number, number + i - at)
                                texts += lines.slice(at, i - at).to_pylist()
                            number += i - at
                    if i < len(lines):
                        line = lines[i].as_py()
                        if not inside:
                            number += 1
                        parts.append(line)
                        inside = step(line, inside)
                        if not inside:
                            if foreign == fragments:
                                numbers.append(number - 1)
                                texts.append("\n".join(parts))
                            parts, foreign = [], False
                    at = i + 1
                if numbers:
                    yield out(numbers, texts, block)
        if fragments and parts:
            yield out([number - 1], ["\n".join(parts)], key[1])

    return run


def _header(text: str, sep: str) -> list[str]:
    """Names of the columns: trimmed, without a byte order mark; a repeated one gets _1, _2, ..., a blank one its place."""
    seen: dict[str, int] = {}
    names = []
    for i, cell in enumerate(next(csv.reader(io.StringIO(text.removesuffix("\r"), newline=""), delimiter=sep))):
        name = cell.strip().strip("\ufeff").strip() or f"_c{i}"
        seen[name] = seen.get(name, -1) + 1
        names.append(name if not seen[name] else f"{name}_{seen[name]}")
    return names


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file, or a folder of them with one header row spelling, with every cell as text and the record number ``_ord``.

    Quoted cells keep separators, doubled quotes and line breaks, however the files are split. Empty lines are no records;
    missing cells are blank and surplus ones dropped. A header row that does not end within its file's first split, or
    differs between files, is refused. A quote that is never closed makes the rest of its file one record, as it would for
    any reader.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    step, cut = line_step(sep), _segments()
    reports = lines.mapInArrow(_survey(step, cut), REPORT).collect()  # one row a split
    plan, heads, inside, number, file = {}, {}, False, 0, None
    for r in sorted(reports, key=lambda r: (r.file, r.block)):
        if r.file != file:
            file, inside = r.file, False
        if r.block == 0:
            heads[number] = r.head
        plan[r.file, r.block] = (inside, number)
        number += r.starts_inside if inside else r.starts_outside
        inside = r.inside_after if inside else r.outside_after
    if not heads:
        raise ValueError(f"no header row in {path}")
    if None in heads.values():
        raise ValueError("a header row must end within the first split of its file")
    names = {tuple(_header(h, sep)) for h in heads.values()}
    if len(names) > 1:
        raise ValueError(f"the files of {path} have different header rows: {sorted(names)[:2]}")
    shared = spark.sparkContext.broadcast(plan)
    schema = "record bigint, block bigint, text string"
    records = lines.mapInArrow(_cut_records(step, cut, shared, False), schema)
    whole = records.select("record", "text")
    crossing = [n for b, n in plan.values() if b]
    if crossing:
        parts = lines.mapInArrow(_cut_records(step, cut, shared, True), schema).groupBy("record").agg(
            F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
        whole = whole.unionByName(parts.select("record", F.array_join(F.transform("parts", lambda p: p.text), "\n").alias("text")))
    titles = names.pop()
    first = spark.createDataFrame([(n,) for n in heads], "record bigint")  # one a file
    whole = whole.join(F.broadcast(first) if len(heads) <= 10_000 else first, "record", "left_anti") if len(heads) > 1 else whole.where(
        F.col("record") != next(iter(heads)))
    text = F.when(F.col("text").endswith("\r"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    cells = F.from_csv(text, ", ".join(f"c{i} string" for i in range(len(titles))), {
        "sep": sep, "quote": '"', "escape": '"', "maxColumns": str(max(20_480, len(titles))), "maxCharsPerColumn": "-1",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    parsed = whole.where(text != "").select(cells.alias("cells"), F.col("record").alias(ORD))
    return parsed.select(*[F.coalesce(F.col(f"cells.c{i}"), F.lit("")).alias(name) for i, name in enumerate(titles)], ORD)
