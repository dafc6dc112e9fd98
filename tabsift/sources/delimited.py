"""Rows of delimited files with line breaks in quoted cells, cut in as many tasks as the file has splits.

Whether a line break ends a row depends on all quotes before it. So each split runs the quote automaton from both states it may begin in, and
says for each how it ends; one pass over these few numbers per split fixes the states; then every split cuts its rows, and a row that
goes on in later splits is put together from its pieces.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabsift.dataset import cut_lineage

#: Up to this many splits their states are broadcast; beyond that they are joined, and lines are put back in order.
BROADCAST_SPLITS = 100_000
#: A row of more characters than that, or through more splits, is a quote that was never closed.
LONGEST_ROW, ROW_SPLITS = 1 << 28, 64


class UnclosedQuote(ValueError):
    """A quoted cell never ends."""


def _automaton(separator: str):
    """line, state -> state after the line; states are 0 outside and 1 inside a quoted cell. Self-contained, as tasks get it by value."""
    def after(line: str, inside: int) -> int:
        if '"' not in line:
            return inside
        at = 0
        while True:
            if inside:
                end = line.find('"', at)
                if end < 0:
                    return 1
                if line[end + 1:end + 2] == '"':
                    at = end + 2
                    continue
                inside, at = 0, line.find(separator, end + 1) + 1              # what follows the closing quote belongs to the cell
                if not at:
                    return 0
            elif line[at:at + 1] == '"':
                inside, at = 1, at + 1
            else:
                at = line.find(separator, at) + 1
                if not at:
                    return 0
    return after


def physical_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(path, start, place, line): lines as they stand in the file, in the order of ``place`` within the split that begins at ``start``."""
    lines = spark.read.option("lineSep", "\n").text(path)
    raw = F.col("value").cast("binary")
    text = F.decode(raw, "ISO-8859-1") if encoding.upper() != "UTF-8" else F.col("value")
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"),
                        text.alias("line"))


def _summaries(lines: DataFrame, separator: str) -> DataFrame:
    """A row per split: the state after it for both states before it, and whether a row ends in it if it begins inside a quoted cell."""
    after = _automaton(separator)

    def run(batches):
        now, states, closes = None, [0, 1], False
        names = ["path", "start", "outside", "inside", "closes"]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([states[0]], pa.int32()), pa.array([states[1]], pa.int32()),
                                               pa.array([closes], pa.bool_())], names)
        for b in batches:
            for path, start, line in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), b.column("line").to_pylist()):
                if (path, start) != now:
                    if now:
                        yield batch()
                    now, states, closes = (path, start), [0, 1], False
                if states[0] == states[1]:
                    states = [after(line, states[0])] * 2
                else:
                    states = [after(line, states[0]), after(line, states[1])]
                closes = closes or states[1] == 0
        if now:
            yield batch()

    return lines.select("path", "start", "line").mapInArrow(run, "path string, start long, outside int, inside int, closes boolean")


def _states(summaries: DataFrame) -> DataFrame:
    """(path, start, state, owner): the state that each split begins in, and the split in which the row that is open there began."""
    limit = ROW_SPLITS

    def run(batches):
        now, state, owner, through = None, 0, None, 0
        for b in batches:
            out = {"path": [], "start": [], "state": [], "owner": []}
            for path, start, outside, inside, closes in zip(*(b.column(c).to_pylist() for c in ("path", "start", "outside", "inside", "closes"))):
                if path != now:
                    now, state, owner, through = path, 0, None, 0
                for name, v in zip(out, (path, start, state, owner)):
                    out[name].append(v)
                begins = not state or closes                                  # the row that is open at the end, if any, begins here
                through = 0 if begins else through + 1
                if through > limit:
                    raise ValueError(f"{path}: a quoted cell that is open at byte {owner} goes on through {through} splits")
                state, owner = (inside, owner) if state else (outside, None)
                owner = (start if begins else owner) if state else None
            yield pa.RecordBatch.from_arrays([pa.array(out["path"], pa.string()), pa.array(out["start"], pa.int64()), pa.array(out["state"], pa.int32()), pa.array(out["owner"], pa.int64())], list(out))

    rows = summaries.repartition("path").sortWithinPartitions("path", "start")
    return rows.mapInArrow(run, "path string, start long, state int, owner long")


def quoted_rows(spark: SparkSession, path: str, separator: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, header, text): the rows of the files, with the line breaks of their quoted cells; ``header`` marks the first row of each file. Blank rows are left out.

    A quote opens a cell only at its beginning; doubled quotes stand for one. A file that ends in an open cell ends its row there; a row longer than
    LONGEST_ROW raises an error, as a stray quote would turn the rest of a file into one cell. Lines are not shuffled, only the pieces of rows that go on in another split.
    """
    lines = physical_lines(spark, path, encoding)
    states = cut_lineage(_states(_summaries(lines, separator)))
    joined = lines.join(F.broadcast(states) if states.count() <= BROADCAST_SPLITS else states, ["path", "start"], "left")
    if states.count() > BROADCAST_SPLITS:
        joined = joined.repartition("path", "start").sortWithinPartitions("path", "start", "place")
    after, longest = _automaton(separator), LONGEST_ROW

    def run(batches):
        now, state, owner, held, size, first = None, 0, None, [], 0, True
        for b in batches:
            out = []
            for path, start, line, begin, mine in zip(*(b.column(c).to_pylist() for c in ("path", "start", "line", "state", "owner"))):
                if begin is None:
                    raise ValueError(f"{path}: no state of the split at {start}; the files changed while they were read")
                if (path, start) != now:
                    if held:
                        out.append((*now, owner if owner is not None else now[1], False, "\n".join(held)))
                    now, state, owner, held, size, first = (path, start), begin, mine if begin else None, [], 0, start == 0
                held.append(line)
                size += len(line) + 1
                if size > longest:
                    raise ValueError(f"{path}: a row near byte {start} has more than {longest} characters; is a quote never closed?")
                state = after(line, state)
                if not state:
                    text = "\n".join(held)
                    if owner is not None or text.strip():
                        out.append((path, start, owner, first and owner is None, text))
                        first = False
                    owner, held, size = None, [], 0
            yield batch(out)
        if held:
            yield batch([(*now, owner if owner is not None else now[1], False, "\n".join(held))])

    def batch(rows):
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], ["path", "start", "owner", "header", "text"])

    cut = cut_lineage(joined.select("path", "start", "line", "state", "owner").mapInArrow(run, "path string, start long, owner long, header boolean, text string"))
    pieces = cut.where("owner is not null").groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("pieces"))
    whole = pieces.select("path", (F.lit(False)).alias("header"), F.array_join(F.transform("pieces", lambda p: p["text"]), "\n").alias("text"))
    return cut.where("owner is null").select("path", "header", "text").unionByName(whole)


def cells(rows: DataFrame, names: list[str], separator: str) -> DataFrame:
    """One text column per name, ``c0`` and so on, and one more for what a row has beyond them; the header rows are left out."""
    schema = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    plain = F.regexp_replace("text", "\r$", "")
    parsed: Column = F.from_csv(plain, F.lit(schema), {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return rows.where("not header").select(parsed.alias("row")).select("row.*")
