"""The members of one array inside JSON documents of any size, read by many tasks.

A document is scanned as text cut at ``}``, which Spark splits into blocks at
any byte. Where a block starts in the document is not known from the block, so
it is summed up twice, for a start inside and outside a string: the number of
its quotes and the change of depth either way. Composed over the blocks before
it, these say whether a block starts inside a string and how deep. With that
each block finds the borders of the array's members by itself; a member that
lies over several blocks is put together from its pieces.

What crosses a block is only its last open piece, so the scan holds one piece
of text at a time. Positions are counted by block and added up over blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUT = "}"
#: Bytes that are looked at together.
CHUNK = 4 << 20

_QUOTE, _ESCAPE = 0x22, 0x5C
_STEP = np.zeros(256, np.int32)
_STEP[[0x7B, 0x5B]], _STEP[[0x7D, 0x5D]] = 1, -1
_MARK = _STEP != 0
_MARK[[0x2C, 0x3A]] = True

NOT_WHOLE = "Not a whole JSON document: "


def area_of(name: str) -> Column:
    """An area's id is the name of its file without extension."""
    return F.regexp_extract(F.col(name), r"^(.*?)(\.[^.]*)?$", 1).alias("area_id")


def _quotes(chunk: np.ndarray) -> np.ndarray:
    """Places of the quotes that are not escaped."""
    quotes = np.flatnonzero(chunk == _QUOTE)
    escapes = np.flatnonzero(chunk == _ESCAPE)
    if not len(escapes):
        return quotes
    first = np.r_[True, np.diff(escapes) != 1]
    starts, ends = escapes[first], escapes[np.r_[first[1:], True]]
    return np.setdiff1d(quotes, ends[(ends - starts) % 2 == 0] + 1, assume_unique=True)


def _chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, bytes]]:
    """(keys of a block, some of its bytes); the cut characters are put back."""
    key, held, size = None, [], 0
    for batch in batches:
        texts, rows = batch.column("value"), zip(*(batch.column(k).to_pylist() for k in keys))
        for row, text in zip(rows, texts):
            if held and (row != key or size >= CHUNK):
                yield key, b"".join(held)
                held, size = [], 0
            key = row
            held += [text.as_py(), CUT.encode()]
            size += len(held[-2]) + 1
    if held:
        yield key, b"".join(held)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its quotes, and its change of depth for a start outside and inside a string."""
    found: dict[tuple, list[int]] = {}
    for key, data in _chunks(batches, ["file", "name", "block"]):
        chunk = np.frombuffer(data, np.uint8)
        own = found.setdefault(key, [0, 0, 0])
        quotes = _quotes(chunk)
        marks = np.flatnonzero(_STEP[chunk])
        inside = (np.searchsorted(quotes, marks) + own[0]) & 1
        steps = _STEP[chunk[marks]]
        for start in (0, 1):
            own[1 + start] += int(steps[inside == start].sum())
        own[0] += len(quotes)
    if found:
        names = ["file", "name", "block", "quotes", "outside", "inside"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, *own))) for key, own in found.items()])


SUMMARY = "file string, name string, block long, quotes long, outside long, inside long"
PIECE = "file string, block long, kind string, section long, n long, piece string, text binary"


class _Walk:
    """Pieces of one block, found from the depth and string state at its start."""

    def __init__(self, key: tuple, member: str, also: tuple[str, ...], in_string: bool, depth: int):
        self.key, self.member, self.also = key, member, also
        self.in_string, self.depth = in_string, depth
        # None: as the blocks before left it
        self.name: str | None = None if depth > 0 else ""
        self.mode: str | None = None if depth > 0 else "start"
        self.fresh = depth <= 0
        self.held: list[bytes] = []
        self.sections = 0
        self.counts = {0: 0}
        self.rows: list[tuple] = []

    def emit(self, kind: str | None, piece: str, text: bytes) -> None:
        """A piece; members of the array are counted in their section, 0 stands for the one open at the start."""
        section = self.sections if kind == self.member else 0
        n = -1
        if piece in ("whole", "head") and kind in (self.member, None):
            n = self.counts[section]
            self.counts[section] += 1
        self.rows.append((*self.key, kind, section, n, piece, text))

    def close_value(self, text: bytes) -> None:
        """A comma or brace ends a value of the document's own object."""
        if not self.fresh:
            if self.mode != "array":
                self.emit(None, "tail", text)
        elif self.mode in ("value", "object") and self.name in self.also:
            self.emit(self.name, "whole", text)
        elif self.mode == "value" and self.name == self.member:
            self.open_section()  # not an array: the last member of this name counts

    def open_section(self) -> None:
        self.sections += 1
        self.counts[self.sections] = 0

    def close_item(self, text: bytes, last: bool) -> None:
        """A comma or bracket ends a member of the array, or what may be one."""
        if not self.fresh:
            self.emit(None, "tail", text)
        elif not last or text.strip():
            self.emit(self.member if self.mode == "array" else None, "whole", text)

    def take(self, data: bytes) -> None:
        chunk = np.frombuffer(data, np.uint8)
        quotes = _quotes(chunk)
        marks = np.flatnonzero(_MARK[chunk])
        marks = marks[((np.searchsorted(quotes, marks) + self.in_string) & 1) == 0]
        steps = _STEP[chunk[marks]]
        after = self.depth + np.cumsum(steps, dtype=np.int64)
        before = after - steps
        kind = chunk[marks]
        near = ((steps == 0) & ((before == 1) | ((before == 2) & (kind == 0x2C)))) | ((steps != 0) & (np.minimum(before, after) <= 1))
        start = 0

        def segment(end: int) -> bytes:
            self.held.append(data[start:end])
            text = b"".join(self.held)
            self.held = []
            return text

        for at, what, low in zip(marks[near].tolist(), kind[near].tolist(), np.minimum(before, after)[near].tolist()):
            step = int(_STEP[what])
            if step > 0 and low == 0:
                self.name, self.mode = "", "key"
            elif step > 0:  # a value that is an array or object opens
                if self.mode == "value" and self.name == self.member:
                    self.open_section()
                    self.mode = "array" if what == 0x5B else "object"
                else:
                    self.mode = "object"
                    continue  # the text of other values goes on
            elif step < 0 and low == 1:
                if self.mode in ("array", None):
                    self.close_item(segment(at), True)
                    self.mode = "closed"
                elif self.name != self.member:
                    continue
                else:
                    self.mode = "closed"
            elif step < 0 or (what == 0x2C and low == 1):
                self.close_value(segment(at))
                self.name, self.mode = "", "key" if what == 0x2C else "end"
            elif what == 0x3A:
                text = segment(at)
                try:  # a name that goes over blocks holds a brace: it is none of those looked for
                    name = json.loads(text.strip().lstrip(b"{,")) if self.fresh and self.mode == "key" else ""
                except ValueError:
                    name = ""
                self.name, self.mode = (name if name == self.member or name in self.also else ""), "value"
            else:  # a comma between members
                if self.mode not in ("array", None):
                    continue
                self.close_item(segment(at), False)
            self.held, self.fresh, start = [], True, at + 1
        self.held.append(data[start:])
        self.in_string = bool((len(quotes) + self.in_string) & 1)
        self.depth = int(after[-1]) if len(after) else self.depth

    def finish(self) -> list[tuple]:
        text = b"".join(self.held)
        if not self.fresh:
            self.emit(None, "middle", text)
        elif self.mode == "array":
            self.emit(self.member, "head", text)
        elif self.mode is None:
            self.emit(None, "head", text)
        elif self.mode in ("value", "object") and self.name in self.also:
            self.emit(self.name, "head", text)
        else:
            self.emit("", "head", b"")
        # what is open at the end: the section found here, that of the start, or none
        state = "section" if self.mode == "array" else "start" if self.mode is None else "none"
        count = self.counts[self.sections if self.mode == "array" else 0]
        self.rows.append((*self.key, "state", self.sections, count, state, b""))
        return self.rows


def _pieces(member: str, also: tuple[str, ...]):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "kind", "section", "n", "piece", "text"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        walk = None
        for (file, block, in_string, depth), data in _chunks(batches, ["file", "block", "in_string", "depth"]):
            if walk is None or walk.key != (file, block):
                if walk is not None:
                    yield out(walk.finish())
                walk = _Walk((file, block), member, also, in_string, depth)
            walk.take(data)
            if walk.rows:
                yield out(walk.rows)
                walk.rows = []
        if walk is not None:
            yield out(walk.finish())

    return pieces


def _states(lines: DataFrame) -> DataFrame:
    """Where in its document each block starts; documents that do not end are an error."""
    found = lines.mapInArrow(_summaries, SUMMARY)
    order = Window.partitionBy("file").orderBy("block")  # one row a block
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    found = found.withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    found = found.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)).cast("long"))
    last = F.lead("block").over(order).isNull()
    # a cut character is put back at the end of the file, where there may have been none
    ends = F.col("depth") + F.col("change")
    open_string = (F.when(F.col("in_string"), 1).otherwise(0) + F.col("quotes")) % 2 == 1
    broken = last & (open_string | (ends > 0) | (ends < -1))
    return found.select("file", "name", "block", "in_string", F.when(
        broken, F.raise_error(F.concat(F.lit(NOT_WHOLE), "file")).cast("long")).otherwise(F.col("depth")).alias("depth"))


def read_array(spark: SparkSession, path: str, member: str, save, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(file, name, pos, json) of the members of the array ``member``, and (file, name, member, json) of the values ``also``.

    Each document of ``path`` is one object; where it names a member twice, the
    last one counts. ``save(df, name)`` stores the pieces and returns them.
    """
    lines = spark.read.option("lineSep", CUT).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"))
    # one small row a block: a million blocks are some 128 TB of text
    states = save(_states(lines), f"states-{member}")
    placed = lines.drop("name").join(F.broadcast(states.select("file", "block", "in_string", "depth")), ["file", "block"])
    pieces = save(placed.mapInArrow(_pieces(member, also), PIECE), f"pieces-{member}")

    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.filter("kind = 'state'").select("file", "block", F.col("section").alias("opened"), "n", F.col("piece").alias("state"))
    # members counted in the blocks before: differences of it count those of one section
    blocks = blocks.withColumn("so_far", F.coalesce(F.sum(F.when(F.col("state") != "none", F.col("n"))).over(before), F.lit(0)))
    opening = F.when(F.col("state") == "section", F.struct("block", F.col("opened").alias("section"), "so_far")).when(
        F.col("state") == "none", F.struct(*[F.lit(-1).cast("long").alias(c) for c in ("block", "section", "so_far")]))
    blocks = blocks.withColumn("from", F.last(opening, ignorenulls=True).over(before)).withColumn("latest", F.max(F.when(
        F.col("opened") > 0, F.struct("block", F.col("opened").alias("section")))).over(Window.partitionBy("file")))
    starts = blocks.select(
        "file", "block", F.struct("from.block", "from.section").alias("from"), "latest",
        (F.col("so_far") - F.col("from.so_far")).alias("carry"))
    starts = save(starts.join(states.select("file", "name", "block"), ["file", "block"]), f"starts-{member}")

    # pieces of what goes over blocks: a head, whole blocks, a tail
    parts = pieces.filter("piece IN ('head', 'middle', 'tail') AND (kind IS NULL OR kind <> 'state')").withColumn(
        "turn", F.when(F.col("piece") == "head", 1).otherwise(0))
    along = Window.partitionBy("file").orderBy("block", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = parts.withColumn("group", F.sum("turn").over(along)).groupBy("file", "group").agg(
        F.sort_array(F.collect_list(F.struct("block", "turn", "kind", "section", "n", "text"))).alias("p"))
    joined = grouped.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["kind"].alias("kind"), F.col("p")[0]["section"].alias(
        "section"), F.col("p")[0]["n"].alias("n"), F.array_join(F.transform("p", lambda x: x["text"].cast("string")), "").alias("json"))
    whole = pieces.filter("piece = 'whole'").select("file", "block", "kind", "section", "n", F.col("text").cast("string").alias("json"))
    items = whole.unionByName(joined).join(F.broadcast(starts), ["file", "block"])
    section = F.when(F.col("kind").isNull(), F.col("from")).otherwise(F.struct("block", "section"))
    # the condition stands in the value too: filters on a parsed member are moved below it and would parse other pieces
    wanted = F.coalesce((F.col("kind").isNull() | (F.col("kind") == member)) & (section == F.col("latest")), F.lit(False))
    found = items.filter(wanted).select(
        "file", "name", F.when(F.col("kind").isNull(), F.col("carry") + F.col("n")).otherwise(F.col("n")).alias("pos"),
        F.when(wanted, F.trim("json")).alias("json"))
    values = items.filter(F.col("kind").isin(*also)) if also else items.filter("false")
    last = Window.partitionBy("file", "kind").orderBy(F.col("block").desc(), F.col("at").desc())
    values = values.withColumn("at", F.monotonically_increasing_id()).withColumn("r", F.row_number().over(last)).filter("r = 1")
    return found, values.select("file", "name", F.col("kind").alias("member"), F.trim("json").alias("json"))
