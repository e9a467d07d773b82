"""One JSON document of any size, read by many tasks: byte ranges, whose record borders are found exactly.

A byte in the middle of a document doesn't tell whether it stands inside a string, or how deep. So a first pass
summarises every range under both suppositions: does it flip inside and outside of strings, by how much does it change
the depth, how deep does it reach, and how many objects begin at which depth. From these few numbers a range the
driver works out the true state at every range's start. The ranges that reach the document's top level (one for each
of its few keys, about) are read once more for names and borders of its arrays. Then every range of a wanted array
hands out the records that begin in it, as JSON texts with their index in the array, reading on beyond its end for the
last one; Spark's own parser takes them from there.

Escapes, braces, brackets and quotes inside strings, nested records and any layout of blanks are told apart exactly.
Elements of a wanted array that aren't objects have no row and no index. A document must be UTF-8 and valid JSON.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import listed, store

SPLIT_BYTES, BLOCK = 32 << 20, 1 << 20
#: Bytes that are read at once beyond a range's end, to the end of its last record.
TAIL = 1 << 16
QUOTE, BACKSLASH, COMMA = b'"'[0], b"\\"[0], b","[0]
#: +1 for what opens, -1 for what closes; 2 for a quote, 3 for an opening brace.
_KIND = np.zeros(256, np.int8)
_KIND[[*b"{["]], _KIND[[*b"}]"]], _KIND[QUOTE] = 1, -1, 2
#: Objects of one record array begin at this depth: in the document's object, in its array.
RECORD_DEPTH = 2


def _escaped(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the quotes at these places follow an odd number of backslashes."""
    out = np.zeros(len(at), bool)
    for k in np.flatnonzero((at > 0) & (data[at - 1] == BACKSLASH)):
        i = int(at[k]) - 1
        while i >= 0 and data[i] == BACKSLASH:
            i -= 1
        out[k] = (int(at[k]) - 1 - i) % 2 == 1
    return out


class Window:
    """Blocks of a byte range, each with the backslashes that stand right before it; small ones from own on."""

    def __init__(self, path: str, start: int, end: int, own: int | None = None):
        self.fs, self.path = store(path)
        self.start, self.end, self.own = start, end, end if own is None else own

    def __iter__(self):
        """(offset, bytes as an array, how many of them belong to what came before)."""
        with self.fs.open_input_file(self.path) as f:
            at = self.start
            while at < self.end:
                data = f.read_at(min(BLOCK, self.own - at) if at < self.own else min(TAIL, self.end - at), at)
                if not data:
                    return
                lead = 0
                while at - lead > 0 and f.read_at(1, at - lead - 1) == b"\\":
                    lead += 1
                yield at, np.frombuffer(f.read_at(lead, at - lead) + data if lead else data, np.uint8), lead
                at += len(data)


def signs(data: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (without the lead) and kinds of the quotes, braces and brackets that count."""
    at = np.flatnonzero(_KIND[data])
    kind = _KIND[data[at]]
    quotes = np.flatnonzero(kind == 2)
    gone = quotes[_escaped(data, at[quotes])]
    return np.delete(at, gone) - lead, np.delete(kind, gone)


def _summary(path: str, start: int, end: int) -> dict:
    """flips, and for both suppositions (outside, inside): depth change, least depth, objects begun by depth before."""
    inside, depth, least, begun = [0, 1], [0, 0], [0, 0], [defaultdict(int), defaultdict(int)]
    for _, data, lead in Window(path, start, end):
        at, kind = signs(data, lead)
        flips = np.cumsum(kind == 2)
        for s in (0, 1):
            out = (kind != 2) & ((flips + inside[s]) % 2 == 0)
            step = kind[out].astype(np.int64)
            after = depth[s] + np.cumsum(step)
            objects = data[at[out] + lead] == b"{"[0]
            for d, n in zip(*np.unique((after - step)[objects], return_counts=True), strict=True):
                begun[s][int(d)] += int(n)
            least[s] = min(least[s], int(after.min(initial=least[s])))
            depth[s] = int(after[-1]) if len(after) else depth[s]
        turn = int(flips[-1]) % 2 if len(flips) else 0
        inside = [(i + turn) % 2 for i in inside]
    return {"flips": inside[0], "depth": depth, "least": least, "begun": [list(map(list, b.items())) for b in begun]}


def _string_end(path: str, start: int, size: int) -> bytes:
    """The string whose opening quote stands at start, as JSON text."""
    out = b""
    for _, data, lead in Window(path, start + 1, size, start):
        at, kind = signs(data, lead)
        ends = at[kind == 2]
        if len(ends):
            return b'"' + out + data[lead : lead + ends[0]].tobytes() + b'"'
        out += data[lead:].tobytes()
    return b'"' + out + b'"'


def _outline(path: str, start: int, end: int, size: int, inside: int, depth: int) -> list[list]:
    """What happens at the document's top in a range, in order: [key, text], [array, place], [object, place], [end, place]; and [records, n] between."""
    events: list[list] = []

    def records(n: int) -> None:
        if n and events and events[-1][0] == "records":
            events[-1][1] += n
        elif n:
            events.append(["records", n])

    for offset, data, lead in Window(path, start, end):
        at, kind = signs(data, lead)
        quote = kind == 2
        state = (np.cumsum(quote) + inside) % 2  # after each sign
        step = np.where(quote | (state == 1), 0, kind).astype(np.int64)
        after = depth + np.cumsum(step)
        before = after - step
        begins = (step == 1) & (before == RECORD_DEPTH) & (data[at + lead] == b"{"[0])
        top = np.flatnonzero((quote & (state == 1) & (after == 1)) | ((step == 1) & (before == 1)) | ((step == -1) & (after == 1)))
        last = 0
        for k in top:
            records(int(begins[last:k].sum()))
            last = k
            place = offset + int(at[k])
            if quote[k]:
                events.append(["key", _string_end(path, place, size)])
            elif step[k] == -1:
                events.append(["end", place])
            else:
                events.append(["array" if data[at[k] + lead] == b"["[0] else "object", place])
        records(int(begins[last:].sum()))
        if len(at):
            inside, depth = int(state[-1]), int(after[-1])
    return events


def _records(path: str, start: int, end: int, size: int, inside: int, depth: int, low: int, high: int):
    """Texts of the records that begin in [max(start, low), min(end, high)), in order."""
    stop = min(end, high)
    begun, kept = -1, b""
    for offset, data, lead in Window(path, start, size, stop):
        at, kind = signs(data, lead)
        quote = kind == 2
        state = (np.cumsum(quote) + inside) % 2
        step = np.where(quote | (state == 1), 0, kind).astype(np.int64)
        after = depth + np.cumsum(step)
        brace = data[at + lead]
        opens = at[(step == 1) & (after - step == RECORD_DEPTH) & (brace == b"{"[0])]
        closes = at[(step == -1) & (after == RECORD_DEPTH) & (brace == b"}"[0])]
        opens = opens[(opens + offset >= max(start, low)) & (opens + offset < stop)]
        raw = data[lead:].tobytes()
        if begun >= 0:
            if not len(closes):
                kept += raw
            else:
                yield kept + raw[: closes[0] + 1]
                begun, kept = -1, b""
        if begun < 0:
            ends = closes[np.searchsorted(closes, opens)] if len(closes) and len(opens) and opens[-1] < closes[-1] else None
            if ends is None and len(opens):
                whole = opens[opens < closes[-1]] if len(closes) else opens[:0]
                ends = closes[np.searchsorted(closes, whole)]
                begun, kept = int(opens[-1]) + offset, raw[opens[-1] :]
                opens = whole
            for a, b in zip(opens, ends if ends is not None else (), strict=True):
                yield raw[a : b + 1]
        if begun < 0 and offset + len(raw) >= stop:
            return
        if len(at):
            inside, depth = int(state[-1]), int(after[-1])


def _ranges(found: list[tuple[str, int]], split_bytes: int) -> list[dict]:
    return [{"path": p, "size": n, "start": a, "end": min(n, a + split_bytes)} for p, n in found for a in range(0, n, split_bytes)]


def _each(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A task for neighbouring rows of SPLIT_BYTES in all; for fewer, up to four tasks for each core."""
    held = sum(min(r["end"], r.get("high", r["end"])) - max(r["start"], r.get("low", 0)) for r in rows)
    tasks = min(len(rows), max(4 * spark.sparkContext.defaultParallelism, -(-held // SPLIT_BYTES)))
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], f"task int, {schema}")
    return df.repartitionById(tasks, F.floor(F.col("task").cast("long") * tasks / len(rows)).cast("int"))


def plan(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> list[dict]:
    """The ranges of all documents that a pattern names, with their state at the start, and the array parts in them."""
    import json

    ranges = _ranges(listed(spark, path), split_bytes)
    if not ranges:
        return []
    where = "path string, size long, start long, end long"

    def summed(batches):
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pylist([{"task": r["task"], "s": json.dumps(_summary(r["path"], r["start"], r["end"]))}], schema=pa.schema([("task", pa.int32()), ("s", pa.string())]))

    for r in _each(spark, ranges, where).mapInArrow(summed, "task int, s string").collect():
        ranges[r["task"]]["sum"] = json.loads(r["s"])
    inside = depth = 0
    for r in ranges:
        if r["start"] == 0:
            inside = depth = 0
        s = r.pop("sum")
        r |= {"inside": inside, "depth": depth, "top": depth + s["least"][inside] <= 1, "begun": dict(map(tuple, s["begun"][inside])).get(RECORD_DEPTH - depth, 0)}
        inside, depth = (inside + s["flips"]) % 2, depth + s["depth"][inside]
    tops = [r for r in ranges if r["top"]]

    def outlined(batches):
        for b in batches:
            for r in b.to_pylist():
                events = [[k, v.decode() if isinstance(v, bytes) else v] for k, v in _outline(r["path"], r["start"], r["end"], r["size"], r["inside"], r["depth"])]
                yield pa.RecordBatch.from_pylist([{"task": r["task"], "s": json.dumps(events)}], schema=pa.schema([("task", pa.int32()), ("s", pa.string())]))

    given = [{k: r[k] for k in ("path", "size", "start", "end", "inside", "depth")} for r in tops]
    for r in _each(spark, given, f"{where}, inside int, depth int").mapInArrow(outlined, "task int, s string").collect():
        tops[r["task"]]["events"] = json.loads(r["s"])
    key = array = None
    for r in ranges:
        if r["start"] == 0:
            key = array = None
            counts: dict = defaultdict(int)
        # Parts: [array, from, to, index of the first record].
        parts = [[array, r["start"], r["end"], counts[array]]] if array else []
        for what, value in r.pop("events", [["records", r["begun"]]]):
            if what == "key":
                key = json.loads(value)
            elif what == "array":
                array = key
                parts.append([array, value, r["end"], counts[array]])
            elif what == "records" and array:
                counts[array] += value
            elif what == "end":
                if array:
                    parts[-1][2] = value
                array = None
        r["parts"] = parts
    return ranges


def array_records(spark: SparkSession, ranges: list[dict], name: str) -> DataFrame:
    """path, pos (0-based), record (JSON text) of one array of the documents, range by range."""
    rows = [{k: r[k] for k in ("path", "size", "start", "end", "inside", "depth")} | {"low": low, "high": high, "first": first} for r in ranges for array, low, high, first in r["parts"] if array == name]
    if not rows:
        return spark.createDataFrame([], "path string, pos long, record string")

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                texts, held, pos = [], 0, r["first"]
                for text in _records(r["path"], r["start"], r["end"], r["size"], r["inside"], r["depth"], r["low"], r["high"]):
                    texts.append(text)
                    held += len(text)
                    if held >= BLOCK:
                        yield _batch(r["path"], pos, texts)
                        pos, texts, held = pos + len(texts), [], 0
                if texts:
                    yield _batch(r["path"], pos, texts)

    return _each(spark, rows, "path string, size long, start long, end long, inside int, depth int, low long, high long, first long").mapInArrow(read, "path string, pos long, record string")


def _batch(path: str, pos: int, texts: list[bytes]) -> pa.RecordBatch:
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(pos, pos + n), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["path", "pos", "record"])
