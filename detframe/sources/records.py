"""Record shards: framed binary files of serialised examples, written and read by executors.

A record is its length (64 bits, little-endian), the masked CRC-32C of those 8 bytes, the data, and the masked CRC-32C
of the data. The data is an example: a map from a column's name to a list of bytes, 32-bit floats or 64-bit integers,
in protocol-buffer encoding. Text, binary and their arrays become bytes, float and double floats (of 32 bits), whole
numbers and booleans integers; a null has no entry and comes back as null, an empty array has an entry without values.

Readers check both sums of every record; a mismatch or a torn end is an error that names file and offset. Shards are
written through a commit (see staged): one task a shard, so that a reader never sees half of one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import store
from .staged import StagedWriter, inside

#: The reflected Castagnoli polynomial, and what a sum is masked with.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes and records that are checked or decoded at once.
CHUNK_BYTES, CHUNK_RECORDS = 8 << 20, 4096


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


TABLE = _table()


def _zeros(n: int) -> np.ndarray:
    """What n zero bytes make of a state, for each of its four bytes."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(n):
        state = TABLE[state & 255] ^ (state >> 8)
    return state


_SHIFT: dict[int, np.ndarray] = {}


def crc32c(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of each of many byte strings, vectorised over equal pieces of all of them.

    The sum is linear: pieces are summed side by side, then joined in order; leading zeros change nothing.
    """
    out = np.zeros(len(blobs), np.uint32)
    sizes = np.array([len(b) for b in blobs], np.int64)
    for piece, low, high in ((4, 0, 64), (64, 64, 1 << 14), (1024, 1 << 14, 1 << 62)):
        own = np.flatnonzero((sizes >= low) & (sizes < high) & (sizes > 0))
        for part in np.array_split(own, max(1, int(sizes[own].sum()) // CHUNK_BYTES)) if len(own) else ():
            out[part] = _crc([blobs[i] for i in part], piece)
    return out


def _crc(blobs: list[bytes], piece: int) -> np.ndarray:
    if piece not in _SHIFT:
        _SHIFT[piece] = _zeros(piece)
    shift, sizes = _SHIFT[piece], np.array([len(b) for b in blobs])
    rows = -(-sizes // piece)
    first = np.concatenate(([0], np.cumsum(rows)))
    data = np.zeros(first[-1] * piece, np.uint8)
    for b, end in zip(blobs, first[1:] * piece, strict=True):
        data[end - len(b) : end] = np.frombuffer(b, np.uint8)
    # All sums start from ones: the first four bytes are inverted; of shorter texts what is left over is inverted at the end.
    start = first[1:] * piece - sizes
    for k in range(4):
        at = start[sizes > k] + k
        data[at] ^= 255
    data = data.reshape(-1, piece)
    state = np.zeros(len(data), np.uint32)
    for k in range(piece):
        state = TABLE[(state ^ data[:, k]) & 255] ^ (state >> 8)
    out = np.zeros(len(blobs), np.uint32)
    for k in range(int(rows.max())):
        live = rows > k
        s = out[live]
        moved = shift[0][s & 255] ^ shift[1][(s >> 8) & 255] ^ shift[2][(s >> 16) & 255] ^ shift[3][s >> 24]
        out[live] = moved ^ state[first[:-1][live] + k]
    left = np.where(sizes < 4, 0xFFFFFFFF >> np.minimum(8 * sizes, 31).astype(np.uint64), 0).astype(np.uint32)
    return out ^ left ^ np.uint32(0xFFFFFFFF)


def masked(sums: np.ndarray) -> np.ndarray:
    s = sums.astype(np.uint64)
    return ((((s >> np.uint64(15)) | (s << np.uint64(17))) & np.uint64(0xFFFFFFFF)) + np.uint64(MASK) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def frame(records: list[bytes]) -> bytes:
    """The records as they stand in a file."""
    heads = [struct.pack("<Q", len(r)) for r in records]
    of_head, of_data = masked(crc32c(heads)).tolist(), masked(crc32c(records)).tolist()
    return b"".join(x for h, a, r, d in zip(heads, of_head, records, of_data, strict=True) for x in (h, struct.pack("<I", a), r, struct.pack("<I", d)))


# ---- examples ---------------------------------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def kind_of(t: T.DataType) -> str:
    """bytes, float or int, of a column's type or its elements'."""
    t = t.elementType if isinstance(t, T.ArrayType) else t
    if isinstance(t, (T.StringType, T.BinaryType)):
        return "bytes"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(t, (T.IntegralType, T.BooleanType)):
        return "int"
    raise ValueError(f"no example holds a {t.simpleString()}")


def encode(row: dict, kinds: dict[str, str]) -> bytes:
    """One example; lists must not hold nulls."""
    entries = b""
    for name, kind in kinds.items():
        v = row[name]
        if v is None:
            continue
        values = v if isinstance(v, list) else [v]
        if kind == "bytes":
            feature = _field(1, b"".join(_field(1, x.encode() if isinstance(x, str) else x) for x in values))
        elif kind == "float":
            feature = _field(2, _field(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            feature = _field(3, _field(1, b"".join(_varint(int(x)) for x in values)))
        entries += _field(1, _field(1, name.encode()) + _field(2, feature))
    return _field(1, entries)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at += 1
        if b < 128:
            return out, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a message: bytes, a 32-bit or 64-bit word as bytes, or a varint."""
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        if tag & 7 == 0:
            value, at = _read_varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = _read_varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def decode(data: bytes) -> dict[str, list]:
    """Values by name: lists of bytes, floats or integers, packed or not."""
    out: dict[str, list] = {}
    for n, features in _fields(data):
        for m, entry in _fields(features) if n == 1 else ():
            if m != 1:
                continue
            parts = dict(_fields(entry))
            values: list = []
            for kind, body in _fields(parts.get(2, b"")):
                for _, v in _fields(body):
                    if kind == 1:
                        values.append(v)
                    elif kind == 2:
                        values += struct.unpack(f"<{len(v) // 4}f", v)
                    elif isinstance(v, int):
                        values.append(v - (1 << 64) if v >> 63 else v)
                    else:
                        at = 0
                        while at < len(v):
                            x, at = _read_varint(v, at)
                            values.append(x - (1 << 64) if x >> 63 else x)
            out[parts[1].decode()] = values
    return out


# ---- source and sink ----------------------------------------------------------------------------------------------


class ShardWriter(StagedWriter):
    """Rows come sorted by their first column, the file's path; the others are the example."""

    def __init__(self, root: str, kinds: dict[str, str]):
        super().__init__(root)
        self.kinds = kinds

    def stage(self, iterator, fs, folder):
        path, out, files = None, None, set()
        for batch in iterator:
            for start in range(0, batch.num_rows, CHUNK_RECORDS):
                rows = batch.slice(start, CHUNK_RECORDS).to_pylist()
                names = [r[batch.schema.names[0]] for r in rows]
                at = 0
                while at < len(rows):
                    to = at
                    while to < len(rows) and names[to] == names[at]:
                        to += 1
                    if names[at] != path:
                        if out:
                            out.close()
                        path = names[at]
                        if path in files:
                            raise ValueError(f"rows of {path} don't follow each other")
                        files.add(path)
                        parent = f"{folder}/{inside(path)}".rsplit("/", 1)[0]
                        fs.create_dir(parent, recursive=True)
                        out = fs.open_output_stream(f"{folder}/{path}")
                    out.write(frame([encode(r, self.kinds) for r in rows[at:to]]))
                    at = to
        if out:
            out.close()
        return len(files)


class ShardFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ShardReader(DataSourceReader):
    def __init__(self, root: str, schema: T.StructType):
        self.root, self.schema = root, schema

    def partitions(self):
        import pyarrow.fs as pafs

        fs, root = store(self.root)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(root) + 1 :].split("/"))
        return [ShardFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not hidden(f.path)] or [ShardFile("")]

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        target = to_arrow_schema(self.schema)
        fs, _ = store(self.root)
        for records in checked(fs, partition.path):
            rows = [decode(r) for r in records]
            columns = [pa.array([_value(r.get(f.name), f.dataType) for r in rows], target.field(f.name).type) for f in self.schema.fields]
            yield pa.RecordBatch.from_arrays(columns, schema=target)


def _value(values: list | None, kind: T.DataType):
    if values is None:
        return None
    of = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if isinstance(of, T.StringType):
        values = [v.decode() for v in values]
    elif isinstance(of, T.BooleanType):
        values = [bool(v) for v in values]
    return values if isinstance(kind, T.ArrayType) else values[0] if values else None


def checked(fs, path: str) -> Iterator[list[bytes]]:
    """The records of a file, many at once, after their sums were compared."""

    def verify(what: str, blobs: list[bytes], sums: list[int], places: list[int]) -> None:
        bad = np.flatnonzero(masked(crc32c(blobs)) != np.array(sums, np.uint32))
        if len(bad):
            raise ValueError(f"{path}: the checksum of {what} at byte {places[bad[0]]} is wrong")

    with fs.open_input_stream(path) as f:
        place, done = 0, False
        while not done:
            heads, head_sums, data, sums, places, held = [], [], [], [], [], 0
            while held < CHUNK_BYTES and len(data) < CHUNK_RECORDS:
                head = f.read(12)
                if not head:
                    done = True
                    break
                if len(head) < 12:
                    raise ValueError(f"{path}: torn record at byte {place}")
                n, sum_ = struct.unpack("<QI", head)
                # A broken length must not make the reader ask for it.
                verify("a length", [head[:8]], [sum_], [place]) if n > CHUNK_BYTES else None
                body = f.read(n + 4)
                if len(body) < n + 4:
                    verify("a length", [head[:8]], [sum_], [place])
                    raise ValueError(f"{path}: torn record at byte {place}")
                heads.append(head[:8])
                head_sums.append(sum_)
                data.append(body[:n])
                sums.append(struct.unpack("<I", body[n:])[0])
                places.append(place)
                place += n + 16
                held += n
            verify("a length", heads, head_sums, places)
            verify("a record", data, sums, places)
            if data:
                yield data


class RecordShards(DataSource):
    """`record_shards`: reads all files below a folder by a given schema, writes rows (path, columns of the example)."""

    @classmethod
    def name(cls) -> str:
        return "record_shards"

    def schema(self):
        raise ValueError("record shards are read by a schema that names the wanted columns")

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], {f.name: kind_of(f.dataType) for f in schema.fields[1:]})


def write_shards(rows: DataFrame, folder: str, order: list[str], shards: int, fold: str = "fold", shard: str = "shard") -> None:
    """rows with fold and shard (see hash_split), one file for each of both that has rows, in the given order; the other columns are the example."""
    spark = rows.sparkSession
    spark.dataSource.register(RecordShards)
    file = F.format_string(f"%s-shard-%05d-of-{shards:05d}", F.col(fold), F.col(shard))
    own = rows.select(file.alias("__file"), *[c for c in rows.columns if c not in (fold, shard)])
    own.repartition("__file").sortWithinPartitions("__file", *order).write.format("record_shards").mode("append").option("path", folder).save()


def read_shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All records below a folder; columns that an example lacks are null. One task a file."""
    spark.dataSource.register(RecordShards)
    return spark.read.format("record_shards").schema(schema).option("path", folder).load()
