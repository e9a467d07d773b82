"""Token ids as flat unsigned integer files with 64-bit document offsets, read back through memory maps.

Layout of a shard NNNNNN below the output folder, all little-endian:
  NNNNNN.tok   ids of its documents one after another, uint16 (vocabulary up to 65,536) or uint32
  NNNNNN.off   uint64, documents + 1 entries: where each document begins in the .tok file, in ids
  NNNNNN.doc   int64 document ids in ascending order; a null id is the least int64 value
The shard table (shard, n_docs, n_tokens) gives each shard's base by prefix sums over shards, so that
document d of a shard starts at base + off[d] in the whole corpus.

Documents are tokenized where they are read; only compressed ids move. Shards are ranges of the document id,
about SHARD_TEXT bytes of text each and at least one a shuffle partition; their bounds are quantiles of the
ids (of about DRAWN a shard, by a hash). Bounds only place documents: every document is written. Within a shard
documents ascend; rows of one repeated id share a shard. Writer and reader stream: the writer holds one batch
of documents, the reader ranges of BLOCK_DOCS documents and about BLOCK_IDS ids, also off local disks. Files
are written under a name of their own and renamed, with equal content at every attempt, so a lost executor's
shard is just written again.

Defined results: a null or empty text has only the end id; equal doc ids stay next to each other, ordered by
their ids' bytes; further columns are ignored; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import contextlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, shuffle_partitions, small_batches, table

NULL_ID = -(2**63)
#: Bytes of text that a shard is made for, and ids from which a bound between two shards is taken.
SHARD_TEXT, DRAWN = 512 << 20, 100
#: Documents and ids that a reader takes at a time; a longer document comes alone.
BLOCK_DOCS, BLOCK_IDS = 4096, 1 << 22
#: Pieces whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 600_000

#: The normalizer and splitter for which the pieces below are exact.
_LOWER_CASED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Texts of these characters have no composed forms to normalise and one case mapping.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+"


class WordEncoder:
    """ids of a text by a tokenizer of the library; every piece of text is encoded once and remembered.

    A text is cut where the tokenizer's own splitter cuts it, if that is the known one and the text is of
    Western letters; else at blanks and line feeds, which can be part of no token of a tokenizer that splits
    at white space. Texts that may hold added tokens are encoded as a whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        made = json.loads(self.tokenizer.to_str())
        split = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        known = (made.get("normalizer") or {}).get("normalizers") == _LOWER_CASED and split.get("pattern") == {"Regex": _SPLIT} and split.get("behavior") == "Removed" and split.get("invert")
        self.pieces = re.compile(_PIECES).findall if known else None
        # What the splitter's last step makes of each character; after it only the model is left.
        visible = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytes = {c: visible(chr(c))[0][0] for c in range(33, 256) if _PLAIN.fullmatch(chr(c))}
        self.two = [np.array([i], self.dtype).tobytes() for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.added = [t["content"] for t in made["added_tokens"]]

    def _learn(self, new: list[str], plain: bool) -> None:
        known, two = self.known, self.two
        if plain:
            model, visible = self.tokenizer.model, self.bytes
            for w in new:
                known[w] = b"".join([two[t.id] for t in model.tokenize(w.translate(visible))])
            return
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = b"".join([two[i] for i in e.ids])

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        plain = self.pieces is not None and _PLAIN.fullmatch(text) is not None
        if plain:
            words = self.pieces(text.lower())
        else:
            words = text.replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            new = list({w for w in words if w not in known})
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(words))
            self._learn(new, plain)
            return b"".join([known[w] for w in words])


def _tokenize(path: str, end_id: int, bounds: list[int]):
    """Rows (doc_id, text) -> (shard, doc_id, packed ids); the shard is the number of bounds at or below the id."""

    def run(batches):
        import zstandard

        encoder, pack = WordEncoder(path), zstandard.ZstdCompressor(level=1)
        end, bounds_ = np.array([end_id], encoder.dtype).tobytes(), np.array(bounds, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids = [pack.compress((encoder.encode(t) if t else b"") + end) for t in piece.column(1).to_pylist()]
                shard = np.searchsorted(bounds_, pc.fill_null(piece.column(0), NULL_ID).to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), piece.column(0), pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"])

    return run


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _write_shards(folder: str, width: int):
    """Rows sorted by (shard, doc_id) -> one row a shard."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        fs, root = _open(folder)
        kinds = ("tok", "off", "doc")
        shard, n, end, temp, out = None, 0, 0, "", {}

        def close():
            for x in kinds:
                out[x].close()
                fs.move(f"{temp}.{x}", f"{root}/{shard:06d}.{x}")
            return pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n], "n_tokens": [end]})

        for batch in batches:
            of_shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of_shard)) + 1).tolist(), len(of_shard)]
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if at == to:
                    continue
                if of_shard[at] != shard:
                    if shard is not None:
                        yield close()
                    shard, n, end = int(of_shard[at]), 0, 0
                    temp = f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
                    out = {x: fs.open_output_stream(f"{temp}.{x}") for x in kinds}
                    out["off"].write(np.zeros(1, "<u8").tobytes())
                sizes = []
                for ids in batch.column(2).slice(at, to - at):
                    raw = unpack.decompress(ids.as_py())
                    out["tok"].write(raw)
                    sizes.append(len(raw) // width)
                ends = end + np.cumsum(sizes, dtype=np.int64)
                out["off"].write(ends.astype("<u8").tobytes())
                out["doc"].write(pc.fill_null(batch.column(1).slice(at, to - at), NULL_ID).to_numpy().astype("<i8").tobytes())
                n, end = n + to - at, int(ends[-1])
        if shard is not None:
            yield close()

    return run


def map_file(uri: str, dtype) -> np.ndarray:
    """A file of the format as an array: memory-mapped where the store is a local disk."""
    fs, path = _open(uri)
    if fs.type_name == "local":
        size = fs.get_file_info(path).size
        return np.memmap(path, dtype, "r") if size else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


@contextlib.contextmanager
def ranges(uri: str, dtype):
    """A function (a, b) -> items a to b of a file: of its map on a local disk, elsewhere read alone."""
    fs, path = _open(uri)
    if fs.type_name == "local":
        mapped = map_file(uri, dtype)
        yield lambda a, b: mapped[a:b]
        return
    width = np.dtype(dtype).itemsize
    with fs.open_input_file(path) as f:
        yield lambda a, b: np.frombuffer(f.read_at((b - a) * width, a * width), dtype)


def _read_shards(folder: str, dtype: str):
    def digests(tok, bounds):
        """crc32 of each document between bounds, from ranges of about BLOCK_IDS ids."""
        at = 0
        while at < len(bounds) - 1:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_IDS, side="right")) - 1)
            part, first = tok(bounds[at], bounds[to]), bounds[at]
            yield from (zlib.crc32(part[a - first : b - first].astype("<u4")) for a, b in zip(bounds[at:to], bounds[at + 1 : to + 1], strict=True))
            at = to

    def run(batches):
        for batch in batches:
            for shard, n, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "n_docs", "base")), strict=True):
                at = f"{folder}/{shard:06d}"
                with ranges(f"{at}.tok", dtype) as tok, ranges(f"{at}.off", "<u8") as off, ranges(f"{at}.doc", "<i8") as doc:
                    for i in range(0, n, BLOCK_DOCS):
                        j = min(n, i + BLOCK_DOCS)
                        ids, bounds = doc(i, j).astype(np.int64), off(i, j + 1).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(digests(tok, bounds.tolist()), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, shards: int | None = None) -> tuple[str, DataFrame, str]:
    """The folder, the shard table (shard, n_docs, n_tokens, base), and the ids' type."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch(spark, "token-files")
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    encoder = WordEncoder(vocabulary)
    n, bounds = shards, []
    if n is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(shuffle_partitions(spark), -(-size // SHARD_TEXT))
    if n > 1:
        share = min(1.0, DRAWN * n / max(1, docs.count()))
        drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
        bounds = drawn.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], DRAWN * n).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []))  # fewer than n numbers
    # A document's shard never depends on its place in the input.
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(vocabulary, end_id, bounds), "shard int, doc_id long, ids binary")
    placed = ids.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    stats = placed.mapInArrow(_write_shards(folder, encoder.dtype.itemsize), "shard long, n_docs long, n_tokens long").collect()  # one row a shard
    base, rows = 0, []
    for r in sorted(stats):
        rows.append((r.shard, r.n_docs, r.n_tokens, base))
        base += r.n_tokens
    table_ = spark.createDataFrame(rows, "shard long, n_docs long, n_tokens long, base long")
    return folder, table_, encoder.dtype.str


def read_token_files(folder: str, shards: DataFrame, dtype: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; start counts ids over all shards."""
    n = max(1, shards.count())
    return shards.repartitionById(n, (F.col("shard") % n).cast("int")).mapInArrow(_read_shards(folder, dtype), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return read_token_files(*write_token_files(docs, vocabulary, end_id))


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
