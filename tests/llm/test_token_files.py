import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from detframe.llm import token_files
from detframe.llm.token_files import WordEncoder, map_file, ranges, token_digests, write_token_files

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
ODD = ["I'll've don't'S ''s 're it's'll", "Ünï ǅ İstanbul ΣΑΣ ß ﬁ é é café", "a b\x1cc\x85d\xa0e", "x<|endoftext|>y  <|startoftext|>", "日本語 テスト 123 ４５ ½", "\x00\x01 \x0b\x0c", "ABC...DEF!!! 12.5% a_b-c", "'" * 40 + "s", "a" * 3000, "²³¹ªº µ ×÷", "À LA FRANÇAISE 'S ÇA", "tab\tnew\r\nline"]


def test_encoder_equals_library():
    plain, e = Tokenizer.from_file(PATH), WordEncoder(PATH)
    for t in ODD * 2:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("shards", [1, 5])
def test_round_trip(spark, docs_of, texts, shards):
    rows = [*texts, *[(500 + i, t) for i, t in enumerate(ODD)], (None, "null id"), (3, texts[3][1])]
    folder, table, dtype = write_token_files(docs_of(rows).repartition(6), PATH, 2, shards=shards)
    plain = Tokenizer.from_file(PATH)
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids + [2]
    want = [(i, ids(t)) for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0])]
    got = []
    for s in sorted(table.collect()):
        assert s.base == sum(len(x) for _, x in got)
        tok, off, doc = map_file(f"{folder}/{s.shard:06d}.tok", dtype), map_file(f"{folder}/{s.shard:06d}.off", "<u8"), map_file(f"{folder}/{s.shard:06d}.doc", "<i8")
        got += [(None if d == -(2**63) else int(d), tok[a:b].tolist()) for d, a, b in zip(doc, off[:-1], off[1:])]
    assert got == want


def test_digests(spark, docs_of):
    r = token_digests(docs_of([(5, "a b"), (2, None), (9, "")])).orderBy("doc_id").collect()
    assert [(x.doc_id, x.start, x.n_tokens) for x in r] == [(2, 0, 1), (5, 1, 3), (9, 4, 1)]
    assert r[0].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())
    assert token_digests(docs_of([])).count() == 0


def test_shards_follow_the_size_of_the_text(spark, docs_of, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_TEXT", 1000)
    monkeypatch.setattr(token_files, "DRAWN", 4)
    rows = [(7 * i, f"text {i} " * 10) for i in range(400)]
    _, table, _ = write_token_files(docs_of(rows), PATH, 2)
    sizes = [r.n_docs for r in table.collect()]
    assert sum(sizes) == 400 and len(sizes) > 20 and max(sizes) < 100


class Store:
    """A store that is no local disk, with the ranges that were read."""

    type_name = "object"

    def __init__(self):
        self.fs, self.read = pafs.LocalFileSystem(), []

    def open_input_file(self, path):
        f, read = self.fs.open_input_file(path), self.read

        class File:
            __enter__ = lambda self: self
            __exit__ = lambda self, *_: f.close()

            def read_at(self, n, at):
                read.append((path[-3:], n, at))
                return f.read_at(n, at)

        return File()


@pytest.mark.parametrize("docs_at_once, ids_at_once", [(3, 5), (1000, 1), (4096, 1 << 22)])
def test_ranges_off_local_disks(spark, docs_of, texts, monkeypatch, docs_at_once, ids_at_once):
    folder, table, dtype = write_token_files(docs_of([*texts, (None, "null id")]), PATH, 2, shards=1)
    shards = pa.RecordBatch.from_pandas(table.toPandas())
    read = lambda: pa.Table.from_batches(token_files._read_shards(folder, dtype)([shards])).to_pylist()
    want, store = read(), Store()
    monkeypatch.setattr(token_files, "_open", lambda uri: (store, uri.removeprefix("file://")))
    monkeypatch.setattr(token_files, "BLOCK_DOCS", docs_at_once)
    monkeypatch.setattr(token_files, "BLOCK_IDS", ids_at_once)
    assert read() == want and len(want) == len(texts) + 1
    longest = max(r["n_tokens"] for r in want)
    assert all(n <= 2 * max(ids_at_once, longest) for x, n, _ in store.read if x == "tok")
    with ranges(f"{folder}/000000.off", "<u8") as off:
        assert off(0, 1).tolist() == [0]
