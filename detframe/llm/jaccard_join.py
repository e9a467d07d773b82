"""Exact Jaccard self-join of word-shingle sets, as a metric-space join with pivots, Voronoi regions and windows.

1. Sets. Words are split at ASCII white space, A-Z lower-cased; a document's set holds 64-bit hashes of its
   4-word shingles. Documents with one set are one node. Words are hashed by their bytes, eight at a time
   through a mixing function (long ones by BLAKE2b): no algebra of the letters makes two texts collide, and two
   different shingles of two compared sets have one hash with a chance of about 1e-13.
2. Regions. Unrelated texts lie at distance 1 from any pivot document, so pivots alone can't part them. The
   first regions are therefore the connected groups of sets that share a token of their prefixes, ordered by
   exact document frequency; sets at distance r = 0.15 or less always share one. Frequencies need every token
   once: scan tasks send their tokens, sorted and packed, to hash ranges, which count sets per token and send
   the tokens of two or more sets on to hash ranges of sets. Tokens of one set can't be shared and stay
   behind; sets whose prefixes hold only such tokens link with nothing. Tokens in a thousandth of all
   documents or more are known as heavy beforehand and bypass the counting, so no token floods a range. A
   task combines the sets of a token among its rows first, so a frequent token sends a row a task.
3. Pivots in a task. A few pivots get all distances; each set belongs to the cell of its nearest pivot, and a
   set y is copied into the cell of pivot p where d(y, p) <= d(y, own pivot) + 2r. Sets within r of a pivot
   are linked with it at once. Cells are joined in the same way again; where cells don't get smaller, each set
   is compared with the others that |d(x, p) - d(y, p)| <= r leaves for every pivot p and that aren't
   connected with it yet (another link would change no component).
4. Pivots across tasks. A region beyond one task's limits gets two pivots for each task-sized part of it, all
   distances to them, and becomes their Voronoi cells with the same windows; sets farther than CORE from all
   pivots are a cell of their own, without copies elsewhere. Cells are regions again. Sets linked through
   pivots need no comparison among each other: if such a group is half of a region or more, its cells are dealt
   out in parts, each with the few others within 2r of the cell's pivot. Where windows leave cells as large as
   the region, it is split by the tokens that two linked sets must share next in the order of rarity, and by
   classes of size. At any level two sets can link only if the tokens before their first common one are few
   (`excess`): where few sets satisfy that with any other, these meet the others part by part. Sets that all
   these bounds leave together are nearly linked, each with most others; only they are compared pair by pair.

Defined results: a null or wordless text has an empty set, size 0, and links with nothing; fewer than four
words are one shingle; repeated rows are documents of their own with one set; a null id gets the smallest
id of its component, null if there is none; an empty table gives no rows; texts and words of any length are
read to their end; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import connected_components, materialize, release_memory, shuffle_partitions, small, small_batches, table, text_pieces, utf8

SHINGLE, PERCENT = 4, 85
#: Tokens a scan task packs at once, tokens of a hash range, and share of documents of a heavy token.
FLUSH, RANGE, HEAVY = 1_000_000, 2_000_000, 1e-3
#: Limits of a region for one task.
REGION_SETS, REGION_TOKENS = 8_192, 8_000_000
#: Pivots of a large region at once, distance to a pivot up to which a cell reaches, tokens measured at once.
MAX_PIVOTS, CORE, MEASURED = 64, 0.7, 100_000
#: A region's cells are kept if the largest has this share of its sets or less, and all cells together so many times its sets.
SHRUNK, COPIES = 0.7, 3
#: Regions whose little tables are broadcast.
MANY_REGIONS = 100_000
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
ALWAYS = np.uint32(2**32 - 1)  # frequency of heavy tokens: last in the order of rarity


# ---- hashing ---------------------------------------------------------------------------------------------


def mix64(x):
    """A well-known 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Hashes of all words of a byte array at once, from eight bytes a step."""

    def __init__(self):
        self.lower, self.blank = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
        self.lower[65:91] += 32
        self.blank[[32, 9, 10, 11, 12, 13]] = True
        self.mask = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)

    def words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and its row; rows begin at off."""
        edge = np.ones(len(data) + 1, bool)  # a word starts or ends here if blank changes or a row begins
        blank = self.blank[data]
        edge[1:-1] = blank[1:] != blank[:-1]
        edge[off] = True
        cut = np.flatnonzero(edge)
        start, stop = cut[:-1], cut[1:]
        word = ~blank[start] if len(data) else np.zeros(0, bool)
        start, stop = start[word], stop[word]
        size = stop - start
        low = np.concatenate([self.lower[data], np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", low, strides=(1,))  # the eight bytes from each place on
        h = mix64(mix64(size.astype(np.uint64) + _STEP) ^ (eight[start] & self.mask[np.minimum(size, 8)]))
        more, done = np.flatnonzero(size > 8), 8
        while len(more) and done < LONG_WORD:
            rest = size[more] - done
            h[more] = mix64(h[more] * _STEP + (eight[start[more] + done] & self.mask[np.minimum(rest, 8)]))
            more, done = more[rest > 8], done + 8
        for i in more:
            h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
        return h, np.searchsorted(off, start, side="right") - 1

    def sets(self, column, shingle: int) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each row."""
        data, off = utf8(column)
        h, row = self.words(data, off)
        n = len(off) - 1
        bounds = np.searchsorted(row, np.arange(n + 1))

        def chained(parts):
            acc = mix64(parts[0] + np.uint64(len(parts)))
            for x in parts[1:]:
                acc = mix64(acc * _STEP + x)
            return acc

        full = chained([h[i : len(h) - shingle + 1 + i] for i in range(shingle)]) if len(h) >= shingle else h[:0]
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= shingle:
                out.append(np.unique(full[a : b - shingle + 1]))
            elif b > a:
                out.append(chained([h[i : i + 1] for i in range(a, b)]))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def set_name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix64(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a), int(b)


# ---- packed token lists ----------------------------------------------------------------------------------


def pack(names: np.ndarray, sizes: np.ndarray, index: np.ndarray, tokens: np.ndarray, freq: np.ndarray | None = None) -> bytes:
    """names (k, 2) and sizes of k sets; for each token the set's index, and maybe its frequency."""
    import zstandard

    order = np.argsort(tokens, kind="stable")
    t = tokens[order]
    step = np.diff(t, prepend=np.uint64(0))
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T)
    small = np.uint16 if len(names) <= 65_536 else np.uint32
    body = [names.astype("<u8").tobytes(), sizes.astype("<u4").tobytes(), index[order].astype(small).tobytes(), planes.tobytes()]
    if freq is not None:
        body.append(np.ascontiguousarray(freq[order].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
    head = np.array([len(names), len(tokens), freq is not None], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def unpack(blob: bytes):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, m, has = (int(x) for x in np.frombuffer(raw, "<u8", 3))
    at = 24
    names = np.frombuffer(raw, "<u8", 2 * k, at).reshape(k, 2)
    at += 16 * k
    sizes = np.frombuffer(raw, "<u4", k, at)
    at += 4 * k
    small = np.dtype(np.uint16 if k <= 65_536 else np.uint32)
    index = np.frombuffer(raw, small, m, at).astype(np.int64)
    at += small.itemsize * m
    tokens = np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * m, at).reshape(8, m).T).view(np.uint64).ravel(), dtype=np.uint64)
    at += 8 * m
    freq = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * m, at).reshape(4, m).T).view("<u4").ravel() if has else None
    return names, sizes, index, tokens, freq


def _ranges(x: np.ndarray, n: int) -> np.ndarray:
    return (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _deal(target: np.ndarray, names, sizes, index, tokens, freq=None):
    """(range, blob) for each range in target (one for each token), with only the sets that it needs."""
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = order[a:b]
        used, inv = np.unique(index[own], return_inverse=True)
        yield int(target[own[0]]), pack(names[used], sizes[used], inv, tokens[own], None if freq is None else freq[own])


def _gather(blobs):
    """All blobs as one, with every set once."""
    parts = [unpack(b) for b in blobs]
    names, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    base = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
    index, tokens = np.concatenate([p[2] + b for p, b in zip(parts, base, strict=True)]), np.concatenate([p[3] for p in parts])
    freq = np.concatenate([p[4] for p in parts]) if parts[0][4] is not None else None
    order = np.lexsort((names[:, 1], names[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (names[order[1:]] != names[order[:-1]]).any(axis=1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return names[first], sizes[first], number[index], tokens, freq


_RANGE_SCHEMA = "kind int, range int, blob binary"


def _rows(kind: int, dealt):
    dealt = list(dealt)
    for at in range(0, len(dealt), 64):
        part = dealt[at : at + 64]
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part), pa.int32()), pa.array([d[0] for d in part], pa.int32()), pa.array([d[1] for d in part], pa.binary())], ["kind", "range", "blob"])


# ---- distributed stages ------------------------------------------------------------------------------------


def _scan_sets(shingle: int, heavy_share: float):
    """A row for each document: uid, doc_id, name of its set, size; and locally frequent tokens with their counts as n."""

    def run(batches):
        hasher, uid = Hasher(), TaskContext.get().partitionId() << 40
        docs, seen, held, tokens, counts = 0, set(), [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        kind = pa.int64()

        def merge(held, tokens, counts, docs):
            u, c = np.unique(np.concatenate(held), return_counts=True) if held else (tokens[:0], counts[:0])
            u2, inv = np.unique(np.concatenate([tokens, u]), return_inverse=True)
            total = np.bincount(inv, np.concatenate([counts, c]), len(u2)).astype(np.int64)
            # As in lossy counting: what is below the share so far may go.
            keep = total >= max(2, int(heavy_share * docs / 2))
            return u2[keep], total[keep]

        waiting = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for piece in text_pieces(batch, 1):
                sets = hasher.sets(piece.column(1), shingle)
                names = [set_name(s) for s in sets]
                for s, name in zip(sets, names, strict=True):
                    if name not in seen and len(s):
                        seen.add(name)
                        held.append(s)
                        waiting += len(s)
                docs += len(sets)
                if waiting > FLUSH:
                    tokens, counts = merge(held, tokens, counts, docs)
                    held, waiting = [], 0
                    release_memory()
                    if len(seen) > 1_000_000:
                        seen.clear()
                n = len(sets)
                cols = [pa.array(np.arange(uid, uid + n)), piece.column(0), *(pa.array(np.array([x[i] for x in names], np.uint64).view(np.int64)) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(n, pa.int64())]
                uid += n
                yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "hi", "lo", "n", "heavy"])
        if docs:
            tokens, counts = merge(held, tokens, counts, docs)
            frequent = counts >= max(3, heavy_share * docs)
            n = int(frequent.sum())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in (pa.int64(), kind, pa.int64(), pa.int64())), pa.array(counts[frequent]), pa.array(tokens[frequent].view(np.int64))], ["uid", "doc_id", "hi", "lo", "n", "heavy"])

    return run


def _scan_tokens(shingle: int, heavy: np.ndarray, ranges: int):
    def flush(held):
        names = np.array([n for n, _ in held], np.uint64)
        sizes = np.array([len(s) for _, s in held], np.int64)
        index, tokens = np.repeat(np.arange(len(held)), sizes), np.concatenate([s for _, s in held])
        known = heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens if len(heavy) else np.zeros(len(tokens), bool)
        light = ~known
        yield from _rows(0, _deal(_ranges(tokens[light], ranges), names, sizes, index[light], tokens[light]))
        if known.any():
            i, t = index[known], tokens[known]
            yield from _rows(1, _deal(_ranges(names[i, 1], ranges), names, sizes, i, t, np.full(len(t), ALWAYS)))

    def run(batches):
        hasher, seen, held, waiting = Hasher(), set(), [], 0
        for batch in batches:
            for piece in text_pieces(batch, 0):
                for s in hasher.sets(piece.column(0), shingle):
                    if len(s) and (name := set_name(s)) not in seen:
                        seen.add(name)
                        held.append((name, s))
                        waiting += len(s)
                        if waiting > FLUSH:
                            yield from flush(held)
                            held, waiting = [], 0
                            seen.clear()
                            release_memory()
        if held:
            yield from flush(held)
        del held
        release_memory()

    return run


def _count_tokens(ranges: int):
    """Tokens of two or more sets, with their frequency, to the sets' ranges; heavy ones pass."""

    def run(batches):
        blobs = []
        for batch in batches:
            kinds, to, blob = (batch.column(i).to_pylist() for i in range(3))
            blobs += [b for k, b in zip(kinds, blob, strict=True) if k == 0]
            yield from _rows(1, [(t, b) for k, t, b in zip(kinds, to, blob, strict=True) if k == 1])
        if not blobs:
            return
        names, sizes, index, tokens, _ = _gather(blobs)
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        same = t[1:] == t[:-1]
        twice = np.zeros(len(t), bool)
        twice[1:] |= same
        twice[:-1] |= same
        t, i = t[twice], index[order[twice]]
        order = np.lexsort((i, t))
        t, i = t[order], i[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1])
        t, i = t[new], i[new]
        first = np.ones(len(t), bool)
        first[1:] = t[1:] != t[:-1]
        group = np.cumsum(first) - 1
        freq = np.bincount(group)[group] if len(t) else np.zeros(0, np.int64)
        keep = freq >= 2
        t, i, freq = t[keep], i[keep], freq[keep]
        del index, tokens, order, same, twice, blobs
        if len(t):
            yield from _rows(1, _deal(_ranges(names[i, 1], ranges), names, sizes, i, t, freq.astype(np.uint32)))
        del names, sizes, t, i, freq, new, group, keep
        release_memory()

    return run


def _prefixes(percent: int):
    """Sets that may have a partner: name, size, shared tokens by rarity, and how many of them are of the prefix."""

    def run(batches):
        blobs = [b for batch in batches for b in batch.column(2).to_pylist()]
        if not blobs:
            return
        names, sizes, index, tokens, freq = _gather(blobs)
        order = np.lexsort((tokens, freq, index))
        index, tokens = index[order], tokens[order]
        new = np.ones(len(index), bool)
        new[1:] = (index[1:] != index[:-1]) | (tokens[1:] != tokens[:-1])
        index, tokens = index[new], tokens[new]
        bounds = np.searchsorted(index, np.arange(len(names) + 1))
        n, shared = sizes.astype(np.int64), np.diff(bounds)
        # The first n - ceil(percent/100 n) + 1 tokens, less those that no other set has.
        take = n + percent * n // -100 + 1 - (n - shared)
        ids = np.flatnonzero(take > 0)
        for at in range(0, len(ids), 512):
            own = ids[at : at + 512]
            parts = [tokens[bounds[i] : bounds[i + 1]].view(np.int64) for i in own]
            yield pa.RecordBatch.from_arrays([pa.array(names[own, j].view(np.int64)) for j in (0, 1)] + [pa.array(n[own]), pa.array(parts, pa.list_(pa.int64())), pa.array(take[own], pa.int32())], ["hi", "lo", "n", "tokens", "take"])

    return run


# ---- the join of one region ----------------------------------------------------------------------------------


class Region:
    """Sets of a region that fits a task; `label` is the smallest index that links reach."""

    def __init__(self, n: np.ndarray, tokens: list[np.ndarray], percent: int, base: int = 32, pivots: int = 8):
        self.n, self.percent, self.base, self.pivots = n.astype(np.int64), percent, base, pivots
        self.off = np.cumsum([0] + [len(t) for t in tokens])
        _, self.flat = np.unique(np.concatenate(tokens), return_inverse=True)
        self.mark = np.zeros(int(self.flat.max()) + 1 if len(self.flat) else 1, bool)
        self.label = np.arange(len(n))
        # Two sets differ by their unshared tokens at least; see _excess.
        self.excess = self.n - np.diff(self.off) - self.n * (100 - percent) / (100 + percent)
        self.r = 1 - percent / 100
        self.rng = np.random.Generator(np.random.PCG64(len(n)))

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.off[x] : self.off[x + 1]]
        self.mark[own] = True
        size = self.off[others + 1] - self.off[others]
        ends = np.cumsum(size)
        hit = self.mark[self.flat[np.arange(ends[-1]) + np.repeat(self.off[others] - (ends - size), size)]]
        self.mark[own] = False
        sums = np.concatenate(([0], np.cumsum(hit)))
        return sums[ends] - sums[ends - size]

    def link(self, x: int, others: np.ndarray, shared: np.ndarray) -> None:
        union = self.n[x] + self.n[others] - shared
        near = others[100 * shared >= self.percent * union]
        if len(near):
            labels = np.unique(np.append(self.label[near], self.label[x]))
            if len(labels) > 1:
                self.label[np.isin(self.label, labels)] = labels[0]

    def compare(self, x: int, others: np.ndarray) -> None:
        others = others[(self.label[others] != self.label[x]) & (self.excess[others] + self.excess[x] <= 1e-6) & (100 * np.minimum(self.n[others], self.n[x]) >= self.percent * np.maximum(self.n[others], self.n[x]))]
        if len(others):
            self.link(x, others, self.shared(x, others))

    def join(self, sets: np.ndarray) -> None:
        """All links among `sets`, up to those that change no label."""
        if len(sets) <= self.base:
            for i, x in enumerate(sets[:-1]):
                self.compare(x, sets[i + 1 :])
            return
        pivots = self.rng.choice(sets, self.pivots, replace=False)
        d = np.empty((len(sets), len(pivots)))
        for j, p in enumerate(pivots):
            shared = self.shared(p, sets)
            d[:, j] = 1 - shared / (self.n[p] + self.n[sets] - shared)
            self.link(p, sets, shared)
        cell = d.argmin(axis=1)
        own = d[np.arange(len(sets)), cell]
        slack = 1e-9
        for j in range(len(pivots)):
            window = (cell == j) | (d[:, j] <= own + 2 * self.r + slack)
            home = cell == j
            if not home.any():
                continue
            if window.sum() <= 0.7 * len(sets):
                self.join(sets[window])
                continue
            # The cell is as large as the region: each home set against what all pivots leave.
            group, dg = sets[window], d[window]
            for x, dx in zip(sets[home], d[home], strict=True):
                open_ = self.label[group] != self.label[x]
                if open_.any():
                    self.compare(x, group[open_][(np.abs(dg[open_] - dx) <= self.r + slack).all(axis=1)])


def _join_regions(percent: int):
    """Rows sorted by region -> (sid, root) of every set that links reach."""

    def solve(rows):
        sids = np.array([r[0] for r in rows])
        order = np.argsort(sids, kind="stable")
        region = Region(np.array([rows[i][1] for i in order]), [rows[i][2] for i in order], percent)
        region.join(np.arange(len(rows)))
        sids = sids[order]
        root = sids[region.label]
        keep = root != sids
        return pa.RecordBatch.from_arrays([pa.array(sids[keep]), pa.array(root[keep])], ["a", "b"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            regions, sids, ns = (batch.column(i).to_pylist() for i in range(3))
            lists = batch.column(3)
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, (g, s, n) in enumerate(zip(regions, sids, ns, strict=True)):
                if g != now:
                    if len(rows) > 1:
                        yield solve(rows)
                    now, rows = g, []
                rows.append((s, n, flat[off[i] : off[i + 1]].copy()))
        if len(rows) > 1:
            yield solve(rows)

    return run



def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column, from its own start."""
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def _stars(batches):
    """(sid, prefix) -> links (a, b) of the sets that share a token here, and one set for each token (a, token)."""

    def flush(sids, tokens):
        sid, token = np.concatenate(sids), np.concatenate(tokens)
        u, at, inv = np.unique(token, return_index=True, return_inverse=True)
        pair = np.unique(np.stack([sid, sid[at][inv]], 1)[sid != sid[at][inv]], axis=0)
        none = pa.nulls(len(pair), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), none], ["a", "b", "token"])
        yield pa.RecordBatch.from_arrays([pa.array(sid[at]), pa.nulls(len(u), pa.int64()), pa.array(u)], ["a", "b", "token"])

    sids, tokens, held = [], [], 0
    for batch in batches:
        flat, off = _lists(batch.column(1))
        sids.append(np.repeat(batch.column(0).to_numpy(), np.diff(off)))
        tokens.append(flat)
        held += len(flat)
        if held > FLUSH:
            yield from flush(sids, tokens)
            sids, tokens, held = [], [], 0
    if held:
        yield from flush(sids, tokens)


_ROW = ("region", "sid", "n", "tokens", "take", "skip", "depth", "excess")
_ROW_SCHEMA = "region string, sid long, n long, tokens array<long>, take int, skip int, depth int, excess double"


def _measure(percent: int):
    """Rows sorted by region and salt, pivots (member 0) first -> members with the pivots that they are linked with,
    the cell of the nearest one (-1: none within CORE), all cells that hold them, and the cells within 2r."""
    r, slack = 1 - percent / 100, 1e-9

    def distances(rows, pivots):
        sid, size, held = zip(*pivots, strict=True)
        known, place = np.unique(np.concatenate(held), return_inverse=True)
        owns = np.zeros((len(known), len(pivots)), np.uint8)
        owns[place, np.repeat(np.arange(len(pivots)), [len(x) for x in held])] = 1
        flat, off = _lists(rows.column("tokens"))
        n, shared, at = rows.column("n").to_numpy()[:, None], [], 0
        while at < rows.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + MEASURED, side="right")) - 1)
            part = flat[off[at] : off[to]]
            i = np.minimum(np.searchsorted(known, part), len(known) - 1)
            hits = owns[i] * (known[i] == part)[:, None]
            shared.append(np.add.reduceat(hits, off[at:to] - off[at], axis=0, dtype=np.int64))
            at = to
        shared = np.concatenate(shared)
        union = n + np.array(size) - shared
        return np.array(sid), 1 - shared / union, 100 * shared >= percent * union

    def answer(rows, pivots):
        m = rows.num_rows
        if pivots:
            sid, d, linked = distances(rows, pivots)
            own = d.min(axis=1)
            home = np.where(own <= CORE, d.argmin(axis=1), -1)
            inside = d <= np.minimum(np.where(home >= 0, own + 2 * r, 2.0), CORE + r)[:, None] + slack
            inside[np.flatnonzero(home >= 0), home[home >= 0]] = True
            cells = [np.flatnonzero(x) if h >= 0 else np.append(np.flatnonzero(x), -1) for x, h in zip(inside, home, strict=True)]
            near = [np.flatnonzero(x) for x in d <= 2 * r + slack]
            linked = [sid[x] for x in linked]
        else:
            home, cells, near, linked = np.full(m, -1), [np.array([-1])] * m, [np.zeros(0, int)] * m, [np.zeros(0, int)] * m
        ints = lambda x: pa.array(x, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in _ROW), pa.array(linked, pa.list_(pa.int64())), pa.array(home, pa.int32()), ints(cells), ints(near)], [*_ROW, "linked", "home", "cells", "near"])

    def run(batches):
        now, pivots = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("region", "salt", "member")), strict=True))
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                rows = batch.slice(at, to - at)
                rows = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in rows.columns], rows.schema.names)
                if keys[at][:2] != now:
                    now, pivots = keys[at][:2], []
                if keys[at][2]:
                    yield answer(rows, pivots)
                else:
                    flat, off = _lists(rows.column("tokens"))
                    pivots += [(s, n, flat[a:b].copy()) for s, n, a, b in zip(rows.column("sid").to_pylist(), rows.column("n").to_pylist(), off[:-1], off[1:], strict=True)]
                at = to

    return run


def _excess(percent: int):
    """How many more tokens of a set are known to be in no linked set than half of two linked sets' difference.

    Sets x and y differ by (n_x + n_y) (1 - t) / (1 + t) tokens at most, t = percent / 100; so they link only if
    their excesses add up to 0 or less, and never if both are above 0. Without common tokens so far these are the
    tokens of no other set; in a block, those before the token that makes it, but for the common ones before.
    """
    return F.col("n") - F.size("tokens") + F.col("skip") - F.col("depth") - F.col("n") * (100 - percent) / (100 + percent)


def _by_tokens(rows: DataFrame, turn: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Blocks by the next token that linked sets share, and by size (a class of sizes and the next larger one), with
    the region that they are of as parent; and the parents whose largest block is much smaller.

    The (depth + 1)-th common token of linked sets stands among the first take + depth of each. Blocks without two
    sets, or whose sets are linked already (g), are left out, and so are sets that can't link in their block.
    """
    reach = F.greatest(F.col("take") + F.col("depth") - F.col("skip"), F.lit(0))
    size = F.floor(F.log("n") / (math.log(100 / percent) * 1.0001)).cast("int")
    out = rows.withColumn("size", size).select("*", F.posexplode(F.slice("tokens", F.col("skip") + 1, reach)).alias("pos", "token")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("guest"))
    region = F.concat_ws("/", "region", F.format_string(f"t{turn}:%d:%d", F.col("token"), F.col("size") - F.col("guest")))
    out = out.select(F.col("region").alias("parent"), "sets", region.alias("region"), "sid", "n", "tokens", "take", (F.col("skip") + F.col("pos")).alias("skip"), "depth", "g", "guest")
    out = out.withColumn("excess", _excess(percent)).withColumn("skip", F.col("skip") + 1).withColumn("depth", F.col("depth") + 1)
    same = (F.count("g") == F.count(F.lit(1))) & (F.min("g") == F.max("g"))
    kept = out.groupBy("parent", "sets", "region").agg(F.count(F.lit(1)).alias("c"), F.min("guest").alias("all_guests"), same.alias("same"), F.min("excess").alias("least"))
    kept = materialize(kept.where("c > 1 AND all_guests = 0 AND NOT coalesce(same, false) AND least <= 0").select("parent", "sets", "region", "least", "c"), "jaccard-blocks")
    wide = kept.where(F.col("c") > SHRUNK * F.col("sets")).select("parent").distinct()
    out = out.join(kept.select("region", "least"), "region").where(F.col("excess") + F.col("least") <= 1e-6)
    return out.select("parent", *_ROW), materialize(wide, "jaccard-wide")


def _split_large(rows: DataFrame, percent: int, max_sets: int, max_tokens: int):
    """Regions that one task can hold, from larger ones; the links found on the way; whether sets are in several regions.

    rows: region (string), sid, n, tokens (by rarity), take. A region's rows are dealt out by salts wherever they
    meet its pivots, and every turn gives rows in proportion to those it got.
    """
    done, links, turn = [], [], 0
    rows = rows.select("*", F.lit(0).alias("skip"), F.lit(0).alias("depth")).withColumn("excess", _excess(percent)).select(*_ROW)
    tokens = F.sum(F.size("tokens"))
    parts = lambda sets, toks: F.greatest(F.lit(1), F.ceil(2 * sets / max_sets), F.ceil(2 * toks / max_tokens)).cast("int")
    tag = lambda kind, *c: F.concat_ws("/", "region", F.concat(F.lit(f"{kind}{turn}:"), F.concat_ws(":", *c)))
    while True:
        low = F.col("excess") <= 0
        sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("sets"), tokens.alias("toks"), F.min("excess").alias("least"), F.sum(low.cast("int")).alias("lows"), F.sum(F.when(low, F.size("tokens")).otherwise(0)).alias("low_toks"))
        large = materialize(sizes.where((F.col("sets") > max_sets) | (F.col("toks") > max_tokens)), "jaccard-large")
        done.append(rows.join(large.select("region"), "region", "left_anti").select("region", "sid", "n", "tokens"))
        if large.isEmpty():
            break
        few = (2 * F.col("lows") <= max_sets) & (2 * F.col("low_toks") <= max_tokens)
        large = small(large.select("region", "sets", "least", few.alias("few"), parts(F.col("sets"), F.col("toks")).alias("parts")), MANY_REGIONS)
        own = rows.join(large, "region").where(F.col("excess") + F.col("least") <= 1e-6)
        # Of two linked sets one is low: where these are few, they meet the others part by part.
        part = F.pmod(F.xxhash64(F.lit(turn), "sid"), F.col("parts")).cast("int")
        meet = own.where("few").select("*", F.explode(F.when(low, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))).alias("part"))
        done.append(meet.select(tag("few", "part").alias("region"), "sid", "n", "tokens"))
        own = own.where("NOT few")

        # Pivots: of the sets drawn by a hash, the first; each salt of a region gets them all.
        k, draw = F.least(F.col("parts") + 1, F.lit(MAX_PIVOTS)), F.xxhash64(F.lit(turn), F.lit("pivot"), "sid")
        drawn = own.where(F.pmod(draw, F.lit(1 << 30)) < F.lit(float(1 << 30)) * 8 * k / F.col("sets"))
        drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("region").orderBy(draw, "sid"))).where(F.col("nth") <= k)
        salts = F.sequence(F.lit(0), F.least(F.col("parts"), F.lit(1024)) - 1)
        pivots = drawn.select(*_ROW, F.explode(salts).alias("salt"), F.lit(0).alias("member"))
        members = own.select(*_ROW, F.pmod(F.xxhash64("sid"), F.size(salts)).cast("int").alias("salt"), F.lit(1).alias("member"))
        met = pivots.unionByName(members).repartition(shuffle_partitions(rows.sparkSession), "region", "salt").sortWithinPartitions("region", "salt", "member")
        met = materialize(met.mapInArrow(_measure(percent), f"{_ROW_SCHEMA}, linked array<long>, home int, cells array<int>, near array<int>"), "jaccard-measured")
        links.append(met.select(F.col("sid").alias("a"), F.explode("linked").alias("b")).where("a <> b"))
        first = F.get("linked", F.lit(0))
        ties = materialize(met.where(F.size("linked") > 1).select(first.alias("a"), F.explode("linked").alias("b")).where("a <> b").distinct(), "jaccard-ties")
        met = met.withColumn("node", first)
        if ties.isEmpty():
            met = met.withColumn("g", F.col("node"))
        else:  # at most MAX_PIVOTS a region
            named = materialize(connected_components(ties, "jaccard-pivots"), "jaccard-pivots")
            met = met.join(small(named, MANY_REGIONS), "node", "left").withColumn("g", F.coalesce("root", "node")).drop("root")

        groups = met.where("g IS NOT NULL").groupBy("region", "g").agg(F.count(F.lit(1)).alias("c"))
        groups = groups.groupBy("region").agg(F.max(F.struct("c", "g")).alias("most"))
        cells = met.select("region", F.explode("cells").alias("cell")).groupBy("region", "cell").agg(F.count(F.lit(1)).alias("c"))
        cells = cells.groupBy("region").agg(F.max("c").alias("widest"), F.sum("c").alias("copies"))
        way = large.join(cells, "region").join(groups, "region", "left").select("region", "sets", "parts", "widest", "copies", F.col("most.g").alias("ball"), F.coalesce("most.c", F.lit(0)).alias("in_ball"))
        way = small(materialize(way, "jaccard-groups"), MANY_REGIONS)
        met = met.join(way.select("region", "sets", "parts", "ball"), "region").withColumn("inside", F.coalesce(F.col("g") == F.col("ball"), F.lit(False)))
        outside = met.where("NOT inside").select("region", F.explode("near").alias("home"), F.size("tokens").alias("t")).groupBy("region", "home").agg(F.count(F.lit(1)).alias("c"), F.sum("t").alias("t"))
        outside = materialize(outside, "jaccard-outside")
        crowded = outside.groupBy("region").agg(F.max("c").alias("around"), F.max("t").alias("around_toks"))
        half = 2 * F.col("in_ball") >= F.col("sets")
        ball = half & (2 * F.coalesce("around", F.lit(0)) <= max_sets) & (2 * F.coalesce("around_toks", F.lit(0)) <= max_tokens)
        apart = (F.col("widest") <= SHRUNK * F.col("sets")) & (F.col("copies") <= COPIES * F.col("sets"))
        way = way.join(crowded, "region", "left").select("region", half.alias("half"), F.when(ball, "ball").when(apart, "cells").otherwise("tokens").alias("way"))
        way = materialize(way, "jaccard-ways")
        rows = met.join(small(way, MANY_REGIONS).select("region", "way"), "region").where("way = 'cells'").withColumn("cell", F.explode("cells")).withColumn("region", tag("cell", "cell")).select(*_ROW)

        balls = way.where("way = 'ball'").select("region")
        left = way.where("way = 'tokens'").select("region", "half")
        if not left.isEmpty():
            blocks, wide = _by_tokens(met.join(small(left.select("region"), MANY_REGIONS), "region"), turn, percent)
            wide = small(wide.select(F.col("parent").alias("region")), MANY_REGIONS)
            rows = rows.unionByName(blocks.join(wide.withColumnRenamed("region", "parent"), "parent", "left_anti").select(*_ROW))
            left = left.join(wide, "region", "left_semi")
            balls = balls.unionByName(left.where("half").select("region"))
            # What every bound leaves together: part against part.
            other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
            pairs = met.join(small(left.where("NOT half").select("region"), MANY_REGIONS), "region").withColumn("part", part).withColumn("other", other)
            done.append(pairs.select(tag("pair", F.least("part", "other"), F.greatest("part", "other")).alias("region"), "sid", "n", "tokens"))
        balls = met.join(small(balls, MANY_REGIONS), "region").drop("parts")
        tiles = balls.where("inside").groupBy("region", "home").agg(F.count(F.lit(1)).alias("c"), tokens.alias("t")).withColumn("parts", parts(F.col("c"), F.col("t"))).drop("c", "t")
        tiles = tiles.join(outside.withColumn("slices", parts(F.col("c"), F.col("t"))).drop("c", "t"), ["region", "home"])
        tiles = small(materialize(tiles, "jaccard-tiles"), MANY_REGIONS)
        inner = balls.where("inside").join(tiles, ["region", "home"]).withColumn("part", part).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        outer = balls.where("NOT inside").withColumn("home", F.explode("near")).join(tiles, ["region", "home"])
        outer = outer.withColumn("slice", F.pmod(F.xxhash64(F.lit(turn), "sid"), F.col("slices")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        done += [x.select(tag("ball", "home", "part", "slice").alias("region"), "sid", "n", "tokens") for x in (inner, outer)]
        rows = materialize(rows.unionByName(balls.where("NOT inside").withColumn("region", tag("rest")).select(*_ROW)), "jaccard-rows")
        turn += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, links, turn > 0


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, region_sets: int = REGION_SETS, region_tokens: int = REGION_TOKENS) -> DataFrame:
    """uid, doc_id, n_shingles, component_id of every row (uid: a number of the row). Whole numbers as ids become longs; any other ordered type stays."""
    spark = docs.sparkSession
    small_batches(spark)
    doc_id = F.col("doc_id").cast("long").alias("doc_id") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.col("doc_id")
    given = docs.select(doc_id, "text")
    scanned = given.mapInArrow(_scan_sets(shingle, HEAVY), f"uid long, doc_id {given.schema['doc_id'].dataType.simpleString()}, hi long, lo long, n long, heavy long")
    scanned = materialize(scanned, "jaccard-sets")
    rows = scanned.where("uid IS NOT NULL").drop("heavy")
    n_rows = rows.count()
    # Each takes HEAVY of all documents, so there are at most (mean set size) / HEAVY, however large the corpus;
    # a token with twice that share can't be missed by the tasks that see less of it.
    often = scanned.where("heavy IS NOT NULL").groupBy("heavy").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, int(HEAVY * n_rows)))
    heavy = np.array([r[0] for r in often.select("heavy").collect()], np.int64).view(np.uint64)
    heavy.sort()
    sets = materialize(rows.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("uid").alias("sid"), F.min("doc_id").alias("low_id")), "jaccard-names", n_rows)
    total = sets.agg(F.sum("n")).first()[0] or 0
    ranges = max(shuffle_partitions(spark), math.ceil(total / RANGE))

    packed = docs.select("text").mapInArrow(_scan_tokens(shingle, heavy, ranges), _RANGE_SCHEMA).repartitionById(ranges, F.col("range"))
    counted = packed.mapInArrow(_count_tokens(ranges), _RANGE_SCHEMA).repartitionById(ranges, F.col("range"))
    maybe = counted.mapInArrow(_prefixes(percent), "hi long, lo long, n long, tokens array<long>, take int")
    maybe = materialize(maybe, "jaccard-maybe").join(sets.select("hi", "lo", "n", "sid"), ["hi", "lo", "n"]).select("sid", "n", "tokens", "take")
    maybe = materialize(maybe, "jaccard-sids")

    stars = materialize(maybe.select("sid", F.slice("tokens", F.lit(1), F.col("take")).alias("prefix")).mapInArrow(_stars, "a long, b long, token long"), "jaccard-stars")
    ones = stars.where("token IS NOT NULL").select("a", "token")
    lows = materialize(ones.groupBy("token").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", "b"), "jaccard-lows")
    stars = stars.where("token IS NULL").select("a", "b").unionByName(ones.join(lows, "token").where("a <> b").select("a", "b"))
    groups = materialize(connected_components(stars, "jaccard-regions"), "jaccard-groups", n_rows)
    regions = maybe.join(groups, F.col("sid") == F.col("node")).select(F.col("root").cast("string").alias("region"), "sid", "n", "tokens", "take")
    regions = materialize(regions, "jaccard-members")
    fitting, links, several = _split_large(regions, percent, region_sets, region_tokens)
    found = fitting.repartition(shuffle_partitions(spark), "region").sortWithinPartitions("region").mapInArrow(_join_regions(percent), "a long, b long")
    if several:
        for x in links:
            found = found.unionByName(x)
        found = connected_components(found, "jaccard-links").where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = materialize(found.select(F.col("a").alias("sid"), F.col("b").alias("root")), "jaccard-roots")
    named = sets.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lowest = materialize(named.groupBy("root").agg(F.min("low_id").alias("component_id")), "jaccard-lowest", n_rows)
    named = materialize(named.join(lowest, "root").select("hi", "lo", "n", "component_id"), "jaccard-named", n_rows)
    out = rows.where("n > 0").join(named, ["hi", "lo", "n"]).select("uid", "doc_id", "n", "component_id")
    out = out.unionByName(rows.where("n = 0").select("uid", "doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.withColumnRenamed("n", "n_shingles")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("uid")
