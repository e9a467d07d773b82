"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

The base finds e-mail addresses, IP addresses, card and phone numbers by fixed patterns with checks. The field
then labels the document's units: base spans, numbers that no base span covers (pieces of matches that failed
because two numbers stand next to each other, numbers broken by a line end, plain digit groups), and words
equal to the local part of a found address. Units are nodes in text order with three kinds of potentials:
- node: weights of the unit's surface (digits, length, marks, checks passed or failed) for each label;
- chain: between neighbours, a weight for each pair of labels;
- skip: between distant units that repeat each other (same digits, or same letters without case) or are
  similar (same last nine digits), a weight of equal labels.
All weights are fitted together by pseudo-likelihood: each unit's label given its surface and the labels of all
units that an edge ties it to, over the base labels of a bounded sample (`train_docs` documents at most, drawn by
a hash of the row's number). Open units that bear a kind's own marks (below) or are tied to a base span teach
nothing: whether the base missed them is what the field is to say. Ties that no pair of base spans contradicts
keep their prior weight.

Base spans are clamped. Loopy sum-product message passing runs over chain and skip edges in every document with
an open unit, until messages settle, for as many rounds as there are units at most (or ROUNDS, if there are
fewer). An open unit becomes a span if its marginal for one kind reaches `certain`, and either it bears that
kind's own marks (a phone's + and 9 to 15 digits, a card's 13 to 19 digits and check, an address of four numbers)
or skip edges tie it to a base span of that kind. Skip edges tie each unit to the previous one with its key, and
open units also to the nearest base span with it, the last before or else the first after: a key that fills a
document costs two edges a unit, and no repeat is far from the evidence.

The patterns are matched in time proportional to the text, whatever it holds; see base_spans. Credentials
(`password=...`) are counted apart, by a pattern; they are of none of the four kinds and in no span.

Defined results: a null text is empty: no spans, the digest of an empty string; a null id is a row like any
other; repeated rows get equal answers; of two equally likely kinds the first listed counts; an empty table gives
no rows and trains nothing; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, text_pieces

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, CERTAIN, ROUNDS = 20_000, 0.9, 100
#: Steps and size of the fit, pull of the weights to zero, and the most that a tie says (a hundred to one).
STEPS, RATE, PULL, TIE = 400, 1.0, 1e-4, float(np.log(100))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Numbers that no base span covers, the first that fits: a phone of two to four groups, a card, any digit group.
_OPEN = re.compile(r"\+[0-9]{1,3}(?:[\s.-]{0,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])|(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])|(?<![0-9])[0-9](?:[().-]{0,2}[0-9]){5,}")
_SECRET = re.compile(r"(?i)\b(?:password|passwd|secret|token|api[_-]?key)\s{0,3}[:=]\s{0,3}[\"']?[^\s\"']{8,}")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_HAS_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost non-overlapping matches of each kind's pattern.

    Equal to the patterns' own matches, but linear: an address is sought from each @ backwards, and a chain
    of dotted numbers is cut into groups of four from its left.
    """
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        end = m.end() if m else at + 1
        at = text.find("@", end)
    if not _HAS_DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in four):
                    out.append(("ip", at, at + size))
                at += size + 1
    for m in _CARD.finditer(text):
        d = _NO_DIGIT.sub("", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def units(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) in text order; label 0 is open, k is KINDS[k - 1]. Overlapping base spans: the first stands."""
    found, end = [], -1
    for kind, s, e in sorted(base, key=lambda x: (x[1], -x[2])):
        if s >= end:
            found.append((s, e, 1 + KINDS.index(kind)))
            end = e
    if not found and not _HAS_DIGIT.search(text):
        return []
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken])

    def free(s, e):
        i = int(np.searchsorted(starts, e))
        return i == 0 or reach[i - 1] <= s

    at = 0
    while m := _OPEN.search(text, at):
        ok = free(m.start(), m.end())
        found += [(m.start(), m.end(), 0)] if ok else []
        at = m.end() if ok else m.start() + 1  # a match that runs into a base span may hide another
        while not ok and at < m.end() and text[at].isdigit():
            at += 1
    names = {text[s:e].split("@")[0].lower() for k, s, e in base if k == "email"}
    names = {n for n in names if len(n) >= 4 and not n.isdigit()}
    if names:
        found += [(m.start(), m.end(), 0) for m in _LOCAL.finditer(text) if m[0].lower().strip(".") in names and free(m.start(), m.end())]
    found.sort()
    kept, end = [], -1
    for u in found:
        if u[0] >= end:
            kept.append(u)
            end = u[1]
    return kept


def surface(s: str) -> tuple[int, ...]:
    """Digits, length bucket, and flags: letters, a leading +, brackets, a line end, four numbers up to 255, four others, Luhn passed, failed."""
    d = _NO_DIGIT.sub("", s)
    four = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s) is not None
    fits = four and all(int(p[-4:]) <= 255 for p in s.split("."))
    card = 13 <= len(d) <= 19 and re.fullmatch(r"[0-9\x20-]+", s) is not None
    passed = card and luhn(d)
    return (min(len(d), 20), min(len(s) // 4, 8), *map(int, (any(c.isalpha() for c in s), s[:1] == "+", "(" in s, "\n" in s, fits, four and not fits, passed, card and not passed)))


def marks(s: str) -> int:
    """The label whose own marks a string bears, 0 if none."""
    x = surface(s)
    return 4 if x[3] and 9 <= x[0] <= 15 and not x[2] else 3 if x[8] else 2 if x[6] else 0


def keys(s: str, label: int) -> list[str]:
    """What repeats or similar units have in common."""
    if label == 1 or any(c.isalpha() for c in s):
        return ["=" + s.split("@")[0].lower().strip(".")]
    d = _NO_DIGIT.sub("", s)
    return ["=" + d, "~" + d[-9:]] if len(d) >= 9 else ["=" + d] if len(d) >= 6 else []


def edges(us, text: str) -> list[tuple[int, int, int]]:
    """(i, j, kind): kind 0 chain, 1 repeated, 2 similar."""
    out = [(i, i + 1, 0) for i in range(len(us) - 1)]
    named = [keys(text[s:e], label) for s, e, label in us]
    first: dict[str, int] = {}
    for i, (_, _, label) in enumerate(us):
        for k in named[i] if label else ():
            first.setdefault(k, i)
    last: dict[str, int] = {}
    base: dict[str, int] = {}
    for i, (_, _, label) in enumerate(us):
        tied = set()
        for k in named[i]:
            for j in (last.get(k), None if label else base.get(k, first.get(k))):
                if j is not None and j not in tied:
                    tied.add(j)
                    out.append((min(i, j), max(i, j), 1 if k[0] == "=" else 2))
            last[k] = i
            if label:
                base[k] = i
    return out


_SURFACE = 10
NONE = -1


def around(i: int, us, es_of) -> tuple[int, ...]:
    """Labels of the unit before and after (NONE at the ends), and of tied units: repeats and similar ones that have and lack each label."""
    near, tied = [NONE, NONE], np.zeros((2, len(KINDS) + 1), int)
    for j, kind in es_of[i]:
        if kind:
            tied[kind - 1, us[j][2]] += 1
        else:
            near[j > i] = us[j][2]
    return (*near, *np.minimum(tied, 3).ravel().tolist())


def count_statistics(batches):
    """Counts of (surface, labels around, label) of units."""
    seen: Counter = Counter()
    for batch in batches:
        for piece in text_pieces(batch, 0):
            for text in piece.column(0).to_pylist():
                us = units(text, base_spans(text)) if text else []
                ties = defaultdict(list)
                for i, j, kind in edges(us, text):
                    ties[i].append((j, kind))
                    ties[j].append((i, kind))
                for i, (s, e, label) in enumerate(us):
                    if not label and (marks(text[s:e]) or any(kind and us[j][2] for j, kind in ties[i])):
                        continue  # the base's silence says nothing about it
                    seen[(*surface(text[s:e]), *around(i, us, ties), label)] += 1
    if seen:
        ks = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in ks], pa.list_(pa.int64())), pa.array(list(seen.values()))], ["key", "n"])


def _features(x) -> np.ndarray:
    v = np.zeros(21 + 9 + 1 + 8)
    v[x[0]] = v[21 + x[1]] = v[30] = 1
    v[31:] = x[2:_SURFACE]
    return v


def fit(rows) -> dict:
    """Node, chain and skip weights together, by pseudo-likelihood; rows: (key, n) of count_statistics."""
    n = len(KINDS) + 1
    model = {"node": np.zeros((39, n)), "chain": np.zeros((n, n)), "tie": {1: TIE, 2: TIE / 2}}
    rows = sorted((tuple(k), c) for k, c in rows)
    if not rows:
        return model
    x = np.array([_features(k) for k, _ in rows])
    one = lambda at: np.array([np.eye(n)[k[at]] if k[at] != NONE else np.zeros(n) for k, _ in rows])
    before, after = one(_SURFACE), one(_SURFACE + 1)
    tied = [np.array([k[_SURFACE + 2 + i * n : _SURFACE + 2 + (i + 1) * n] for k, _ in rows], float) for i in (0, 1)]
    y = np.eye(n)[[k[-1] for k, _ in rows]]
    w = np.array([c for _, c in rows], float)[:, None]
    w /= w.sum()
    node, chain, tie = model["node"], model["chain"], np.array([TIE, TIE / 2])
    for _ in range(STEPS):
        z = x @ node + before @ chain + after @ chain.T + tie[0] * tied[0] + tie[1] * tied[1]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = w * (p - y)
        node -= RATE * (x.T @ d + PULL * node)
        chain -= RATE * (before.T @ d + (after.T @ d).T + PULL * chain)
        tie = np.clip(tie - RATE * np.array([(d * t).sum() for t in tied]), 0, TIE)
    model["tie"] = {1: float(tie[0]), 2: float(tie[1])}
    return model


def marginals(us, text: str, es, model: dict, rounds: int | None = None) -> np.ndarray:
    """Loopy sum-product over chain and skip edges, in logs, all messages at once; base spans are clamped."""
    n = len(KINDS) + 1
    node = np.array([_features(surface(text[s:e])) for s, e, _ in us]) @ model["node"]
    node -= np.logaddexp.reduce(node, 1)[:, None]
    for i, (_, _, label) in enumerate(us):
        if label:
            node[i] = -1e8  # beyond all that messages can say
            node[i, label] = 0.0
    belief = node.copy()
    if es:
        pot = [model["chain"], np.eye(n) * model["tie"][1], np.eye(n) * model["tie"][2]]
        src = np.array([e[0] for e in es] + [e[1] for e in es])
        dst = np.array([e[1] for e in es] + [e[0] for e in es])
        table_ = np.stack([pot[e[2]] for e in es] + [pot[e[2]].T for e in es])
        back = np.concatenate([np.arange(len(es)) + len(es), np.arange(len(es))])
        msg = np.zeros((len(src), n))
        for _ in range(max(ROUNDS, len(us)) if rounds is None else rounds):
            out = belief[src] - msg[back]
            new = np.logaddexp.reduce(out[:, :, None] + table_, axis=1)
            new -= np.logaddexp.reduce(new, 1)[:, None]
            done = np.abs(new - msg).max() < 1e-5
            msg = 0.5 * msg + 0.5 * new  # damped: loops settle
            belief = node.copy()
            np.add.at(belief, dst, msg)
            if done:
                break
    return np.exp(belief - np.logaddexp.reduce(belief, 1)[:, None])


def added_spans(text: str, base, model: dict, certain: float = CERTAIN) -> list[tuple[str, int, int]]:
    us = units(text, base)
    es = edges(us, text)
    group = list(range(len(us)))

    def top(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, j, kind in es:
        if kind:
            group[top(j)] = top(i)
    tied = defaultdict(set)
    for i, (_, _, label) in enumerate(us):
        if label:
            tied[top(i)].add(label)
    if all(label for _, _, label in us):
        return []
    p = marginals(us, text, es, model)
    out = []
    for i, (s, e, label) in enumerate(us):
        k = int(p[i].argmax())
        if not label and k and p[i, k] >= certain and (marks(text[s:e]) == k or k in tied.get(top(i), ())):
            out.append((KINDS[k - 1], s, e))
    return out


def _line(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def _find(model: dict, certain: float):
    def run(batches):
        for batch in batches:
            for piece in text_pieces(batch, 1):
                counts, digests, lines = [], [], []
                for text in piece.column(1).to_pylist():
                    base = base_spans(text) if text else []
                    more = added_spans(text, base, model, certain) if text else []
                    secrets = sum(1 for _ in _SECRET.finditer(text)) if text else 0
                    counts.append([*(sum(k == kind for k, _, _ in base) for kind in KINDS), len(base) + len(more), len(more), secrets])
                    digests.append(hashlib.sha256(_line(base).encode()).hexdigest())
                    lines.append(_line(base + more))
                counts = np.array(counts, np.int64)
                columns = [pa.array(counts[:, i]) for i in range(len(KINDS) + 3)]
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns[: len(KINDS)], pa.array(digests), pa.array(lines), *columns[len(KINDS) :]], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added", "n_secrets"])

    return run


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """The model from at most train_docs rows: those with the smallest hashes of their text and row number."""
    small_batches(docs.sparkSession)
    draw = F.xxhash64(F.lit("pii"), "text", F.monotonically_increasing_id())
    share = min(1.0, 2 * train_docs / max(1, docs.count()))
    drawn = docs.select("text").where("text IS NOT NULL").withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 30)) <= int(share * (1 << 30)))
    drawn = drawn.withColumn("place", F.pmod("draw", F.lit(1 << 30))).orderBy("place", "draw").limit(train_docs).repartition(8)
    stats = drawn.select("text").mapInArrow(count_statistics, "key array<long>, n long")
    # At most the units of train_docs documents, counted by what a unit shows.
    return fit([(r["key"], r["n"]) for r in stats.groupBy("key").agg(F.sum("n").alias("n")).collect()])


def find_pii(docs: DataFrame, model: dict | None = None, certain: float = CERTAIN) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row; then n_spans (all), n_added (by the field), n_secrets."""
    small_batches(docs.sparkSession)
    model = model or train(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_find(model, certain), f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_spans long, n_added long, n_secrets long")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
