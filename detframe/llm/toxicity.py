"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned from labelled texts. Its entries are beginnings of words (4 to 8 letters) and whole words; an
entry's weight is a lower bound of the log ratio of its document rates in toxic and other texts, log(r1 / r0) less Z
standard errors. A word weighs what the heaviest of its entries does. Texts are lower-cased and cut into words of
letters; an automaton finds all entries in one pass over a whole text. Words broken up by signs or digits, and
letters spelled out one by one, are put together again and looked up, too.

FEATURES: densities and sums of hits, distinct hit words, the heaviest; second-person words and how near they stand to
hits; capitals, punctuation, digits; broken, spelled-out and stretched words; length and variety.

Training texts fall into FOLDS parts by a hash; the features of a training text are taken with weights counted without
its own part, so no label is seen through its own counts. Two tree models, each of half of the parts, give the other
half's margins, on which the isotonic regression is fitted; a third, of all parts, scores. The score of a document is
its calibrated value, but for a millionth that keeps the order of margins.

The training draw is bounded: of each label about `train_docs` distinct texts, by a hash, one of each group of copies.
Weights make up for the draw. All documents are scored, whole, from their text alone.

Defined results: null text is empty; without training texts of both labels in both halves every score is the rate of
toxic texts, 0 if there are none; a doc_id that several label rows contradict is toxic if most say so, ties are
toxic; null ids and null labels are never learned from; repeated rows get equal answers; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory, small_batches, table, text_pieces
from .language_id import with_folds

TRAIN_DOCS, FOLDS, SEED = 8_000, 4, 29
#: Lengths of beginnings, the longest whole word, the least toxic texts and weight of an entry, its standard errors, and entries at most.
BEGINNINGS, LONGEST, LEAST_TEXTS, LEAST_WEIGHT, Z, ENTRIES = range(4, 9), 32, 3, 1.0, 2.5, 20_000
TREES, DEPTH, STEP = 20, 3, 0.3
LIMIT, NEAR = 0.3, 5
FEATURES = (
    "hit_rate", "hits", "hit_words", "heaviest", "weight_rate", "weight", "strong_rate", "second_rate", "second_near", "second_closeness", "capitals", "capital_words",
    "calls", "call_runs", "punctuation", "digits", "broken", "broken_hits", "spelled", "stretched", "length", "variety",
)
STRONG = 2.0
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch euer ihr tu toi te ton ta tes vous votre vos tú ti te tu tus usted ustedes vosotros os".split())
# Possessive, so that long runs are read once.
_BROKEN = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!*|+#%&]{1,3}+[^\W\d_]++)+")
_SPELLED = re.compile(r"(?<![^\W\d_])[^\W\d_]([ .\-_*])[^\W\d_](?![^\W\d_])(?:\1[^\W\d_](?![^\W\d_]))++")
_CALL_RUN = re.compile(r"[!?]{2,}+")
_NO_LETTER = re.compile(r"[\W\d_]")
_LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
_BYTES = np.arange(256)
_CAPITAL, _DIGIT = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = _CAPITAL | (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128)
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~_DIGIT
#: ASCII that is no letter becomes a blank.
_BLANKS = bytes(b if _LETTER[b] else 32 for b in range(256))
_BREAKS = b"0123456789@$!*|+#%&"


def words_of(text: str) -> str:
    """The words of letters, lower-cased, each between blanks."""
    low = text.lower()
    if not low.isascii():
        for c in set(low):
            if not (c.isascii() or c.isalpha()):
                low = low.replace(c, " ")
    return f" {b' '.join(low.encode('utf-8', 'replace').translate(_BLANKS).split()).decode()} "


def entries_of(word: str) -> list[str]:
    """A word's possible entries; whole words end in a blank."""
    return [word[:k] for k in BEGINNINGS if k <= len(word)] + ([word + " "] if len(word) <= LONGEST else [])


def _count(batches):
    """Rows (entry, fold, toxic, n): in how many texts an entry stands."""
    for batch in batches:
        for piece in text_pieces(batch, 0):
            counts: dict[tuple, int] = {}
            for text, fold, toxic in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                for entry in {e for w in set(words_of(text).split()) for e in entries_of(w)}:
                    key = (entry, fold, toxic)
                    counts[key] = counts.get(key, 0) + 1
            if counts:
                entry, fold, toxic = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(fold, pa.int32()), pa.array(toxic, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["entry", "fold", "toxic", "n"])
    release_memory()


def lexicon(train: DataFrame, entries: int = ENTRIES) -> tuple[list[str], np.ndarray]:
    """Entries and their weights: a row for each fold left out, and the last one of all. train: text, fold, toxic."""
    size = {(r["fold"], r["toxic"]): r["count"] for r in train.groupBy("fold", "toxic").count().collect()}
    counts = train.select("text", "fold", "toxic").mapInArrow(_count, "entry string, fold int, toxic int, n long")
    cell = lambda f, t: F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n"))), F.lit(0)).alias(f"n{f}_{t}")
    wide = counts.groupBy("entry").agg(*[cell(f, t) for f in range(FOLDS) for t in (0, 1)])

    def weight(out: int):
        sums = [sum((F.col(f"n{f}_{t}") for f in range(FOLDS) if f != out), F.lit(0)) for t in (0, 1)]
        texts = [sum(size.get((f, t), 0) for f in range(FOLDS) if f != out) for t in (0, 1)]
        bound = F.log((sums[1] + 0.5) / (texts[1] + 1)) - F.log((sums[0] + 0.5) / (texts[0] + 1)) - Z * F.sqrt(1 / (sums[1] + 0.5) + 1 / (sums[0] + 0.5))
        return F.when((sums[1] >= LEAST_TEXTS) & (bound >= LEAST_WEIGHT), bound).otherwise(0.0)

    weights = F.array(*[weight(f) for f in (*range(FOLDS), -1)])
    best = wide.select("entry", weights.alias("w")).withColumn("top", F.array_max("w")).where("top > 0").orderBy(F.desc("top"), "entry").limit(entries).collect()
    return [r["entry"] for r in best], np.array([r["w"] for r in best]).reshape(len(best), FOLDS + 1).T


class Reader:
    """Features of texts by a lexicon."""

    def __init__(self, entries: list[str], weights: np.ndarray):
        import ahocorasick

        self.number, self.weights = {e: i for i, e in enumerate(entries)}, weights
        self.automaton = ahocorasick.Automaton()
        for e, i in self.number.items():
            self.automaton.add_word(" " + e, (len(e), i))
        for w in SECOND_PERSON:
            if w + " " not in self.number:
                self.automaton.add_word(f" {w} ", (len(w) + 1, -1))
        self.automaton.make_automaton()

    def weight(self, word: str, weights: np.ndarray) -> float:
        return max((float(weights[i]) for e in entries_of(word) if (i := self.number.get(e)) is not None), default=0.0)

    def hits(self, words: str, weights: np.ndarray) -> tuple[dict[int, float], list[int]]:
        """Weight by the place of a hit word's blank; places of second-person words."""
        found: dict[int, float] = {}
        second = []
        for end, (length, i) in self.automaton.iter(words):
            at = end - length
            if i >= 0 and weights[i] > 0:
                found[at] = max(found.get(at, 0.0), float(weights[i]))
            if i < 0 or (words[end] == " " and words[at + 1 : end] in SECOND_PERSON):
                second.append(at)
        return found, second

    def features(self, text: str, fold: int) -> list[float]:
        weights, words = self.weights[fold], words_of(text)
        codes = np.frombuffer(words.encode("utf-32-le"), "<u4")
        blanks = np.flatnonzero(codes == 32)
        lengths = np.diff(blanks) - 1
        lengths = lengths[lengths > 0]
        n, letters = max(1, len(lengths)), max(1, int(lengths.sum()))
        distinct = set(words.split())
        # Places are wanted only where one of the distinct words is of the lexicon or in the second person.
        any_hit = next(self.automaton.iter(f" {' '.join(distinct)} "), None) is not None
        found, second = self.hits(words, weights) if any_hit else ({}, [])
        near = closest = 0.0
        if second and found:
            spots, hits = (np.searchsorted(blanks, sorted(x)) for x in (set(second), found))
            right = np.searchsorted(spots, hits)
            gap = np.minimum(np.abs(spots[np.minimum(right, len(spots) - 1)] - hits), np.abs(spots[np.maximum(right - 1, 0)] - hits))
            near, closest = float((gap <= NEAR).sum()), 1.0 / (1.0 + float(gap.min()))
        sums, strong = sum(found.values()), sum(w >= STRONG for w in found.values())
        hit_words = len({words[a + 1 : words.index(" ", a + 1)] for a in found})

        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        counts = np.bincount(raw, minlength=256)
        chars, calls = max(1, len(text)), int(counts[33] + counts[63])
        capitals = int(counts[_CAPITAL].sum())
        broken = _BROKEN.findall(text) if counts[[*_BREAKS]].any() else []
        single = lengths == 1
        spelled = [m.group() for m in _SPELLED.finditer(text)] if (single[2:] & single[1:-1] & single[:-2]).any() else []
        whole = {_NO_LETTER.sub("", w).lower() for b in broken for w in (b, b.translate(_LOOKALIKE))} | {_NO_LETTER.sub("", s).lower() for s in spelled}
        broken_hits = sum(self.weight(w, weights) > 0 for w in whole)
        thrice = (codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]) & (codes[2:] != 32)
        stretched = int(thrice.sum() - (thrice[1:] & thrice[:-1]).sum())
        return [
            len(found) / n, np.log1p(len(found)), np.log1p(hit_words), max(found.values(), default=0.0), sums / n, np.log1p(sums), strong / n, len(second) / n, np.log1p(near), closest, capitals / letters, capital_words(raw) / n if capitals > 1 else 0.0,
            calls / chars, len(_CALL_RUN.findall(text)) / n if calls > 1 else 0.0, (int(counts[_MARK].sum()) - calls) / chars, int(counts[_DIGIT].sum()) / chars, len(broken) / n, np.log1p(broken_hits), len(spelled) / n, stretched / n, np.log1p(n), len(distinct) / n,
        ]


def capital_words(raw: np.ndarray) -> int:
    """Words of two letters A-Z or more and nothing else."""
    inside = np.concatenate(([False], (_LETTER | _DIGIT)[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    capitals = np.concatenate(([0], np.cumsum(_CAPITAL[raw])))
    return int(((end - start > 1) & (capitals[end] - capitals[start] == end - start)).sum())


def _read(model, names: list[str]):
    """model: a broadcast lexicon. Columns: text, fold, then those to keep."""

    def run(batches):
        reader = Reader(*model.value)
        for batch in batches:
            for piece in text_pieces(batch, 0):
                rows = [reader.features(t or "", f) for t, f in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)]
                flat = pa.array(np.array(rows, np.float64).ravel())
                features = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), flat)
                yield pa.RecordBatch.from_arrays([*piece.columns[2:], features], [*names, "features"])
        release_memory()

    return run


def with_features(docs: DataFrame, model, keep: list[str], fold=None) -> DataFrame:
    """The columns `keep` and features (a vector) of text; fold: the part whose counts are left out, none by default."""
    from pyspark.ml.functions import array_to_vector

    small_batches(docs.sparkSession)
    given = docs.select("text", (F.lit(FOLDS) if fold is None else F.col(fold)).cast("int").alias("__fold"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[2:])
    return given.mapInArrow(_read(model, keep), f"{kinds}, features array<double>").withColumn("features", array_to_vector("features"))


def training_texts(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """text, toxic, weight, fold of about train_docs distinct texts a label. docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    known = materialize(known, "toxic-labels")
    part = lambda *c: F.pmod(F.xxhash64(F.lit(SEED), *c), F.lit(1_000_000)) / 1e6
    share = lambda counts: {t: min(1.0, train_docs / max(1, counts.get(t, 0))) for t in (0, 1)}
    chance = lambda s: F.when(F.col("toxic") == 1, s[1]).otherwise(s[0])
    first = share({r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()})
    # About 2 train_docs ids, whatever the labels' size; each may name many rows, so texts are drawn once more.
    drawn = F.broadcast(known.where(part("doc_id") < chance(first)))
    texts = docs.join(drawn, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic").distinct()
    texts = materialize(texts, "toxic-drawn")
    second = share({r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()})
    texts = texts.where(part("text") < chance(second))
    weight = chance({t: 1 / (first[t] * second[t]) for t in (0, 1)})
    return texts.select("text", "toxic", weight.cast("double").alias("weight"), F.pmod(F.xxhash64(F.lit(SEED + 1), "text"), F.lit(FOLDS)).cast("int").alias("fold"))


def _margin(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("margin", F.get(vector_to_array("rawPrediction"), F.lit(1))).drop("rawPrediction", "probability", "prediction")


def score(docs: DataFrame, train: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with score, from its column text; train as training_texts gives it."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import IsotonicRegression

    spark = docs.sparkSession
    small_batches(spark)
    train = materialize(train, "toxic-train")
    seen = {(r["half"], r["toxic"]): r["weight"] for r in train.groupBy((F.col("fold") % 2).alias("half"), "toxic").agg(F.sum("weight").alias("weight")).collect()}
    if len(seen) < 4:
        total = sum(seen.values())
        return docs.select(*keep, F.lit(sum(w for (_, t), w in seen.items() if t) / total if total else 0.0).alias("score"))
    model = spark.sparkContext.broadcast(lexicon(train))
    rows = materialize(with_features(train, model, ["toxic", "weight", "fold"], "fold").withColumn("label", F.col("toxic").cast("double")).repartition(4), "toxic-features")
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, checkpointInterval=-1)
    half = F.col("fold") % 2
    margins = None
    for h in (0, 1):
        part = _margin(trees.fit(rows.where(half != h)), rows.where(half == h)).select("margin", "label", "weight")
        margins = part if margins is None else margins.unionByName(part)
    margins = materialize(margins, "toxic-margins")
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(margins)
    found = curve.transform(_margin(trees.fit(rows), with_features(docs, model, keep)))
    smooth = 1e-6
    value = (1 - smooth) * F.col("calibrated") + smooth / (1 + F.exp(-2 * F.col("margin")))
    return found.select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("score"))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = with_folds(table(spark, sf_dir, "documents").select("doc_id", "text"))
    train = training_texts(docs.where("learn"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, train, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
