"""Language identification with hyperdimensional profiles.

Every letter (and the blank) has a random vector of +1 and -1 that depends on its code point and the seed
alone. A letter trigram is bound as rho(rho(a)) * rho(b) * c, where rho rotates a vector by one place and *
multiplies place by place; a text is the bundle (sum) of the vectors of all its trigrams, a language the
bundle of its training texts, each of length one. A document gets the language whose prototype has the
largest cosine with it. Bundles are exact: a batch counts its distinct trigrams per document and multiplies
the count matrix with the trigram vectors.

Texts are lower-cased; all that is no letter is one blank; trigrams are taken around each letter, so that a
text of one letter has one.

Training reads the `per_language` documents of each language whose hash of id and text is least (all, if there are
fewer), so that one id with many rows neither fills the draw nor empties it, and of at most MAX_LANGUAGES languages:
those with the most documents, equal ones in code-point order. So a column `lang` full of stray values can't grow the
prototypes that every task holds.

Defined results: `und` and 0.0 where the text is null or has no letter, or where nothing could be learned; a
tie goes to the first language in code-point order; a null id is never learned from and not held out;
repeated rows get equal answers; an empty table gives no rows; texts of any length are read to their end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release_memory, small_batches, table, text_pieces, utf8

DIMENSIONS, SEED, PER_LANGUAGE = 1024, 20_011, 2_000
#: Bound of the prototypes, 8 KB each.
MAX_LANGUAGES = 1_000
UNKNOWN = "und"
MARGIN = 4
#: Letters counted at once, and documents.
BLOCK, ROWS = 1 << 20, 256
#: Limits of the pipeline, see plausible: a cosine of unrelated texts has the standard deviation 1 / sqrt(DIMENSIONS).
SHORT, LONG, SIGMAS, MORE_SIGMAS = 50, 2_000, 5, 2
#: A letter belongs to the alphabet of a language if one of so many of its documents has it.
LETTER_SHARE = 0.01


def letter_vectors(code_points, dimensions: int, seed: int) -> np.ndarray:
    return np.stack([np.random.Generator(np.random.PCG64([seed, int(c)])).integers(0, 2, dimensions, np.int8) * 2 - 1 for c in code_points])


def _bundles(column, dimensions: int, seed: int, memory: dict) -> np.ndarray:
    """One bundle a row."""
    import pyarrow.compute as pc

    data, off = utf8(pc.utf8_lower(column))
    n = len(off) - 1
    bundles = np.zeros((n, dimensions), np.float32)
    if not len(data):
        return bundles
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    letters = [c for c in np.flatnonzero(seen).tolist() if chr(c).isalpha()]
    number = np.zeros(len(seen), np.int32)
    number[letters] = np.arange(1, len(letters) + 1)
    # A blank before, between and after the texts; 0 is the blank.
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    padded = np.zeros(len(codes) + n + 1, np.int32)
    padded[np.arange(len(codes)) + row + 1] = number[codes]
    at = np.flatnonzero(number[codes])
    if not len(at):
        return bundles
    row = row[at]
    at = at + row + 1
    for c in (0, *letters):
        if c not in memory:
            memory[c] = letter_vectors([c], dimensions, seed)[0]
    base = np.stack([memory[c] for c in (0, *letters)])
    turned, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    size, start = len(base), 0
    while start < len(at):
        # As many letters as fit the block and at most ROWS rows.
        stop = min(len(at), start + BLOCK, int(np.searchsorted(row, row[start] + ROWS)))
        mid, rows = at[start:stop], row[start:stop] - row[start]
        key = (padded[mid - 1].astype(np.int64) * size + padded[mid]) * size + padded[mid + 1]
        if size**3 <= 1 << 22:
            used = np.flatnonzero(np.bincount(key, minlength=size**3))
            place = np.zeros(size**3, np.int64)
            place[used] = np.arange(len(used))
            key = place[key]
        else:
            used, key = np.unique(key, return_inverse=True)
        height = int(rows[-1]) + 1
        for part in range(0, len(used), 16_384):  # bounds the matrices for large alphabets
            own = used[part : part + 16_384]
            if len(used) > 16_384:
                inside = (key >= part) & (key < part + 16_384)
                k, r = key[inside] - part, rows[inside]
            else:
                k, r = key, rows
            counts = np.bincount(r * len(own) + k, minlength=height * len(own)).reshape(height, len(own))
            vectors = twice[own // (size * size)] * turned[own // size % size] * base[own % size]
            bundles[row[start] : row[start] + height] += counts.astype(np.float32) @ vectors.astype(np.float32)
        start = stop
    return bundles


def _learn(dimensions: int, seed: int):
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        memory: dict = {}
        for batch in batches:
            for piece in text_pieces(batch, 0):
                bundles = _bundles(piece.column(0), dimensions, seed, memory).astype(np.float64)
                norm = np.linalg.norm(bundles, axis=1, keepdims=True)
                bundles /= np.where(norm > 0, norm, 1)
                for lang, v in zip(piece.column(1).to_pylist(), bundles, strict=True):
                    sums[lang] = sums[lang] + v if lang in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "bundle"])

    return run


def prototypes(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Language -> prototype of length one, from text and lang of rows whose `learn` is true."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("learn") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    drawn = _drawn(known, per_language, seed)
    if drawn is None:
        return {}
    rows = drawn.select("text", "lang").repartition(8).mapInArrow(_learn(dimensions, seed), "lang string, bundle array<double>").collect()
    sums: dict[str, np.ndarray] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["bundle"])):
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.array(r["bundle"])
    return {k: v / n for k, v in sums.items() if (n := np.linalg.norm(v)) > 0}


def _predict(languages: list[str], protos: np.ndarray, dimensions: int, seed: int, names: list[str]):
    def run(batches):
        memory: dict = {}
        for batch in batches:
            for piece in text_pieces(batch, len(names)):
                bundles = _bundles(piece.column(len(names)), dimensions, seed, memory)
                norm = np.linalg.norm(bundles, axis=1)
                sims = bundles.astype(np.float64) @ protos.T / np.where(norm > 0, norm, 1)[:, None] if len(languages) else np.zeros((len(norm), 1))
                best = sims.argmax(axis=1)
                known = (norm > 0) & bool(languages)
                lang = [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(sims[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(names)], pa.array(lang), pa.array(score)], [*names, "lang_pred", "score"])
        release_memory()

    return run


def identify(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str], dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """The columns `keep` with lang_pred and score, from the column text alone."""
    small_batches(docs.sparkSession)
    languages = sorted(model)
    protos = np.stack([model[k] for k in languages]) if languages else np.zeros((0, dimensions))
    # The text goes last; it may be one of the columns to keep, too.
    given = docs.select(*keep, F.col("text").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(_predict(languages, protos, dimensions, seed, keep), f"{kinds}, lang_pred string, score double")


def _drawn(known: DataFrame, per_language: int, seed: int, languages: int | None = None) -> DataFrame | None:
    """The per_language rows with the least hash of each of the most frequent languages; None if there is none.

    Rows beyond MARGIN times the wanted share go before anything is shuffled. Where that leaves a language short (equal
    rows share a hash, so few texts may hold most rows), it is drawn without that limit.
    """
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages or MAX_LANGUAGES).collect()}
    if not counts:
        return None
    by_language = lambda values: F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id", "text"))

    def least(limits: dict) -> DataFrame:
        rows = known.select("doc_id", "text", "lang", (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)).alias("at")).where(F.col("at") < by_language(limits))
        return materialize(rows.withColumn("rank", rank).where(F.col("rank") <= per_language).select("text", "lang"), "language-drawn")

    drawn = least({k: min(1.0, MARGIN * per_language / n) for k, n in counts.items()})
    got = {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()}
    short = {k: 1.0 for k, n in counts.items() if got.get(k, 0) < min(n, per_language)}
    return drawn.where(~F.col("lang").isin(*short)).unionByName(least(short)) if short else drawn


def alphabet(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = SEED) -> str:
    """The letters of the labelled languages, from the documents that prototypes reads."""
    drawn = _drawn(docs.where(F.col("learn") & F.col("text").isNotNull() & F.col("lang").isNotNull()), per_language, seed)
    if drawn is None:
        return ""
    each = drawn.select("lang", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"\P{L}+", ""), ""))).alias("c")).where("c <> ''")
    total = {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()}
    least = F.create_map(*[x for k, n in total.items() for x in (F.lit(k), F.lit(LETTER_SHARE * n))]) if total else F.lit(None)
    # At most 1 / LETTER_SHARE times the letters of a document, for each language.
    common = each.groupBy("lang", "c").count().where(F.col("count") >= F.element_at(least, F.col("lang"))) if total else each.limit(0)
    return "".join(sorted({r["c"] for r in common.select("c").distinct().collect()}))


def plausible(letters: str, dimensions: int = DIMENSIONS):
    """Whether text and score of identify show one of the languages, beyond chance.

    What counts is m, the letters of a text's distinct words: repeats bring no evidence. The cosine must reach
    SIGMAS standard deviations of unrelated texts, and up to MORE_SIGMAS more as m grows to LONG, since random
    strings in the same letters meet more trigrams of a language the longer they are. Below SHORT letters the
    cosine of a clean text may lie in the noise: there, more than half of the letters must be of the alphabet.
    """
    low = F.lower("text")
    count = lambda c: F.length(F.regexp_replace(c, r"\P{L}+", ""))
    m = F.length(F.array_join(F.array_distinct(F.split(low, r"\P{L}+")), ""))
    sure = (SIGMAS + MORE_SIGMAS) / dimensions**0.5
    limit = (SIGMAS + MORE_SIGMAS * F.least(F.lit(1.0), m / LONG)) / dimensions**0.5
    foreign = count(F.regexp_replace(low, f"[{letters}]+", "")) if letters else count(low)
    # Most texts pass the first test, so that the others are rarely worked out.
    return (F.col("score") >= sure) | F.when(m < SHORT, 2 * foreign < count(low)).otherwise(F.col("score") >= limit)


def with_folds(docs: DataFrame) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return docs.withColumn("held_out", F.coalesce(fold, F.lit(False))).withColumn("learn", F.coalesce(~fold, F.lit(False)))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = with_folds(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return identify(docs, prototypes(docs), ["doc_id", "held_out"])
