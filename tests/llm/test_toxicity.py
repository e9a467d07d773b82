import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from detframe.llm import toxicity
from detframe.llm.toxicity import BEGINNINGS, FEATURES, FOLDS, NEAR, SECOND_PERSON, STRONG, Reader, Z, lexicon, op12_toxicity, score, training_texts, words_of

DATA = "/root/testdata/sf0.1"
LABELS = "doc_id long, toxic int, weight double, text string, fold int"


def labels_of(spark, rows):
    return spark.createDataFrame([(i, t, 5.0, "x", 1) for i, t in rows], LABELS)


def test_accuracy_and_calibration_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    found = op12_toxicity(spark, DATA)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.schema["predicted"].dataType.simpleString() == "int"
    rows = found.join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    hit = sum(r.toxic and r.predicted for r in held)
    assert hit >= 0.9 * sum(r.toxic for r in held) and hit >= 0.9 * sum(r.predicted for r in held)
    assert sum((r.score - r.toxic) ** 2 for r in held) / len(held) < 0.03
    assert abs(sum(r.score for r in held) - sum(r.toxic for r in held)) < 0.15 * sum(r.toxic for r in held)


def test_lexicon_equals_counting(spark):
    texts = [(f"{'vile' if i % 3 == 0 else 'kind'} word{i % 5} vilest{i % 2 if i % 3 == 0 else ''} Été", i % FOLDS, int(i % 3 == 0)) for i in range(600)]
    entries, weights = lexicon(spark.createDataFrame(texts, "text string, fold int, toxic int").repartition(3))
    expected = {}
    sets = [({e for w in words_of(t).split() for e in [w[:k] for k in BEGINNINGS if k <= len(w)] + [w + " "]}, f, y) for t, f, y in texts]
    for e in set().union(*(s for s, _, _ in sets)):
        row = []
        for out in (*range(FOLDS), -1):
            n, a = [0, 0], [0, 0]
            for s, f, y in sets:
                n[y] += f != out
                a[y] += f != out and e in s
            bound = math.log((a[1] + 0.5) / (n[1] + 1)) - math.log((a[0] + 0.5) / (n[0] + 1)) - Z * math.sqrt(1 / (a[1] + 0.5) + 1 / (a[0] + 0.5))
            row.append(bound if a[1] >= 3 and bound >= 1 else 0.0)
        if max(row) > 0:
            expected[e] = row
    assert {e: pytest.approx(w) for e, w in zip(entries, weights.T.tolist(), strict=True)} == expected and "vile " in expected
    assert lexicon(spark.createDataFrame(texts, "text string, fold int, toxic int"), entries=2)[0] == sorted(expected, key=lambda e: (-max(expected[e]), e))[:2]


def loop(text, fold, entries, weights):
    """The features by plain steps over words."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    table = dict(zip(entries, weights[fold], strict=True))
    of = lambda w: max((table.get(e, 0.0) for e in [w[:k] for k in BEGINNINGS if k <= len(w)] + [w + " "]), default=0.0)
    w = [of(x) for x in words]
    hits, second = [i for i, x in enumerate(w) if x > 0], [i for i, x in enumerate(words) if x in SECOND_PERSON]
    gaps = [min(abs(i - j) for j in second) for i in hits] if second else []
    n = max(1, len(words))
    return {
        "hit_rate": len(hits) / n, "hits": math.log1p(len(hits)), "hit_words": math.log1p(len({words[i] for i in hits})), "heaviest": max(w, default=0.0), "weight_rate": sum(w) / n, "strong_rate": sum(x >= STRONG for x in w) / n,
        "second_rate": len(second) / n, "second_near": math.log1p(sum(g <= NEAR for g in gaps)), "second_closeness": 1 / (1 + min(gaps)) if gaps else 0.0, "length": math.log1p(n), "variety": len(set(words)) / n,
    }


def test_features_equal_a_loop():
    r = np.random.default_rng(7)
    entries = ["idio", "idiot ", "loser ", "you ", "morons"[:5], "été "]
    weights = r.uniform(0, 4, (FOLDS + 1, len(entries)))
    weights[0, 2] = 0
    vocabulary = ["idiot", "idiots", "Loser", "losers", "you", "your", "DU", "moron", "the", "cat", "été", "x1y", "a", "vous", "dir"]
    for k in range(60):
        text = "".join(r.choice(vocabulary) + r.choice([" ", ", ", "!! ", "\n", "_", "?"]) for _ in range(int(r.integers(0, 60))))
        got = dict(zip(FEATURES, Reader(entries, weights).features(text, k % (FOLDS + 1)), strict=True))
        expected = loop(text, k % (FOLDS + 1), entries, weights)
        assert {name: got[name] for name in expected} == pytest.approx(expected), text


def test_obfuscation_is_seen_and_undone():
    read = lambda t: dict(zip(FEATURES, Reader(["idiot ", "stup"], np.full((FOLDS + 1, 2), 3.0)).features(t, FOLDS), strict=True))
    assert read("you 1d10t, id!ot id*iot i.d.i.o.t s-t-u-p-i-d")["broken_hits"] == pytest.approx(math.log1p(2))  # idiot, stupid
    assert read("an id!ot")["broken"] > 0 and read("i d i o t")["spelled"] > 0 and read("idiooot")["stretched"] > 0
    assert read("thoner$$$ to%%% the&&& plain 12:30 words")["broken_hits"] == 0
    loud = read("STOP IT!!! NOW?!")
    assert loud["capitals"] > 0.9 and loud["capital_words"] == 1 and loud["call_runs"] > 0 and loud["calls"] > 0
    for long in ("a" * 300_000, "a1" * 150_000, "a " * 150_000, "!" * 300_000, "$" * 300_000):
        assert len(read(long)) == len(FEATURES)


def test_training_draw_is_bounded_whatever_one_id_holds(spark):
    docs = spark.createDataFrame([(7, f"hot text {i}") for i in range(3000)] + [(i, "copy") for i in range(100, 1100)] + [(i, f"text {i}") for i in range(2000, 3000)], "doc_id long, text string")
    labels = labels_of(spark, [(7, 1)] * 40 + [(i, 0) for i in range(100, 1100)] + [(i, int(i % 2)) for i in range(2000, 3000)] + [(None, 1), (9, None)])
    t = training_texts(docs, labels, train_docs=200).collect()
    assert len({r.text for r in t}) == len(t) and 100 < sum(r.toxic for r in t) < 320 and sum(not r.toxic for r in t) < 320
    assert sum(r.weight for r in t if not r.toxic) == pytest.approx(501, rel=0.3)
    contradicted = training_texts(docs, labels_of(spark, [(2000, 1), (2000, 0), (2001, 0), (2001, 0), (2001, 1)])).collect()
    assert {r.text: r.toxic for r in contradicted} == {"text 2000": 1, "text 2001": 0}


def test_edges(spark, docs_of, monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 3)
    clean, bad = "the cat says that you are an honest number{}", "the cat says that you are an idiot number{}"
    rows = [(i, (bad if i % 2 else clean).format("abcdefghij"[i % 10] * (1 + i // 10))) for i in range(200)]
    docs = docs_of(rows + [(900, None), (901, ""), (902, "idiot " * 40_000), (903, "12 !? ..."), (None, bad.format("z")), (1, rows[1][1])])
    train = training_texts(docs, labels_of(spark, [(i, i % 2) for i in range(200)]))
    got = score(docs, train, ["doc_id"]).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 206 and all(0 <= r.score <= 1 for r in got)
    assert by[1] > 0.9 and by[None] > 0.9 and by[902] > 0.5 and max(by[2], by[900], by[901], by[903]) < 0.3 and by[900] == by[901]
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    # No labels, one label, no documents.
    nothing = score(docs, training_texts(docs, labels_of(spark, [])), ["doc_id"])
    assert nothing.where("score <> 0").count() == 0 and nothing.count() == 206
    assert score(docs, training_texts(docs, labels_of(spark, [(i, 1) for i in range(200)])), ["doc_id"]).where("score <> 1").count() == 0
    assert score(docs.where(F.lit(False)), train, ["doc_id"]).count() == 0
