import numpy as np
import pyarrow as pa

from detframe.llm.language_id import DIMENSIONS, SEED, _bundles, _drawn, identify, letter_vectors, op2_language_id, prototypes, with_folds

from ..conftest import DATA


def bundle_loop(text, d=64):
    v = {}
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + t + " "
    out = np.zeros(d)
    for i in range(1, len(t) - 1):
        if t[i] != " ":
            for c in t[i - 1 : i + 2]:
                v.setdefault(c, letter_vectors([0 if c == " " else ord(c)], d, 1)[0].astype(int))
            out += np.roll(v[t[i - 1]], 2) * np.roll(v[t[i]], 1) * v[t[i + 1]]
    return out


def test_bundles_equal_a_loop():
    rows = ["Hello, World", "", None, "x", "é1à b", "... 12", "日本語テスト", "a" * 5000]
    got = _bundles(pa.array(rows), 64, 1, {})
    assert np.array_equal(got, np.stack([bundle_loop(t or "", 64) for t in rows]).astype(np.float32))


def test_prediction_equals_a_loop_and_ties_go_to_the_first(spark, docs_of):
    texts = {"de": "der hund und die katze", "en": "the dog and the cat", "xx": "the dog and the cat"}
    protos = {k: (v := bundle_loop(t)) / np.linalg.norm(v) for k, t in texts.items()}
    rows = [(1, "the dog"), (2, "die katze und"), (3, "a" * 3000 + " hund"), (4, "the dog and the cat")]
    model = {k: np.array(protos[k]) for k in reversed(sorted(protos))}
    seeded = {r.doc_id: r for r in identify(docs_of(rows), model, ["doc_id"], 64, 1).collect()}
    for i, t in rows:
        v = bundle_loop(t)
        cosine = {k: float(v @ p / np.linalg.norm(v)) for k, p in protos.items()}
        best = min(protos, key=lambda k: (-round(cosine[k], 9), k))
        assert seeded[i].lang_pred == best != "xx" and abs(seeded[i].score - min(max(cosine[best], 0), 1)) < 1e-6


def test_learned_languages_are_bounded(spark, monkeypatch):
    from detframe.llm import language_id

    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    rows = [(i, "some words of text", lang) for i, lang in enumerate(["b"] * 9 + ["c"] * 8 + ["a"] * 2 + ["d"] * 2 + [f"stray{j}" for j in range(40)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "true AS learn")
    assert sorted(prototypes(docs)) == ["a", "b", "c"]
    assert language_id.alphabet(docs) == "".join(sorted(set("somewordsoftext")))


def test_one_hot_id_neither_fills_nor_empties_the_draw(spark):
    """A language whose rows all have one id, one whose rows are all equal, and a plain one."""
    hot = [(7, f"zażółć gęślą jaźń {i}", "pl") for i in range(4000)]
    equal = [(8, "le chat et le chien", "fr")] * 3000
    plain = [(100 + i, f"the dog and the cat number {i}", "en") for i in range(500)]
    docs = spark.createDataFrame(hot + equal + plain, "doc_id long, text string, lang string").selectExpr("*", "true AS learn")
    for seed in range(3):
        drawn = _drawn(docs.where("learn"), 200, seed)
        assert {r.lang: r["count"] for r in drawn.groupBy("lang").count().collect()} == {"pl": 200, "fr": 200, "en": 200}
        keyed = {x: sorted(r.text for r in drawn.where(f"lang = '{x}'").collect()) for x in ("pl", "en")}
        least = lambda x: docs.where(f"lang = '{x}'").selectExpr("text", f"pmod(xxhash64({seed}, doc_id, text), 1073741824) AS h").orderBy("h").limit(200)
        assert all(keyed[x] == sorted(r.text for r in least(x).collect()) for x in keyed)
    model = prototypes(docs, 200)
    found = identify(docs, model, ["doc_id", "lang"])
    assert sorted(model) == ["en", "fr", "pl"] and found.where("lang <> lang_pred").count() == 0
    assert _drawn(docs.limit(0), 200, 1) is None


def test_accuracy_on_held_out(spark):
    r = op2_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert r.count() > 20 and r.where("lang = lang_pred").count() / r.count() > 0.97


def test_edges(spark, docs_of):
    d = docs_of([(1, "the cat and the dog"), (2, None), (3, "12 ..!"), (4, ""), (None, "the cat"), (1, "the cat and the dog")])
    learn = with_folds(d)
    got = identify(learn, prototypes(learn), ["doc_id", "held_out"]).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == "und" and by[2].score == 0
    assert by[1].lang_pred in ("en", "und") and 0 <= by[1].score <= 1 and by[None].held_out is False
    assert identify(d, {}, ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    assert identify(docs_of([]), {"en": np.ones(DIMENSIONS)}, ["doc_id"]).count() == 0 and SEED > 0
