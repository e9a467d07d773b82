import pytest

import corpus_pipeline as cp
from detframe.llm.mixing import mix

from .test_decontamination import brute as hits
from .test_jaccard_join import brute as near

pytest.importorskip("public_tokenizers")


@pytest.fixture
def corpus(spark, tmp_path):
    import random

    r = random.Random(9)
    say = lambda ws, n: " ".join(r.choice(ws) + r.choice(ws) for _ in range(n))
    en, de = ["the", "ing", "er", "and", "on", "th"], ["sch", "ein", "ung", "der", "keit", "ä"]
    item = say(en, 30)
    rows = []
    for i in range(120):
        t, lang = (say(en, 60), "en") if i % 2 else (say(de, 50), "de")
        rows.append((i, t, lang, f"s{i % 4}", len(t)))
    rows += [(200, rows[1][1], "en", "s0", 1), (201, rows[1][1] + " tail", "en", "s1", 1), (202, say(en, 20) + " " + item + " " + say(en, 20), "en", "s2", 1), (203, None, "en", "s2", None), (204, "12 34", None, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, [(1, item)]


def test_stages_equal_brute_force(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = lambda d: sorted(r.doc_id for r in d.collect())
    stage = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights", "token-ID files"]
    one = stage["language ID"](spark, docs, folder)
    assert one.columns == columns and ids(one) == [r[0] for r in rows if r[0] not in (203, 204)]
    two = stage["n-gram Jaccard join"](spark, one, folder)
    left = [(r.doc_id, r.text) for r in one.collect()]
    assert two.columns == columns and ids(two) == sorted(d for d, _, c in near(left) if d == c) and 200 not in ids(two) and 201 not in ids(two)
    three = stage["benchmark decontamination"](spark, two, folder)
    clean = [d for d, *_, bad in hits([(r.doc_id, r.text) for r in two.collect()], items) if not bad]
    assert three.columns == columns and ids(three) == sorted(clean) and 202 not in clean
    four = stage["mixing to target weights"](spark, three, folder)
    assert four.columns == columns and set(ids(four)) <= set(clean) and max(map(ids(four).count, clean)) <= 2
    words = lambda d, s: sum(len(r.text.split()) for r in d.collect() if r.source == s)
    took = {}
    for r in mix(three).collect():
        took[r.source] = took.get(r.source, 0) + r.taken
    assert {s: words(four, s) for s in took} == took
    whole = {r.doc_id: r.text for r in three.collect()}
    cut = [r for r in four.collect() if r.text != whole[r.doc_id]]
    assert len(cut) <= len(took) and all(whole[r.doc_id].split()[: len(r.text.split())] == r.text.split() and r.n_chars == len(r.text) for r in cut)
    five = cp.run(spark, folder)
    assert ids(five) == ids(four) and five.agg({"n_tokens": "sum"}).first()[0] == five.selectExpr("max(start + n_tokens)").first()[0]


def test_near_duplicates_at_five_words_and_80_percent(spark, docs_of):
    import itertools

    from .test_jaccard_join import shingles

    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words + [f"x{i}" for i in range(45)])), (3, " ".join(words + [f"y{i}" for i in range(60)]))]
    rows += [(4, " ".join(f"v{i}" for i in range(50))), (5, " ".join("other" if i == 25 else f"v{i}" for i in range(50)))]
    sets = {i: shingles(t, 5) for i, t in rows}
    drop = {b for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = docs_of(rows)
    assert drop == {2, 5}
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()) == [i for i in sets if i not in drop]


def test_language_stage_rejects_noise_and_keeps_short_texts(spark, tmp_path):
    import random

    r = random.Random(3)
    en, de = ["the", "ing", "er", "and", "on", "th"], ["sch", "ein", "ung", "der", "keit", "ä"]
    say = lambda ws, n: " ".join(r.choice(ws) + r.choice(ws) for _ in range(n))
    noise = lambda a, n: " ".join("".join(r.choice(a) for _ in range(r.randint(3, 9))) for _ in range(n))
    rows = [(i, say(en, 60) if i % 2 else say(de, 60), "en" if i % 2 else "de") for i in range(120)]
    keep = [(1000, "Thing.", "en"), (1001, "derung", "de"), (1002, "thing " * 100, "en")]
    cyrillic, han, latin = [chr(c) for c in range(0x430, 0x450)], [chr(c) for c in range(0x4E00, 0x5200)], "abcdefghijklmnopqrstuvwxyz"
    drop = [(2000 + i, noise(a, n), None) for i, (a, n) in enumerate([(a, n) for a in (cyrillic, han) for n in (1, 60) for _ in range(20)] + [(a, n) for a in (latin, "abcdef") for n in (60,) for _ in range(20)])]
    d = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows + keep + drop], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in cp.language(spark, d, "").collect()) == [i for i, *_ in rows + keep]


def test_near_duplicates_go_by_row(spark, docs_of):
    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("a") + " tail"), (None, text("a")), (1, text("b")), (2, text("b") + " tail"), (2, text("c")), (4, text("d")), (None, text("d") + " tail"), (5, ""), (6, "")]
    got = cp.near_duplicates(spark, docs_of(rows), "").collect()
    left = sorted((r.doc_id, r.text) for r in got if r.doc_id is not None)
    assert left == sorted([rows[3], rows[5], rows[6], rows[8], rows[9]]) and len(got) == len(left) + 1
    assert next(r.text for r in got if r.doc_id is None) in (text("a"), text("a") + " tail")


def test_rows_that_share_half_a_key_stay_apart(spark, tmp_path, docs_of, monkeypatch):
    """As if all 64-bit hashes of one half collided: no row goes with another one."""
    from pyspark.sql import functions as F

    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("b")), (3, text("c")), (4, text("a") + " tail"), (5, "item words one two three"), (None, text("d"))]
    spark.createDataFrame([(1, "item words one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    real = cp.row_hash
    for dead in (1, 2):
        monkeypatch.setattr(cp, "row_hash", lambda part, *c, dead=dead: F.lit(0).cast("long") if part == dead else real(part, *c))
        left = cp.near_duplicates(spark, docs_of(rows).select(*cp.COLUMNS), "")
        assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "5", "None"]
        assert sorted(str(r.doc_id) for r in cp.clean_of_benchmark(spark, left, str(tmp_path)).collect()) == ["1", "2", "3", "None"]


def test_one_long_document_is_taken_to_the_word(spark, docs_of):
    d = docs_of([(1, "long " * 4000)], source="a").unionByName(docs_of([(i, "w " * 50) for i in range(10, 17)], source="b")).select(*cp.COLUMNS)
    took = {}
    for r in mix(d).collect():
        took[r.source] = took.get(r.source, 0) + r.taken
    got = cp.mixed(spark, d, "").collect()
    assert {s: sum(len(r.text.split()) for r in got if r.source == s) for s in took} == took
    spread = [r.source for r in got]
    assert "b" in spread[: len(spread) // 2] and "b" in spread[len(spread) // 2 :]


def test_empty_tables_and_odd_rows(spark, tmp_path, docs_of):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs_of([]).select(*cp.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    rows = [(1, "the thing " * 30_000, "en", "s", 1), (None, "other thing", None, None, None), (2, "a", "en", "s", 1), (2, "b", "en", "s", 1), (3, None, "en", "s", 1)]
    d = spark.createDataFrame(rows, kinds)
    clean = cp.clean_of_benchmark(spark, d, str(tmp_path)).collect()
    assert sorted(map(str, clean)) == sorted(map(str, d.collect()))
    item = spark.createDataFrame([(1, "b")], "item_id long, text string")
    item.write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.text) for r in cp.clean_of_benchmark(spark, d, str(tmp_path)).collect() if r.doc_id == 2] == [(2, "a")]
    assert max(len(r.text) for r in cp.mixed(spark, d, "").collect()) > 100_000
