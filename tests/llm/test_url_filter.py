import math

from pyspark.sql import functions as F

from detframe.llm.url_filter import judge, op6_url_filter, seed_label, with_features, with_parts

from ..conftest import DATA

URLS = ["http://A.B.net/x?q#f", "https://net/", "ftp://www.example.NET/en/a", "http://example.net", "x://notexample.com/de/", "x://example.com/de/", "http://Ä.ORG/fr/p?a=1&b=2", "no scheme/de/", None, "", "://", "a://h?x/de/", "http://example.com/de/" + "z" * 20000]


def parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[:end]


def rule(host, path):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    fit = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def labelled(spark):
    rows = [(f"http://www.casino-win{i % 7}.example.com/{i}", 1.0) for i in range(40)] + [(f"http://word{i}.example.org/en/{i}", 0.0) for i in range(80)]
    return spark.createDataFrame(rows, "url string, label double")


def test_hosts_paths_and_rules(spark):
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, rest string")
    for r in judge(d, labelled(spark)).collect():
        host, path = parts(r.url)
        name, action = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name), r.url
        assert r.verdict == (action or r.verdict) and r.verdict in ("allow", "block")


def test_trees_learn(spark):
    d = spark.createDataFrame([(1, "http://www.casino-win9.example.com/77"), (2, "http://other.example.org/en/5")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge(d, labelled(spark)).collect()} == {1: "block", 2: "allow"}
    assert judge(d, labelled(spark).where("label = 0")).where("verdict = 'block'").count() == 0
    assert judge(d.limit(0), labelled(spark)).count() == 0 and judge(d, labelled(spark).limit(0)).count() == 2


def test_features(spark):
    r = with_features(with_parts(spark.createDataFrame([("http://a-b.c/x/1234/?q=1&r",), (None,)], "url string"))).where("url IS NOT NULL").first()
    u = r.url
    assert (r.length, r.depth, r.params, r.hyphens, r.labels, r.digit_run) == (len(u), 2, 2, 1, 2, 4)
    assert math.isclose(r.entropy, -sum(u.count(c) / len(u) * math.log2(u.count(c) / len(u)) for c in set(u)))


def test_pages(spark):
    r = op6_url_filter(spark, DATA)
    assert r.count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
    seeds = spark.read.parquet(f"{DATA}/pages.parquet").transform(with_parts).withColumn("seed", seed_label()).select("page_id", "seed")
    own = r.where(F.col("rule").isNull()).join(seeds, "page_id")
    assert own.where((F.col("verdict") == "block") == (F.col("seed") == 1)).count() / own.count() > 0.9


def test_many_more_urls_than_training_rows(spark):
    from detframe.llm.url_filter import drawn_rows

    same = "http://same.example.org/x"
    # Good and bad URLs have one form: only their sites' counts part them.
    url = lambda site, i: f"http://w{site}.site{site}.biz/{1000 + i}"
    rows = [(url(100 + i % 500, i), 0.0) for i in range(6000)] + [(same, 0.0)] * 3000 + [(url(600 + i % 4, 700 * i), 1.0) for i in range(8)]
    d = spark.createDataFrame(rows, "url string, label double")
    drawn = {(r.url, r.label): r.k for r in drawn_rows(d, 9000, 8, 300).collect()}
    assert sum(k for (_, label), k in drawn.items() if label == 1) == 8 and 200 < sum(drawn.values()) < 400
    assert 90 <= drawn[same, 0.0] <= 105  # a third of the rows is a third of the draw
    pages = d.select("url", "label").withColumn("page_id", F.monotonically_increasing_id())
    for many in (100_000, 10):
        got = judge(pages, d, train_rows=300, many_suffixes=many)
        assert got.count() == len(rows) and got.where((F.col("verdict") == "block") != (F.col("label") == 1)).count() == 0


def test_suffix_tables_count_all_rows(spark):
    from detframe.llm.url_filter import _with_suffix

    d = spark.createDataFrame([("hot",)] * 50 + [("cold",), ("new",)], "site string")
    counts = spark.createDataFrame([("hot", 10.0, 5000), ("cold", 1.0, 1)], "site string, bad double, n long")
    want = {("hot", round(10.5 / 5005, 9), round(math.log1p(5000), 9)), ("cold", 0.25, round(math.log1p(1), 9)), ("new", 0.1, 0.0)}
    for many in (10, 1):
        got = _with_suffix(d, counts, "site", "site", 5001, many).collect()
        assert len(got) == 52 and {(r.site, round(r.site_rate, 9), round(r.site_seen, 9)) for r in got} == want


def test_training_rates_leave_out_their_own_fold(spark):
    from detframe.llm.url_filter import _out_of_fold, _with_suffix

    train = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), ("c", 0)], "site string, fold int")
    folds = spark.createDataFrame([("a", 0, 3.0, 4), ("a", 2, 1.0, 10), ("b", 2, 2.0, 2)], "site string, fold int, bad double, n long")
    sites = folds.groupBy("site").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    got = _out_of_fold(_with_suffix(train, sites, "site", "site", 16, 10), folds, "site").collect()
    assert {(r.site, r.fold): (round(r.site_rate, 9), round(r.site_seen, 9)) for r in got} == {
        ("a", 0): (1.5 / 15, round(math.log1p(10), 9)), ("a", 1): (round(4.5 / 19, 9), round(math.log1p(14), 9)), ("b", 2): (0.1, 0.0), ("c", 0): (0.1, 0.0),
    }
