"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Features: length, depth, digit ratio, character entropy, parameters, hyphens, host labels and length, longest
run of digits, and for the last one and two host labels how often they stand on blocked labelled URLs
(smoothed) and how often at all, counted over all of these. The rows that the trees are fitted on see counts
out of fold: URLs fall into FOLDS parts by a hash, equal ones into one, and the counts of a row's own part are
taken off, so that no label is seen through its own rate. Suffix tables are broadcast up to MANY_SUFFIXES rows;
larger ones are joined by shuffles, but for suffixes with a thousandth of all rows. The trees are trained by
Spark's own gradient boosting from about `train_rows` labelled URLs: of each label up to half, or what the rarer
one leaves; of n equal URLs a share p is drawn as floor(n p + u) rows, u from a hash. The label of the registered
query: a host with one of SEED_WORDS among its hyphenated parts is blocked, others are not; the trees see
features alone, never words.

Defined results: a null URL or one without `://` has an empty host and path and matches no rule; the trees
judge it, too; repeated rows are judged one by one; texts of any length are read whole; without training rows
of both labels all unruled URLs are allowed; an empty table gives no rows; further columns stay, but for
those named host, path, rule or verdict, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, table

#: (action, host, path), longest first by host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SEED_WORDS = ("ads", "adult", "bets", "casino", "cheap", "pills", "spam", "track", "win")
TRAIN_ROWS, TREES, DEPTH, SEED = 20_000, 10, 4, 17
FOLDS = 5
#: Suffixes up to which their table is broadcast, share of all rows of a heavy suffix, and tasks its rows are dealt to.
MANY_SUFFIXES, HEAVY, SALTS = 100_000, 1e-3, 256
FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "hyphens", "labels", "host_length", "digit_run", "top_rate", "top_seen", "site_rate", "site_seen")


def with_parts(urls: DataFrame) -> DataFrame:
    """host: from the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? or #."""
    has = F.locate("://", F.col("url")) > 0
    rest = F.when(has, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    d = urls.withColumn("rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)"), r"^[^?#]*", 0)
    return d.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path).drop("rest")


def rule_of(rules=RULES):
    """The longest rule that fits host and path, as a struct (rule, action); null if none does."""
    out = None
    for action, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        hit = F.struct(F.lit(host + path).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def with_features(urls: DataFrame) -> DataFrame:
    u = F.coalesce("url", F.lit(""))
    n = F.length(u)
    chars = F.split(u, "")
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.when(n > 0, -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))).otherwise(0.0)
    digits = F.length(F.regexp_replace(u, "[^0-9]", ""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    runs = F.transform(F.regexp_extract_all(u, F.lit("([0-9]+)"), F.lit(1)), lambda r: F.length(r))
    site = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return urls.select(
        "*", n.cast("double").alias("length"), F.size(F.array_remove(F.split("path", "/"), "")).cast("double").alias("depth"), F.when(n > 0, digits / n).otherwise(0.0).alias("digit_ratio"), entropy.alias("entropy"),
        F.size(F.array_remove(F.split(query, "&"), "")).cast("double").alias("params"), (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        F.size(labels).cast("double").alias("labels"), F.length("host").cast("double").alias("host_length"), F.coalesce(F.array_max(runs), F.lit(0)).cast("double").alias("digit_run"), F.element_at(labels, -1).alias("top"), site.alias("site"),
    )


def seed_label():
    return F.arrays_overlap(F.split(F.regexp_replace("host", r"\.", "-"), "-"), F.array(*map(F.lit, SEED_WORDS))).cast("double")


def _rated(d: DataFrame, prefix: str) -> DataFrame:
    return d.withColumns({f"{prefix}_rate": (F.col(f"{prefix}_bad") + 0.5) / (F.col(f"{prefix}_n") + 5), f"{prefix}_seen": F.log1p(f"{prefix}_n")})


def _with_suffix(d: DataFrame, counts: DataFrame, column: str, prefix: str, total: int, many: int) -> DataFrame:
    """d with the rate and the frequency of a suffix, and bad and n that they come from; counts: the column, bad, n."""
    bad, n = f"{prefix}_bad", f"{prefix}_n"
    named = counts.select(column, F.col("bad").alias(bad), F.col("n").alias(n))
    if counts.limit(many + 1).count() <= many:
        d = d.join(F.broadcast(named), column, "left")
    else:
        # At most 1 / HEAVY suffixes are heavy; their rows are dealt out by a salt that no light suffix has.
        heavy = named.where(F.col(n) >= HEAVY * total).select(column, F.col(bad).alias("heavy_bad"), F.col(n).alias("heavy_n"))
        light = named.where(F.col(n) < HEAVY * total).withColumn("salt", F.lit(0).cast("long"))
        d = d.join(F.broadcast(heavy), column, "left")
        d = d.withColumn("salt", F.when(F.col("heavy_n").isNull(), 0).otherwise(1 + F.monotonically_increasing_id() % SALTS)).join(light, [column, "salt"], "left")
        d = d.withColumn(bad, F.coalesce("heavy_bad", bad)).withColumn(n, F.coalesce("heavy_n", n)).drop("salt", "heavy_bad", "heavy_n")
    return _rated(d.fillna({bad: 0.0, n: 0}), prefix)


def _out_of_fold(train: DataFrame, folds: DataFrame, column: str) -> DataFrame:
    """train (a bounded draw, with fold) rated without its own fold's part of the counts; folds: the column, fold, bad, n."""
    own = folds.join(F.broadcast(train.select(column, "fold").distinct()), [column, "fold"]).select(column, "fold", F.col("bad").alias("own_bad"), F.col("n").alias("own_n"))
    d = train.join(F.broadcast(own), [column, "fold"], "left").fillna({"own_bad": 0.0, "own_n": 0})
    d = d.withColumns({f"{column}_bad": F.col(f"{column}_bad") - F.col("own_bad"), f"{column}_n": F.col(f"{column}_n") - F.col("own_n")})
    return _rated(d, column).drop("own_bad", "own_n")


def drawn_rows(labelled: DataFrame, good: int, bad: int, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """url, label, k: how many of the equal rows are drawn. good and bad: rows with label 0 and 1."""
    rare = min(good, bad, train_rows // 2)
    share = lambda n: min(1.0, (rare if n == min(good, bad) else train_rows - rare) / max(1, n))
    same = labelled.groupBy("url", "label").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64(F.lit(SEED), "url"), F.lit(1_000_000)) / 1e6
    k = F.floor(F.col("n") * F.when(F.col("label") == 1, share(bad)).otherwise(share(good)) + part)
    return same.select("url", "label", k.alias("k")).where("k > 0")


def judge(urls: DataFrame, labelled: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS, many_suffixes: int = MANY_SUFFIXES) -> DataFrame:
    """urls (with url) plus host, path, rule, verdict; labelled: url, label (1.0 block, 0.0 allow)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    labelled = labelled.where(F.col("label").isNotNull()).select("url", "label")
    fold = F.pmod(F.xxhash64(F.lit(FOLDS), "url"), F.lit(FOLDS)).alias("fold")
    folds = with_features(with_parts(labelled)).groupBy("top", "site", fold).agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
    folds = materialize(folds, "url-folds")
    sums = lambda d, *keys: d.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    sites, tops = materialize(sums(folds, "site"), "url-site"), materialize(sums(folds, "top"), "url-top")
    total, bad = tops.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    train = materialize(with_features(with_parts(drawn_rows(labelled, total - int(bad), int(bad), train_rows))).select("*", fold), "url-train")

    def counted(d: DataFrame) -> DataFrame:
        return _with_suffix(_with_suffix(d, tops, "top", "top", total, many_suffixes), sites, "site", "site", total, many_suffixes)

    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    share = train.groupBy("label").agg(F.sum("k").alias("count")).collect()  # two rows
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    d = with_features(with_parts(urls.select(F.struct(*own).alias("row"), "url")))
    if len(share) == 2:
        weight = {r["label"]: sum(x["count"] for x in share) / (2 * r["count"]) for r in share}
        rows = _out_of_fold(_out_of_fold(counted(train), sums(folds, "top", "fold"), "top"), folds.drop("top"), "site")
        rows = rows.withColumn("weight", F.col("k") * F.when(F.col("label") == 1, weight[1.0]).otherwise(weight[0.0]))
        model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1).fit(assembler.transform(rows).select("features", "label", "weight").coalesce(4))
        d = model.transform(assembler.transform(counted(d))).withColumn("own", F.when(F.col("prediction") == 1, "block").otherwise("allow"))
    else:
        d = d.withColumn("own", F.lit("allow"))
    return d.withColumn("r", rule_of(rules)).select("row.*", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", "own").alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = with_parts(pages.where("url IS NOT NULL")).select("url", seed_label().alias("label"))
    return judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict")
