"""Benchmark decontamination as a prefix-filtered set join of token shingles, in built-in functions only.

Tokens are shingles of up to three benchmark words. One scan of the corpus finds where any benchmark token
stands; from these the corpus frequency of every token is counted. Exact containment needs only the first
token of each window's rarity-ordered shingles (prefix length 1 at containment 1), so each window joins the
corpus by its rarest token alone. Candidates must fit the document (window start at or after its first word,
window end at or before its last); exact containment is then verified word by word: on the candidate's
diagonal, a run of consecutive matching tokens as long as the window is required.

Words are compared as text, never only by hash. The benchmark is broadcast after its tokens are counted, and then
nothing else of a document than its matching positions is shuffled; a larger benchmark is joined by a shuffle of
every position with its token, never with its document.

Defined results: null or wordless texts have no words and no hits; a benchmark item without words has no
window; repeated rows are judged one by one; benchmark rows that share an item_id count as one item; a null
item_id can mark words but is not listed; an empty corpus or benchmark gives no rows or no hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small, table

#: Splits at everything but digits, ASCII letters and code points from 128 up.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most benchmark tokens that are broadcast (about 100 bytes each).
BROADCAST_TOKENS = 1_000_000
END = "\n"  # stands behind the last word of each document and can be no word


def _words(text_col: str):
    return F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), BETWEEN_WORDS), "")


def benchmark_tokens(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(row, item_id, q, k, len, token): every token of every item at its word position q; len words a window."""
    b = benchmark.select("item_id", F.monotonically_increasing_id().alias("row"), ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
    b = b.select("row", "item_id", _words("text").alias("w"))
    b = b.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window))).withColumn("k", F.least("len", F.lit(shingle)))
    b = b.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("q"))
    return b.select("row", "item_id", "q", "k", "len", F.size("w").alias("n"), F.array_join(F.slice("w", F.col("q") + 1, F.col("k")), " ").alias("token"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    occ = materialize(benchmark_tokens(benchmark, window, shingle), "decon-tokens")
    tokens = occ.select("k", "token").distinct()
    sizes = sorted(r.k for r in tokens.select("k").distinct().collect())  # at most `shingle` values

    # Each position has its own tokens, so that no row of the join holds more than a few words of its document.
    w = lambda i: ascii_lower(F.get(F.col("words"), F.col("pos") + i))
    at = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), _words("text").alias("words"))
    at = at.select("doc_id", "uid", "words", F.size("words").alias("n_words"), F.posexplode(F.array_append("words", F.lit(END))).alias("pos", "first"))
    # Behind the last word the only probe is the end mark, which carries the number of words of each document.
    probe = lambda k: F.struct(F.lit(k).alias("k"), F.when(F.col("pos") + k <= F.col("n_words"), F.concat_ws(" ", *[w(i) for i in range(k)])).alias("token"))
    ended, end = F.col("pos") == F.col("n_words"), F.struct(F.lit(0).alias("k"), F.lit(END).alias("token"))
    if len(sizes) > 1:
        at = at.withColumn("p", F.explode(F.when(ended, F.array(end)).otherwise(F.array(*map(probe, sizes)))))
    else:
        at = at.withColumn("p", F.when(ended, end).otherwise(probe(sizes[0]) if sizes else F.lit(None)))
    at = at.select("doc_id", "uid", "n_words", "pos", F.col("p.k").alias("k"), F.col("p.token").alias("token")).where("token IS NOT NULL")
    ends = docs.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(END).alias("token"))
    index = small(materialize(tokens.unionByName(ends), "decon-index"), BROADCAST_TOKENS)
    found = at.join(index, ["k", "token"])
    found = materialize(found.select("doc_id", "uid", "n_words", "pos", "token"), "decon-found")

    hits = found.where(F.col("token") != END)
    frequency = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    occ = occ.join(frequency, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # Each window's rarest token: the least (df, token, q) among the tokens inside it.
    inside = occ.select("row", "len", "n", "k", "q", "token", "df", F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") + F.col("k") - F.col("len")), F.least(F.col("q"), F.col("n") - F.col("len")))).alias("off"))
    prefix = inside.groupBy("row", "off", "len").agg(F.min(F.struct("df", "token", "q")).alias("a")).where("a.df > 0").select("row", "off", "len", F.col("a.token").alias("token"), F.col("a.q").alias("q"))
    prefix = small(prefix, BROADCAST_TOKENS)
    cand = hits.join(prefix, "token").withColumn("diag", F.col("pos") - F.col("q"))
    cand = cand.where((F.col("diag") + F.col("off") >= 0) & (F.col("diag") + F.col("off") + F.col("len") <= F.col("n_words"))).select("uid", "row", "diag").distinct()
    lines = hits.join(small(occ.select("token", "row", "item_id", "q", "k", "len"), BROADCAST_TOKENS), "token").withColumn("diag", F.col("pos") - F.col("q"))
    lines = lines.join(cand, ["uid", "row", "diag"], "left_semi")
    on_line = Window.partitionBy("uid", "row", "diag").orderBy("q")
    runs = lines.withColumn("run", F.col("q") - F.row_number().over(on_line)).groupBy("uid", "row", "diag", "run").agg(F.min("q").alias("q0"), F.max("q").alias("q1"), F.first("k").alias("k"), F.first("len").alias("len"), F.first("item_id").alias("item_id"))
    runs = materialize(runs.where(F.col("q1") - F.col("q0") + F.col("k") >= F.col("len")).select("uid", "item_id", (F.col("diag") + F.col("q0")).alias("start"), (F.col("diag") + F.col("q1") + F.col("k")).alias("stop")), "decon-runs")
    words = runs.select("uid", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos")).distinct().groupBy("uid").agg(F.count(F.lit(1)).alias("n_hit"))
    items = runs.groupBy("uid").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    every = found.where(F.col("token") == END).select("doc_id", "uid", F.col("n_words").cast("long").alias("n_words"))
    out = every.join(words.join(items, "uid"), "uid", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT item_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS s FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM b)),
pos AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS s
        FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT p.doc_id, p.i, p.n, x.item_id FROM pos p JOIN win x ON p.n = x.n AND p.s = x.s),
nh AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
