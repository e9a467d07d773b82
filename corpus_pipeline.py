"""A training corpus in five stages: language ID, near-duplicate removal, decontamination, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import materialize, remove, scratch, shuffle_partitions, table, workspace
from detframe.llm.decontamination import decontaminate
from detframe.llm.jaccard_join import jaccard_components
from detframe.llm.language_id import UNKNOWN, alphabet, identify, plausible, prototypes, with_folds
from detframe.llm.mixing import WORD, first_words, passes
from detframe.llm.token_files import token_digests

#: Columns of documents, which every stage but the last returns; further columns of its input end with the first stage.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates share 80 percent or more of their 5-word shingles; op7's own query has other values.
SHINGLE, PERCENT = 5, 80


def row_hash(part: int, *columns):
    """One of the 64-bit halves of a row's key."""
    return F.xxhash64(F.lit(part), *columns)


def row_key(*columns):
    """128 bits for a row: ids may be null, and one id may have several texts."""
    return F.struct(row_hash(1, *columns).alias("a"), row_hash(2, *columns).alias("b"))


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels name: no `und`, and a cosine or letters beyond chance.

    A null or letterless text is `und` and goes; of equal rows all stay or all go; a tie of languages changes nothing.
    """
    labelled = with_folds(docs.select("doc_id", "text", "lang"))
    found = identify(docs.select(*COLUMNS), prototypes(labelled), list(COLUMNS))
    return found.where((F.col("lang_pred") != UNKNOWN) & plausible(alphabet(labelled))).select(*COLUMNS)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: of the smallest doc_id, nulls last; documents without words stay, of equal rows one.

    Rows go by the key of id and text.
    """
    key = row_key("doc_id", "text")
    found = jaccard_components(docs.select(key.alias("doc_id"), "text"), shingle=SHINGLE, percent=PERCENT)
    found = materialize(found.select(F.col("doc_id").alias("key"), "component_id"), "near-duplicates")
    others = found.where("component_id <> key").distinct()
    groups = others.union(others.select(F.col("component_id").alias("key"), "component_id")).distinct()
    ids = docs.select(key.alias("key"), "doc_id").distinct()
    best = groups.join(ids, "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")).select("best.key")
    dropped = materialize(groups.select("key").join(best, "key", "left_anti"), "near-dropped")
    kept = docs.withColumn("key", key).join(dropped, "key", "left_anti").select(*docs.columns)
    repeated = found.groupBy("key").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def clean_of_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark.

    Rows go by the key of id and text, and equal rows have one verdict. Null and wordless texts stay, so do all
    documents under an empty benchmark; of one id's texts each is judged by itself.
    """
    key = row_key("doc_id", "text")
    judged = decontaminate(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = materialize(judged.where("contaminated").select(F.col("doc_id").alias("__key")).distinct(), "clean-bad")
    return docs.withColumn("__key", key).join(bad, "__key", "left_anti").drop("__key")


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the order of its schedule: every row is one pass through a document, where its first slot stands.

    A source's words are exactly those that the mix takes: its last document is cut to its first words (parted by
    blanks, n_chars counted anew), all others are whole. Wordless documents take nothing and go; repeated rows and
    null ids are documents of their own; equal slots go by lap and a hash.
    """
    columns, key = docs.columns, ("__a", "__b")
    docs = docs.withColumns({k: row_hash(i, "doc_id", "source", "text") for i, k in enumerate(key, 1)})
    taken = materialize(passes(docs, key), "mixed-passes")
    slots = (taken.agg(F.max("slot")).first()[0] or 0) + 1
    # Equal rows are as good as one row with the passes of all.
    repeated = materialize(docs.groupBy(*key).count().where("count > 1").select(*key), "mixed-repeated")
    if not repeated.isEmpty():
        docs = docs.join(repeated, list(key), "left_anti").unionByName(docs.join(repeated, list(key), "left_semi").dropDuplicates(list(key)))
    parts = docs.join(taken, list(key)).withColumn("__cut", F.regexp_count("text", F.lit(WORD)) > F.col("words"))
    parts = parts.withColumn("text", F.when(F.col("__cut"), first_words(F.col("text"), F.col("words").cast("int"))).otherwise(F.col("text")))
    parts = parts.withColumn("n_chars", F.when(F.col("__cut"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    n = shuffle_partitions(spark)
    place = F.floor(F.col("slot") * n / slots).cast("int")  # a partition holds a stretch of the schedule
    return parts.repartitionById(n, place).sortWithinPartitions("slot", "lap", *key).select(*columns)


def token_files(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every row, read back from the files; a null or empty text has its end id alone, equal ids
    follow each other, an empty table gives no rows."""
    return token_digests(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", clean_of_benchmark), ("mixing to target weights", mixed), ("token-ID files", token_files)]
#: Language profiles, components and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages; what a stage writes on its way goes when its result stands, and a result when the next one does."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch(spark, f"pipeline-{i}")
        with workspace(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
