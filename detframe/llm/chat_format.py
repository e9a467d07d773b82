r"""Conversations from reply trees: root-to-leaf paths by iterative self-joins, ranked by score, one text each.

Paths are found by doubling: round k joins the table of 2^k-th ancestors with itself, and the paths so far
with it, so that a thread of n messages takes log2(n) rounds. Branches of one tree are ranked by the sum of
their messages' scores (ties: the smaller leaf id); the best `top` of each tree are formatted.

Template of a turn: `### ` role, line feed, text, line feed, `</turn>`, line feed. In texts and roles a
backslash stands before every backslash, `#` and `<`, and `\n` for a line feed in a role. So neither control
string can occur in an escaped text, the end of a turn is the exact string "\n</turn>\n", and reading is
exact. The loss mask lists the code-point spans of assistant texts in the formatted text.

Defined results: a null text or role is empty; a null score is 0; a missing parent makes a root; of rows with
one message id the first by (parent, role, text) counts; messages that hang on a cycle of parents are on no
path; a null message id is ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

HEAD, TAIL = "### ", "\n</turn>\n"
TRAINED_ROLE = "assistant"


def paths(messages: DataFrame) -> DataFrame:
    """leaf, message_id, up: every message on the path of each leaf, `up` steps above it; only rooted paths."""
    m = messages.select("message_id", "parent_id")
    known = m.select(F.col("message_id").alias("parent_id"))
    up = materialize(m.join(known, "parent_id", "left_semi").select(F.col("message_id").alias("node"), F.col("parent_id").alias("above")), "chat-up")
    leaves = m.join(up.select(F.col("above").alias("message_id")).distinct(), "message_id", "left_anti")
    path = leaves.select(F.col("message_id").alias("leaf"), "message_id", F.lit(0).cast("long").alias("up"))
    step, count = 1, None
    while not up.isEmpty():
        if step > 1:
            count = count if count is not None else m.count()
            if step > count:  # only cycles have ancestors this far up
                endless = path.join(up.select(F.col("node").alias("message_id")), "message_id", "left_semi").select("leaf").distinct()
                return path.join(endless, "leaf", "left_anti")
        more = path.join(up, F.col("message_id") == F.col("node")).select("leaf", F.col("above").alias("message_id"), (F.col("up") + step).alias("up"))
        path = materialize(path.unionByName(more), "chat-path")
        further = up.select(F.col("node").alias("above"), F.col("above").alias("top"))
        up = materialize(up.join(further, "above").select("node", F.col("top").alias("above")), "chat-up")
        step *= 2
    return path


def _escaped(c):
    c = F.coalesce(c, F.lit(""))
    for mark in ("\\", "<", "#"):
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    return c


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """messages: message_id, parent_id, role, text, score -> leaf, root, rank, score, n_turns, formatted, loss_spans."""
    first = F.row_number().over(Window.partitionBy("message_id").orderBy("parent_id", "role", "text"))
    m = messages.where("message_id IS NOT NULL").withColumn("nth", first).where("nth = 1").select("message_id", "parent_id", "role", "text", "score")
    m = materialize(m, "chat-messages")
    path = materialize(paths(m), "chat-paths")
    scored = path.join(m.select("message_id", F.coalesce("score", F.lit(0.0)).alias("score")), "message_id")
    branch = scored.groupBy("leaf").agg(F.sum("score").alias("score"), F.max("up").alias("depth"), F.max_by("message_id", "up").alias("root"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "leaf"))
    branch = materialize(branch.withColumn("rank", rank).where(F.col("rank") <= top), "chat-branches")
    head = F.concat(F.lit(HEAD), F.replace(_escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    turns = path.join(branch, "leaf").join(m.select("message_id", "role", head.alias("head"), _escaped(F.col("text")).alias("body")), "message_id")
    turns = turns.withColumn("turn", F.col("depth") - F.col("up")).withColumn("size", F.char_length("head") + F.char_length("body") + len(TAIL))
    end = F.sum("size").over(Window.partitionBy("leaf").orderBy("turn"))
    begin = end - F.col("size") + F.char_length("head")
    span = F.when(F.col("role") == TRAINED_ROLE, F.struct(begin.alias("start"), (begin + F.char_length("body")).alias("stop")))
    turns = turns.withColumn("span", span).withColumn("piece", F.concat("head", "body", F.lit(TAIL)))
    one = turns.groupBy("leaf", "root", "rank", "score").agg(F.array_sort(F.collect_list(F.struct("turn", "piece", "span"))).alias("t"))
    spans = F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull())
    return one.select("leaf", "root", "rank", "score", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    plain = lambda s, line=False: re.sub(r"\\(.)", lambda m: "\n" if line and m[1] == "n" else m[1], s, flags=re.S)
    out = []
    for piece in formatted.split(TAIL)[:-1]:
        role, text = piece.removeprefix(HEAD).split("\n", 1)
        out.append((plain(role, True), plain(text)))
    return out


def _digests(batches):
    for batch in batches:
        out = []
        for key, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            turns = parse(formatted)
            loss = "".join(re.sub(r"\\(.)", r"\1", formatted[s["start"] : s["stop"]], flags=re.S) for s in spans)
            said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            out.append((key, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i in (2, 4) else pa.int64()) for i in range(6)], names)


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as trees of one branch: each turn answers the one before; ties in turn go by role and text."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), n.cast("string"))
    c = conversations.select("conv_id", "role", "text", nth.alias("nth"))
    return c.select(name(F.col("nth")).alias("message_id"), F.when(F.col("nth") > 1, name(F.col("nth") - 1)).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    small_batches(spark)
    chosen = format_trees(conversation_messages(rows.unionByName(own)))
    conv = F.expr("try_cast(nullif(substring_index(root, ':', 1), '') AS long)")
    return chosen.select(conv.alias("conv_id"), "formatted", "loss_spans").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_ESC = r"replace(replace(replace(coalesce({}, ''), '\', '\\'), '<', '\<'), '#', '\#')"
OP5_SQL = rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN coalesce(text, '') END, '' ORDER BY n), '')) AS loss_sha256,
       CAST(sum(4 + length(replace({_ESC.format('role')}, chr(10), '\n')) + 1 + length({_ESC.format('text')}) + 9) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
