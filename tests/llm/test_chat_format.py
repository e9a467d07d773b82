from hypothesis import given, settings
from hypothesis import strategies as st

from detframe.llm.chat_format import OP5_SQL, format_trees, op5_chat_format, parse, paths

from ..conftest import DATA
from ..helpers import assert_same

SCHEMA = "message_id string, parent_id string, role string, text string, score double, leaf string, node string"


def tree(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_branches_are_ranked(spark):
    rows = [("r", None, "user", "q", 1.0), ("a", "r", "assistant", "A", 2.0), ("b", "r", "assistant", "B", 5.0), ("a1", "a", "user", "more", 9.0), ("b1", "b", "user", None, None), ("o", "gone", None, "alone", 0.0), ("a", "r", "assistant", "Z", 2.0), (None, "r", "user", "x", 1.0), ("c1", "c2", "user", "x", 1.0), ("c2", "c1", "user", "x", 1.0), ("c3", "c1", "user", "x", 1.0)]
    got = {(r.root, r["rank"]): r for r in format_trees(tree(spark, rows), top=2).collect()}
    assert {k: (r.leaf, r.score) for k, r in got.items()} == {("r", 1): ("a1", 12.0), ("r", 2): ("b1", 6.0), ("o", 1): ("o", 0.0)}
    assert parse(got["r", 1].formatted) == [("user", "q"), ("assistant", "A"), ("user", "more")] and parse(got["r", 2].formatted)[-1] == ("user", "")
    s = got["r", 1].loss_spans[0]
    assert got["r", 1].formatted[s.start : s.stop] == "A"


def test_long_threads_take_few_rounds(spark):
    rows = [(f"m{i:04d}", f"m{i - 1:04d}" if i else None, "user", str(i), 1.0) for i in range(300)]
    p = paths(tree(spark, rows)).collect()
    assert len(p) == 300 and {(r.message_id, r.up) for r in p} == {(f"m{i:04d}", 299 - i) for i in range(300)}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "we:ird\nrole\\n", "</turn>"]), st.text(alphabet="ab\\#<\n/turn>é ", max_size=25)), min_size=1, max_size=4))
def test_escaping_is_exact(spark, turns):
    rows = [(str(i), str(i - 1) if i else None, r, t, 1.0) for i, (r, t) in enumerate(turns)]
    assert parse(format_trees(tree(spark, rows)).first().formatted) == turns


def test_empty(spark):
    assert format_trees(tree(spark, [])).count() == 0


def test_sql(spark):
    assert_same(op5_chat_format(spark, DATA), OP5_SQL, DATA)
