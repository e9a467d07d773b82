import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, token string, uid string, label string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, 1, "x", "y", "z", "q") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def texts():
    """Random texts with exact and near copies, shared passages, odd characters, empty and long ones."""
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(60)]
    out = []
    for i in range(120):
        w = [word() for _ in range(r.choice([3, 8, 40, 90, 200]))]
        if i % 3 == 0:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        out.append(" ".join(w))
    for i in range(60):
        w = out[r.randrange(len(out))].split(" ")
        for _ in range(r.choice([0, 1, 2, 6])):
            w[r.randrange(len(w))] = word()
        out.append("\n".join([" ".join(w)]) if i % 2 else "  ".join(w).upper())
    out += ["", None, " \n\t ", "É à\x0bb c d", "x", "a " * 30_000, "Z" * 5000, out[0], out[0]]
    return list(enumerate(out))
