import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from detframe.llm import pii
from detframe.llm.pii import added_spans, base_spans, find_pii, fit, luhn, op8_pii

from ..conftest import DATA

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def by_pattern(text):
    d = lambda s: re.sub("[^0-9]", "", s)
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(d(s)) <= 19 and luhn(d(s)), "phone": lambda s: 9 <= len(d(s)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok[k](m[0])]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+ 0145(\u00e9", max_size=60))
def test_base_equals_patterns(text):
    assert base_spans(text) == by_pattern(text)


def test_base_on_known_cases():
    t = "é x.y+z@a-b.co.uk, 1.2.3.4.5.6.7.8 300.1.1.1 0001.0.0.255; 4111 1111-1111 1111; 4111111111111112; +1 (555) 010-9999 +12"
    assert base_spans(t) == by_pattern(t) and [k for k, _, _ in base_spans(t)] == ["email", "ip", "ip", "ip", "card", "phone"]
    assert base_spans("a" * 200_000 + "9" * 200_000) == []  # in linear time


def planted(n=600, seed=8):
    """Texts with known spans: plain ones, and those the base misses: numbers side by side, broken lines, repeats."""
    import random

    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        def card():
            d = "4" + digits(14)
            return next(d + c for c in "0123456789" if luhn(d + c))

        def decoy():
            d = digits(15)
            return next(d + c for c in "0123456789" if not luhn(d + c))

        phone = lambda: f"+1 ({r.randint(200, 999)}) 555-{digits(4)}"
        ip = lambda: ".".join(str(r.randint(1, 254)) for _ in range(4))
        mail = lambda: f"{r.choice('abcdef')}{r.choice('xyz')}ne.{digits(2)}@mail{r.randint(0, 9)}.example.com"
        kinds, parts = {"email": mail, "ip": ip, "card": card, "phone": phone}, []
        for _ in range(r.randint(0, 3)):
            k = r.choice(list(kinds))
            parts.append((k, kinds[k]()))
        extra = r.randint(0, 9)
        if extra == 0:
            parts += [("phone", phone()), ("card", card())]
            glue = " "
        elif extra == 1:
            parts, glue = [("phone", phone().replace(") ", ")\n"))], " and "
        elif extra == 2:
            parts, glue = [(None, decoy()), ("card", card())], " "
        elif extra == 3:
            parts, glue = [(None, decoy()), (None, decoy())], " or "
        else:
            glue = " word, "
        text, truth = "é start ", set()
        for k, t in parts:
            if k:
                truth.add((k, len(text), len(text) + len(t)))
            text += t + glue
        out.append((text + "end", truth))
    return out


@pytest.fixture(scope="module")
def model():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([t for t, _ in planted()])], ["text"])
    return fit([(k, c) for b in pii.count_statistics([rows]) for k, c in zip(b.column("key").to_pylist(), b.column("n").to_pylist())])


def test_field_finds_what_the_base_misses(model):
    missed = found = right = 0
    for text, truth in planted(400, 99):
        base = base_spans(text)
        more = set(added_spans(text, base, model))
        assert not more & set(base)
        missed += len(truth - set(base))
        found += len(more)
        right += len(more & truth)
    assert missed > 80 and right >= 0.9 * missed and right >= 0.9 * found


def test_field_adds_repeats_only(model):
    t = "call +1 555 010 9999, now. again 15550109999 or 1-555-010-9999, not 4111111111111112 nor 777777777777"
    spans = added_spans(t, base_spans(t), model)
    assert [t[s:e] for _, s, e in spans] == ["15550109999", "1-555-010-9999"] and {k for k, _, _ in spans} == {"phone"}
    for clean in ("order 15550109999 and 15550109999 again", "4111111111111112, 4111111111111112", "in 2024 version 12.3.4 of 1,000,000"):
        assert added_spans(clean, base_spans(clean), model) == []
    mail = "jane.roe@x.org wrote; jane.roe agreed"
    assert [mail[s:e] for _, s, e in added_spans(mail, base_spans(mail), model)] == ["jane.roe"]


def test_marginals_equal_enumeration_on_trees(model):
    import itertools

    for t in ("+1 (555) 555-0199, 1234567 and 4111111111111112", "7777777 then 1.2.3.4 then 888888"):
        us = pii.units(t, base_spans(t))
        es = [e for e in pii.edges(us, t) if e[2] == 0]  # a chain is a tree
        n = len(pii.KINDS) + 1
        total = np.zeros((len(us), n))
        for labels in itertools.product(range(n), repeat=len(us)):
            if any(label and label != y for (_, _, label), y in zip(us, labels)):
                continue
            z = sum(pii._features(pii.surface(t[s:e])) @ model["node"][:, y] for (s, e, label), y in zip(us, labels) if not label)
            z += sum(model["chain"][labels[i], labels[j]] for i, j, _ in es)
            total[np.arange(len(us)), labels] += np.exp(z)
        assert len(us) == 3 and np.allclose(pii.marginals(us, t, es, model), total / total.sum(1, keepdims=True), atol=1e-4)


def test_edges(spark, docs_of):
    d = docs_of([(1, None), (2, ""), (None, "a@b.co"), (3, "a@b.co"), (3, "a@b.co"), (4, "no " * 50_000)])
    got = {r.doc_id: r for r in find_pii(d).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == "" and got[None].spans == "email:0:6" and got[3].n_email == 1
    assert find_pii(docs_of([])).count() == 0


def test_whole_table_equals_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in op8_pii(spark, DATA).collect():
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in by_pattern(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_field_reaches_all_repeats(model):
    for base, repeat, kind in (("+1 555 010 9999,", "15550109999", "phone"), ("jane.roe@x.org", "jane.roe", "email")):
        filler = lambda i: f" and {repeat} no{'x' * i}"
        for t in (base + "".join(map(filler, range(50))), "".join(map(filler, range(50))) + " so " + base):
            spans = added_spans(t, base_spans(t), model)
            assert len(spans) == 50 and {(k, t[s:e]) for k, s, e in spans} == {(kind, repeat)}


def test_thousands_of_units(model):
    t = "+1 555 010 9999, " + "15550109999 and " * 3000
    assert len(added_spans(t, base_spans(t), model)) == 3000


def test_draw_is_bounded(spark, docs_of, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit", lambda rows: seen.append(sum(c for _, c in rows)))
    pii.train(docs_of([(1, "a@b.co")] * 500), train_docs=100)
    assert seen == [100]
