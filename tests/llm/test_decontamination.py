import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm.decontamination import Automaton, match, remove_spans, verdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(text, items, window=13):
    ws, hit, found = words(text), set(), set()
    for name, t in items:
        it = words(t)
        size = min(window, len(it))
        wins = {tuple(it[i : i + size]) for i in range(len(it) - size + 1)} if size else set()
        for i in range(len(ws) - size + 1):
            if tuple(ws[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(name)
    return len(ws), hit, found


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6))
def test_automaton_matches_brute_force(seed):
    rng = random.Random(seed)
    letters = "a b c d É".split()[: rng.randint(2, 5)]
    make = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    window = rng.randint(2, 5)
    items = [(str(i), make(rng.randint(0, 9))) for i in range(rng.randint(1, 6))]
    texts = [make(rng.randint(0, 40)) for _ in range(6)]
    n_words, spans, found = Automaton([i for i, _ in items], [t for _, t in items], window).scan(pa.array(texts))
    for k, text in enumerate(texts):
        n, hit, names = brute(text, items, window)
        assert (n_words[k], found[k]) == (n, names)
        assert {p for a, b in spans[k] for p in range(a, b)} == hit


def rows_of(df):
    return {r.doc_id: r for r in verdict(df).collect()}


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_edges(spark, block_words):
    passage = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage), (2, "Short one"), (3, ""), (4, None), (1, "w3 w4"), (None, "zz top")], "item_id int, text string")
    texts = ["", None, "no hit here", f"x {passage.upper()}! y", "a short ONE, b", "w0 w1 w2", " ".join(f"w{i}" for i in range(12)), passage + " filler" * 900, "zz-top", passage, passage, "one short"]
    docs = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = rows_of(match(docs, items, block_words=block_words))
    plain = [(str(r.item_id) if r.item_id else "", r.text) for r in items.collect()]
    for i, t in enumerate(texts):
        n, hit, names = brute(t, plain)
        assert (got[i].n_words, got[i].n_hit, set(got[i].item_ids)) == (n, len(hit), names), t
        assert got[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
    assert match(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in rows_of(match(docs, items.limit(0))).values()} == {0}


def test_spans_are_cut_or_rows_leave(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    items = spark.createDataFrame([(1, passage)], "item_id int, text string")
    docs = spark.createDataFrame([(1, "é start " + passage + " end." + " f" * 900), (2, passage), (3, "clean")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in remove_spans(match(docs, items)).collect()}
    assert out == {1: "é start  end." + " f" * 900, 3: "clean"}
