import collections
import re

import pytest

from panelwright.llm import rule_ledger as rl

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    wins = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    n = collections.Counter(wins)
    covered = {p for i, x in enumerate(wins) if n[x] > 1 for p in range(i, i + 5)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), lines, dup, len(covered)


def columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words


def test_measures_match_brute_force(spark, docs_rows):
    df = spark.createDataFrame(docs_rows, "doc_id long, text string")
    for r in rl.ledger(df).collect():
        assert columns(r) == brute(r.text), r.doc_id


HARD = ["", " \n\t ", "a", "a b c d e a b c d e", "x x x x x x", "l 1\nl 1\n\n l 1\nl 1", "é ü z 日本 | $$ <b>", "a " * 5000, "\x1ca\x1f b\x0bc"]


def test_edges(texts):
    df = texts(*HARD, None, "same", "same", extra="n_words")
    got = rl.ledger(df).orderBy("doc_id").collect()
    assert [columns(r) for r in got] == [brute(t) for t in [*HARD, None, "same", "same"]]
    assert got[0].fail_bits == 1 and got[0].note if "note" in got[0] else True
    assert rl.ledger(df.limit(0)).count() == 0


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good), (2, good + " $$$$$ ||||||"), (3, "$$$ |||"), (4, "same line of words\n" * 9)]
    book = rl.ledger(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    kept = {r.doc_id: r.kept for r in rl.apply_policy(book, rl.POLICIES["base"]).collect()}
    assert kept == {1: True, 2: True, 3: False, 4: False}
    out = {r.rule: r for r in rl.ablation(book, rl.POLICIES["v2"]).collect()}
    assert out["many_symbols"].n_failed == 2 and out["many_symbols"].n_failed_alone == 1
    assert out["many_symbols"].n_kept_without == 2 and out["few_words"].n_kept_without == 1
    assert {r.n_rows for r in out.values()} == {4}
    assert rl.ablation(book.limit(0), rl.POLICIES["v2"]).count() == 0


def test_bits_are_distinct(texts):
    twice = (rl.Rule("a", 0, "n_words < 1"), rl.Rule("b", 0, "n_words < 2"))
    with pytest.raises(ValueError):
        rl.ledger(texts("a"), twice)
