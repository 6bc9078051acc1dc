import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import lexical_index as li

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return TERM.findall((t or "").translate(LOW))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    size = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(s > 0 for s in size), sum(size)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, t in items:
        wanted.setdefault(item, set()).update(terms(t))
    out = {}
    for item, own in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        found = []
        for (i, bag), n in zip(bags, size, strict=True):
            if n:
                m = 100 - 50 + (50 * n * n_docs) // n_terms
                found.append((-sum(weight[t] * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in own), i))
        ranked = [(i, -s) for s, i in sorted(found) if s < 0][:k]
        if ranked:
            out[item] = ranked
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r["rank"])):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = [f"w{i}" for i in range(30)] + ["é", "x1", "The"]
    make = lambda n: " ".join(rng.choice(letters[: rng.randint(3, 33)]) for _ in range(n))
    docs = [(i, make(rng.choice([0, 1, 5, 5, 5, 40, 300]))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # ties, and one length that many share
    items = [(i, make(rng.randint(0, 12))) for i in range(25)]
    got = li.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert ranked(got) == brute(docs, items, 7)


def test_edges(spark):
    long_text = "filler " * 60_000 + "needle"
    docs = [(1, "Needle in hay"), (2, None), (3, ""), (4, "?!"), (5, "needle NEEDLE"), (5, "needle NEEDLE"), (6, long_text), (7, "hay"), (None, "needle")]
    items = [("a", "needle"), ("a", "hay!"), ("b", None), ("c", ""), ("d", "unknown words"), (None, "HAY hay")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, block int")
    asked = spark.createDataFrame([(*i, 3) for i in items], "item_id string, text string, term int")
    got = ranked(li.search(frame, asked, k=50))
    # a null id comes last among equal scores
    want = brute([(10**9 if i is None else i, t) for i, t in docs], items, 50)
    assert {k: [(10**9 if i is None else i, s) for i, s in v] for k, v in got.items()} == want
    assert set(got) == {"a", None} and len(got["a"]) == 6


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert li.search(docs.limit(0), items).collect() == []
    none = li.search(docs, items.limit(0))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_without_a_sent_vocabulary_all_terms_are_indexed(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "c")], "doc_id long, text string")
    whole, some = li.build(docs, None), li.build(docs, np.zeros(0, np.int64))
    assert sorted(len(r.terms) for r in whole.blocks.collect()) == [1, 2]
    assert some.blocks.count() == 0 and (some.n_docs, some.n_terms) == (2, 4)


def test_strata_are_cut_into_blocks_whose_bound_holds():
    rng = np.random.default_rng(5)
    n = 3000
    rows = {
        "m": pa.array(np.sort(rng.integers(60, 62, n))),
        "doc_id": pa.array(np.arange(n)),
        "terms": pa.array([np.unique(rng.integers(0, 50, 6)) for _ in range(n)], pa.list_(pa.int64())),
    }
    rows["tfs"] = pa.array([rng.integers(1, 9, len(t)).astype(np.int32) for t in rows["terms"]], pa.list_(pa.int32()))
    (made,) = li._pack(iter([pa.RecordBatch.from_pydict(rows)]))
    assert made.num_rows == sum(-(-c // li.BLOCK_DOCS) for c in Counter(rows["m"].to_pylist()).values())
    entries = pa.table({"item_id": [1, 1, 2, 2], "term": pa.array([3, 4, 4, 77], pa.int64())})
    wanted = li.Wanted.of(entries)
    wanted.weight = np.array([5, 7, 9])
    bags = {d: dict(zip(t.as_py(), f.as_py(), strict=True)) for d, t, f in zip(range(n), rows["terms"], rows["tfs"], strict=True)}
    for r in made.to_pylist():
        block = li.Block(wanted, r["m"], np.array(r["terms"]), np.array(r["tops"]))
        ((some, dense),) = block.scores(np.arange(2), *(np.array(r[k]) for k in ("counts", "tfs", "sizes", "members")), len(r["ids"]))
        one = lambda d, t, m=r["m"]: 10**9 * bags[d].get(t, 0) // (1000 * bags[d].get(t, 0) + 20 * m)
        want = [[5 * one(d, 3) + 7 * one(d, 4) for d in r["ids"]], [7 * one(d, 4) for d in r["ids"]]]
        assert some.tolist() == [0, 1] and dense.tolist() == want
        assert (block.bounds >= dense.max(1)).all()
