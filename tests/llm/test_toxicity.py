import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import toxicity as tox

SF = "/root/testdata/sf0.01"


def brute(text):
    flat = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if (48 <= b <= 57 or 97 <= b <= 122 or b > 127) else " " for b in (text or "").encode())
    out = set()
    for word in re.findall("[^ ]+", flat):
        padded = f" {word} "
        for n in tox.ORDERS:
            out |= {padded[i : i + n] for i in range(len(padded) - n + 1)}
    return out


def test_grams_match_brute_force(docs_rows):
    texts = ["", None, "a", "Ab cd", "été!", "x" * 400, *[t for _, t in docs_rows[:30]]]
    owner, feature = tox.grams(pa.array(texts))
    got = np.bincount(owner, minlength=len(texts))
    for i, t in enumerate(texts):
        want = len(brute(t))
        assert want * 0.99 - 1 <= got[i] <= want  # a few n-grams of a text may share a number
    assert got[:5].tolist() == [0, 0, 1, len(brute("Ab cd")), len(brute("été!"))]


def frames(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(500):
        ws = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        bad = i % 4 == 0
        if bad:
            ws.insert(rng.randrange(len(ws)), "grumpf" + rng.choice(["", "ed", "ing", "y"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_planted_stem_is_found_held_out(spark):
    docs, labels = frames(spark)
    model = tox.train(docs, labels)
    got = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    kept = {r.doc_id for r in tox.reject_toxic(docs, labels).collect()}
    assert {i for i in held if i % 4} <= kept and not {i for i in held if i % 4 == 0} & kept


def test_edges(spark):
    docs, labels = frames(spark)
    model = tox.train(docs, labels)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a" * 200000, "x"), (4, "grumpfy", "x"), (4, "grumpfy", "x")], "doc_id long, text string, score string")
    got = [r.score for r in tox.score(odd, model).orderBy("doc_id").collect()]
    assert got[0] == got[1] < 0.5 and got[3] == got[4] > 0.5 and 0 <= got[2] <= 1
    assert tox.score(odd.limit(0), model).count() == 0
    mixed = labels.selectExpr("doc_id", "if(doc_id = 3, null, toxic) toxic").union(spark.createDataFrame([(None, 1), (7, 9)], "doc_id long, toxic int"))
    assert 0 < tox.train(docs, mixed).scores(pa.array([""]))[0] < 0.5
    assert tox.train(docs, labels.limit(0)).scores(pa.array(["a b"])).tolist() == pytest.approx([0.5])
    assert len(set(tox.train(docs, labels.where("toxic = 0")).scores(pa.array(["grumpf", "b"])).tolist())) == 1


def test_registered_query_on_held_out_fold(spark):
    from panelwright.llm.queries import op10_toxicity

    truth = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    rows = op10_toxicity(spark, SF).collect()
    assert len(rows) == 1000
    n = collections.Counter((truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth)
    assert n[0, 0] / (n[0, 0] + n[0, 1]) > 0.95
