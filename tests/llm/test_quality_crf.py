import collections
import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import quality_crf as crf

SF = "/root/testdata/sf0.01"


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    sizes = [3, 0, 1, 5, 2]
    at = np.r_[0, np.cumsum(sizes)]
    score, tie = rng.normal(size=at[-1]), rng.normal(size=(2, 2))
    chains = crf.Chains(at)
    marginal, pairs, norm = chains.walk(score[chains.order], tie)
    got = np.zeros(at[-1])
    got[chains.order] = marginal
    want_pairs, want_norm = np.zeros((2, 2)), []
    for c in chains.chains[: sum(s > 0 for s in sizes)]:
        a, b = at[c], at[c + 1]
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = np.exp(sum(score[a + i] * v for i, v in enumerate(y)) + sum(tie[u, v] for u, v in itertools.pairwise(y)))
        z = sum(weights.values())
        want_norm.append(np.log(z))
        for i in range(b - a):
            assert got[a + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / z)
        for y, w in weights.items():
            for u, v in itertools.pairwise(y):
                want_pairs[u, v] += w / z
    assert pairs == pytest.approx(want_pairs)
    assert norm == pytest.approx(want_norm)


def test_latent_line_labels_match_enumeration():
    rng = np.random.default_rng(4)
    at = np.r_[0, np.cumsum([3, 1, 4, 0, 2])]
    owner = np.repeat(np.arange(5), np.diff(at))
    length, label = rng.uniform(1, 9, at[-1]), np.array([1, 0, 1, 0, 0])
    x, theta = rng.normal(size=(at[-1], 2)), rng.normal(size=6)
    chains = crf.Chains(at)
    weight = (length / np.bincount(owner, length, 5)[owner])[chains.order]

    def moved(theta):
        return chains.shares(x[chains.order] @ theta[:2], theta[2:].reshape(2, 2), weight, label[chains.chains])

    want = 0.0
    for d in (0, 1, 2, 4):
        a, b = at[d], at[d + 1]
        odds, good = 0.0, 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            p = np.exp(sum(x[a + i] @ theta[:2] * v for i, v in enumerate(y)) + sum(theta[2 + 2 * u + v] for u, v in itertools.pairwise(y)))
            odds += p
            good += p * (np.array(y) @ length[a:b]) / length[a:b].sum()
        want += np.log(good / odds if label[d] else 1 - good / odds)
    lines, pairs, got = moved(theta)
    assert got == pytest.approx(want)
    slope = [(moved(theta + 1e-6 * e)[2] - moved(theta - 1e-6 * e)[2]) / 2e-6 for e in np.eye(6)]
    assert np.r_[x[chains.order].T @ lines, pairs.ravel()] == pytest.approx(slope, abs=1e-6)


def test_junk_lines_inside_good_documents_are_found():
    rows = duckdb.sql(f"select doc_id, text, quality from '{SF}/documents.parquet' join '{SF}/labels.parquet' using (doc_id) where quality is not null order by 1").fetchall()
    lines = crf.lines_of(pa.array([t for _, t, _ in rows]))
    weight, tie = crf.learn(lines.features, lines.at, np.array([q for *_, q in rows]), lines.length)
    model, rng = crf.Crf(weight, tie, 0.5), random.Random(1)
    junk = [x for _, t, q in rows if q == 0 for x in (t or "").split("\n") if len(x.split()) >= 4]
    found, kept = [], []
    for _, t, q in rows:
        own = [x for x in (t or "").split("\n") if x.split()]
        if q == 1 and len(own) >= 4:
            at = rng.randrange(1, len(own))
            own.insert(at, rng.choice(junk))
            good = model.marginals(crf.lines_of(pa.array(["\n".join(own)]))) >= 0.5
            found.append(not good[at])
            kept += np.delete(good, at).tolist()
    assert len(found) > 30 and np.mean(found) > 0.7 and np.mean(kept) > 0.9
    costs = tie[0, 0] + tie[1, 1] - tie[0, 1] - tie[1, 0]
    assert costs < 5  # the ties hold neighbours together, not whole documents


def test_lines_and_neighbours():
    lines = crf.lines_of(pa.array(["LOUD $$ $$\n\nquiet words here", None, "", " \n\t", "x"]))
    assert lines.at.tolist() == [0, 2, 2, 2, 2, 3]
    own = dict(zip(crf.OWN, range(1, 1 + len(crf.OWN)), strict=True))
    assert lines.features[0, own["upper"]] == 1 and lines.features[1, own["upper"]] == 0
    begin = 1 + len(crf.OWN)
    assert lines.features[1, begin] == 1  # the line before is in capitals
    assert lines.features[0, begin + len(crf.NEIGHBOUR)] == 0  # the line after is not
    assert lines.features[:, -2:].tolist() == [[1, 0], [0, 1], [1, 1]]


def frames(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        ls = []
        for _ in range(rng.randint(1, 9)):
            ws = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(3, 20))]
            ls.append(" ".join(ws) + "." if good else " ".join(w + "$$" for w in ws))
        rows.append((i, "\n".join(ls)))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_planted_junk_is_found_held_out(spark):
    docs, labels = frames(spark)
    model = crf.train(docs, labels)
    got = {r.doc_id: r.score for r in crf.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and all((got[i] >= 0.3) == (i % 3 != 0) for i in held)
    mixed = spark.createDataFrame([(1, "fine words in a row.\n" * 9 + "a$$ b$$ c$$ d$$")], "doc_id long, text string")
    per_line = crf.line_labels(mixed, model).first().line_good
    assert len(per_line) == 10 and min(per_line[:8]) > 0.5 > per_line[9]


def test_edges(spark):
    docs, labels = frames(spark)
    model = crf.train(docs, labels)
    odd = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "word " * 60000, 9.0), (4, "a b\n" * 3000, 9.0), (5, "same", 9.0), (5, "same", 9.0)], "doc_id long, text string, score double")
    got = [r.score for r in crf.score(odd, model).orderBy("doc_id").collect()]
    assert got[0] == got[1] == model.prior and got[4] == got[5] and all(0 <= s <= 1 for s in got)
    assert crf.score(odd.limit(0), model).count() == 0
    assert crf.train(docs, labels.limit(0)).quality(pa.array(["a", ""])).tolist() == pytest.approx([0.5, 0.5])
    only_good = crf.train(docs, labels.where("quality = 1"))
    assert np.ptp(only_good.quality(pa.array(["a b", "$$ $$\n$$"]))) < 1e-9


def test_registered_query_on_held_out_fold(spark):
    from panelwright.llm.queries import op1_quality_crf

    truth = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    rows = op1_quality_crf(spark, SF).collect()
    assert len(rows) == 1000
    n = collections.Counter((truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth)
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.95 and n[0, 0] / (n[0, 0] + n[0, 1]) > 0.8
