import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import pitman_yor as py

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


def brute(docs):
    count = collections.Counter(t for i, x in docs if not held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    out = []
    for i, x in docs:
        ts = tokens(x)
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        out.append((i, held(i), len(ts), sum(count[t] > 0 for t in ts), n, base))
    return out


def columns(r):
    return r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens


def test_counts_and_base_match_brute_force_and_model_is_better(spark, docs_rows):
    got = sorted(py.score_documents(spark.createDataFrame(docs_rows, "doc_id long, text string")).collect())
    want = sorted(brute(docs_rows))
    assert [columns(r) for r in got] == [w[:5] for w in want]
    assert [r.base_score for r in got] == pytest.approx([w[5] for w in want])
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)


def test_edges(spark, monkeypatch):
    docs = [(0, None), (1, ""), (2, "A a  a"), (3, "word " * 50000), (4, "same row"), (4, "same row"), (4, "other row"), (None, "null id"), (5, "ünï çödé\x1c")]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, score double")
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    for share in (py.SENT_SHARE, 0.9):  # with and without pairs known to all tasks
        monkeypatch.setattr(py, "SENT_SHARE", share)
        got = py.score_documents(df).collect()
        assert order((*columns(r), round(r.base_score, 6)) for r in got) == order((*w[:5], round(w[5], 6)) for w in brute(docs))
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert py.score_documents(df.limit(0)).count() == 0
    only_held = [i for i in range(60) if held(i)][:3]
    alone = py.score_documents(spark.createDataFrame([(i, "x y") for i in only_held], "doc_id long, text string")).collect()
    assert {(r.n_known, r.train_tokens) for r in alone} == {(0, 0)} and all(r.score <= 0 for r in alone)


def seating(n_words=40, seed=3):
    rng = np.random.default_rng(seed)
    pairs, customers = [], []
    for w in range(n_words):
        for z in range(5):
            c = int(rng.zipf(1.6)) % 400
            if c:
                pairs.append((w << 8) | z)
                customers.append(c)
    return py.Seating(np.array(pairs, np.uint64), np.array(customers, np.int64), seed)


def test_probabilities_of_a_context_sum_to_one():
    s = seating()
    for _ in range(4):
        s.sweep(s.totals(1.0))
    t = s.totals(1.0)
    present = s.probabilities(t)
    parent = s.upper_share(t)
    unknown = (py.CONCENTRATION + t.parent_discount * t.parent_tables) / (t.words + 1) / (py.CONCENTRATION + t.parent_customers)
    assert parent.sum() + unknown == pytest.approx(1)
    for z in range(5):
        mine = s.context == z
        mass = (py.CONCENTRATION + t.discount * t.tables[z]) / (py.CONCENTRATION + t.customers[z])
        absent = np.setdiff1d(np.arange(len(s.first)), s.word[mine])
        assert present[mine].sum() + mass * (parent[absent].sum() + unknown) == pytest.approx(1)


def test_tables_follow_customer_by_customer_seating():
    rng = np.random.default_rng(5)
    discount, weight, customers = 0.6, 3.0, 200
    slow = []
    for _ in range(3000):
        tables = 1
        for seated in range(1, customers):
            tables += rng.random() < weight / (seated - discount * tables + weight)
        slow.append(tables)
    fast = py.opened(np.random.default_rng(6), np.full(3000, customers), np.full(3000, weight), discount)
    assert np.mean(fast) == pytest.approx(np.mean(slow), rel=0.04) and np.std(fast) == pytest.approx(np.std(slow), rel=0.15)
    assert py.opened(rng, np.array([0, 1, 2]), np.ones(3), 0.5)[:2].tolist() == [0, 1]


def test_contexts_follow_the_word_before():
    word, context, at = py.tokens_of(pa.array(["running sitting A", None, "running"]))
    assert at.tolist() == [0, 4, 5, 7] and context[0] == context[4] == context[5] == 0
    assert context[1] == context[2] == context[6] and word[3] == word[4] == word[6] and word[0] == word[5]


def test_scores_do_not_depend_on_partitions(spark, docs_rows, monkeypatch):
    monkeypatch.setattr(py, "RANGE_BYTES", 100_000)
    df = spark.createDataFrame(docs_rows, "doc_id long, text string")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for tasks in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            found.append(sorted((r.doc_id, r.score) for r in py.score_documents(df.repartition(int(tasks))).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [i for i, _ in found[0]] == [i for i, _ in found[1]]
    assert [x for _, x in found[0]] == pytest.approx([x for _, x in found[1]], rel=1e-9)


def test_words_before_with_one_ending_keep_their_own_successors(spark):
    ids = [i for i in range(400) if not held(i)][:200]
    new = [i for i in range(400, 900) if held(i)][:4]
    rows = [(i, ("rowing boat" if i % 2 else "sewing shirt") + f" u{i}") for i in ids]
    asked = ["rowing boat", "rowing shirt", "sewing shirt", "sewing boat"]
    rows += list(zip(new, asked, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r.doc_id: r.score for r in py.score_documents(df).collect()}
    own, other, own2, other2 = (score[i] for i in new)
    assert own > other + 1 and own2 > other2 + 1


def followers(seed=4):
    rng = np.random.default_rng(seed)
    rows = {}
    for w in range(30):
        for u in range(12):
            c = int(rng.zipf(1.6)) % 300
            if c:
                rows[((w << 8) | u % 4, u)] = c
    keys = sorted(rows)
    return py.Followers(np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.uint32), np.array([rows[k] for k in keys], np.int64), seed)


def test_probabilities_after_a_word_sum_to_one():
    s = followers()
    for _ in range(4):
        s.sweep(s.classes.totals(1.0), s.sizes()[1])
    t, (customers, tables) = s.classes.totals(1.0), s.sizes()
    assert s.classes.customers.tolist() == np.bincount(s.group, s.tables).tolist()
    assert (s.tables <= s.customers).all() and (s.tables >= 1).all() and s.tables.sum() < s.customers.sum()
    present, upper = s.probabilities(t, customers, tables), s.classes.probabilities(t)
    unknown = (py.CONCENTRATION + t.parent_discount * t.parent_tables) / (t.words + 1) / (py.CONCENTRATION + t.parent_customers)
    for k in range(len(s.contexts)):
        mine, z = s.context == k, int(s.contexts[k]) & 255
        of_class = (py.CONCENTRATION + t.discount * t.tables[z]) / (py.CONCENTRATION + t.customers[z])
        words = {int(s.classes.word[p]): upper[p] for p in np.flatnonzero(s.classes.context == z)}
        parent = [words.get(w, of_class * s.classes.upper_share(t)[w]) for w in range(len(s.count))]
        absent = np.setdiff1d(np.arange(len(s.count)), s.word[mine])
        mass = (py.CONCENTRATION + t.own_discount * tables[k]) / (py.CONCENTRATION + customers[k])
        assert present[mine].sum() + mass * (sum(parent[w] for w in absent) + of_class * unknown) == pytest.approx(1)


def test_sizes_of_contexts_are_summed_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(py, "RANGE_BYTES", 20)
    texts = ["a b", "a c d", "a b e f", "a g h i j k", "b a a b"] * 3
    model = py.Model(spark.createDataFrame([(t, True) for t in texts], "text string, train boolean"))
    assert model.parts > 3
    found = {}
    for row in model.counts.collect():
        s, (customers, tables) = py._followers(row.asDict()), py._sizes(row.asDict())
        for k, c, t in zip(s.contexts.tolist(), customers.tolist(), tables.tolist(), strict=True):
            assert found.setdefault(k, (c, t)) == (c, t)
    follows = collections.Counter(u for t in texts for u in [None, *t.split()])
    assert sorted(c for c, _ in found.values()) == sorted(follows.values())
    assert all(1 <= t <= c for c, t in found.values())
