import itertools
import random
import re

import pytest

from panelwright.llm.components import components
from panelwright.llm.ngram_join import keep_one_of_each, near_duplicates, similar_pairs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(a, b):
    return 100 * len(a & b) >= 75 * len(a | b)


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(docs)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    pairs = {}
    for (p, (i, a)), (q, (j, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and linked(a, b):
            parent[find(q)] = find(p)
            if a != b:
                pairs[a, b] = len(a & b) / len(a | b)
    groups = {}
    for k in range(len(docs)):
        groups.setdefault(find(k), []).append(docs[k][0])
    return sorted((docs[k][0], len(sets[k][1]), min(groups[find(k)])) for k in range(len(docs))), pairs


def near_copies(rng, n_docs):
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 12, 40, 80, 200]))] for _ in range(12)]
    docs = []
    for i in range(n_docs):
        ws = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            at = rng.randrange(len(ws))
            ws[at : at + rng.choice([0, 1, 1, 2])] = [rng.choice(words)] * rng.choice([0, 1, 1])
            ws = ws or ["x"]
        if rng.random() < 0.4:
            ws = ws[: rng.randint(1, 25)] + passage
        docs.append((i * 3 % (3 * n_docs + 1), " ".join(ws) if rng.random() < 0.8 else "\n".join(ws).upper()))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    docs = near_copies(random.Random(seed), 260)
    want, pairs = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()) == want
    if seed == 1:
        sets = {i: shingles(t) for i, t in docs}
        got = {frozenset((sets[r.a], sets[r.b])): r.jaccard for r in similar_pairs(df).collect()}
        assert got == pytest.approx({frozenset(k): v for k, v in pairs.items()})


def test_short_texts_that_differ_at_an_end(spark):
    docs, rng = [], random.Random(7)
    for size in range(5, 14):
        for k in range(6):
            # pairs alone with their words (even frequencies), or with words from a small stock (uneven ones)
            ws = [f"s{size}k{k}w{i}" if k < 3 else f"c{rng.randrange(40)}" for i in range(size)]
            other = ([*ws[:-1], f"last{size}k{k}"], [f"first{size}k{k}", *ws[1:]], [*ws, f"more{size}k{k}"])[k % 3]
            docs += [(len(docs) + i, " ".join(t)) for i, t in enumerate((ws, other))]
    _, pairs = brute(docs)
    sets = {i: shingles(t) for i, t in docs}
    got = {frozenset((sets[r.a], sets[r.b])) for r in similar_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {frozenset(k) for k in pairs} and len(got) > 10


def test_rows_of_a_repeated_id_are_told_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    docs = [(1, a), (2, a), (2, b), (3, b + " end"), (4, "on its own"), (4, a)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == brute(docs)[0]
    assert sorted((r.doc_id, r.text) for r in keep_one_of_each(df).collect()) == [(1, a), (2, b), (4, "on its own")]


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(40000))
    docs = [(4, "a b"), (3, "A  b"), (9, "a b c"), (1, None), (2, ""), (5, " \n"), (7, long), (6, long + " end"), (8, "same one text of words"), (8, "same one text of words"), (10, "x y"), (10, "x y z")]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, n_shingles string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == brute(docs)[0]
    kept = sorted(r.doc_id for r in keep_one_of_each(df).collect())
    assert kept == [1, 2, 3, 5, 6, 8, 8, 9, 10, 10]
    assert near_duplicates(df.limit(0)).count() == 0
    with_null = spark.createDataFrame([(None, "p q r"), (3, "p q r"), (None, "z z"), (None, None)], "doc_id long, text string")
    assert sorted([(r.doc_id or 0, r.component_id or 0) for r in near_duplicates(with_null).collect()]) == [(0, 0), (0, 0), (0, 3), (3, 3)]
    assert keep_one_of_each(with_null).count() == 4


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    docs = []
    for i in range(400):
        ws = list(base)
        ws[rng.randrange(80)] = f"edit{i}"
        docs.append((i, " ".join(ws)))
    docs += [(1000 + i, " ".join(base[:56] + [f"own{i}_{j}" for j in range(15)])) for i in range(100)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(400)} == {0}
    assert all(got[i] == i for i in range(1000, 1100))


def test_components_of_a_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 150), (150, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lengthened_prefixes_verify_fewer_pairs(spark):
    from pyspark.sql import functions as F

    from panelwright.llm import ngram_join as nj

    # sets of words from one stock: many share a rare one or two, few are similar
    rng = random.Random(3)
    docs = [(i, " ".join(rng.sample([f"w{k}" for k in range(150)], 32))) for i in range(200)]
    docs += [(300 + i, docs[i][1] + " w7 tail") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    _, _, prefixes = nj._prepared(df, "doc_id", "text", 1)
    assert prefixes.agg(F.max("l")).first()[0] > 1
    many = nj._counted_pairs(nj._lengthened(prefixes)).count()
    one = nj._counted_pairs(nj._lengthened(prefixes.withColumn("l", F.lit(1)))).count()
    assert many < one / 2
    sets = {i: frozenset(t.split()) for i, t in docs}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] != sets[b] and linked(sets[a], sets[b])}
    assert {(r.a, r.b) for r in similar_pairs(df, size=1).collect()} == want and len(want) >= 10


def test_ranges_are_merged_one_by_one(spark, monkeypatch):
    from panelwright.llm import ngram_join as nj

    docs = near_copies(random.Random(5), 120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {tuple(r)[::2] for r in nj.shared_tokens(df, 5, 0).collect()}
    monkeypatch.setattr(nj, "RANGE_TOKENS", 50)
    small = nj.shared_tokens(df, 5, 5000)
    assert len({r.node for r in small.collect()}) == len({n for n, _ in whole})
    want, _ = brute(docs)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()) == want
