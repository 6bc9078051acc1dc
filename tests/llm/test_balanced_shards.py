import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import balanced_shards as bs


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_allowed_moves_keep_capacities(seed):
    rng = random.Random(seed)
    k = rng.randint(2, 6)
    load = np.array([rng.randint(0, 30) for _ in range(k)], object)
    capacity = np.array([v + rng.choice([0, 0, 3, 50]) for v in load], object)
    wanted = np.zeros((k, k), object)
    for i in range(k):
        left = load[i]
        for j in range(k):
            if i != j:
                wanted[i, j] = rng.randint(0, left)
                left -= wanted[i, j]
    x = bs.allowed(wanted, load, capacity)
    assert (x >= 0).all() and (x <= wanted).all()
    assert (load + x.sum(0) - x.sum(1) <= capacity).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=7), st.integers(0, 60))
def test_dealt_stays_within_room_while_it_can(room, total):
    share = bs.dealt(total, np.array(room, object))
    assert share.sum() == total
    if total <= sum(room):
        assert all(0 <= s <= r for s, r in zip(share, room, strict=True))


def manifest(spark, texts, ids=None, **how):
    rows = [(i, t, 1, 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, row int")
    return bs.shard_documents(df, **how).collect()


def check(rows, texts, ids, shards):
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(shards)]
    return counts


def groups(rows):
    out = defaultdict(Counter)
    for r in rows:
        out[(r["size"], r.text_crc32)][r.shard] += 1
    return [c for c in out.values() if sum(c.values()) > 1]


def test_groups_stay_together_and_counts_are_even(spark):
    rng = random.Random(2)
    texts = [f"single {i}" for i in range(300)] + [f"group {g}" for g in range(60) for _ in range(rng.randint(2, 4))] + ["", None, "", None]
    rows = manifest(spark, texts, shards=7)
    counts = check(rows, texts, range(len(texts)), 7)
    assert max(counts) - min(counts) <= 1
    assert all(len(c) == 1 for c in groups(rows))


def test_a_group_beyond_a_shard_is_spread_over_as_few_as_it_needs(spark):
    texts = ["same"] * 200 + [f"pair {i // 2}" for i in range(100)] + [f"one {i}" for i in range(100)]
    rows = manifest(spark, texts, shards=8)  # 50 rows a shard
    counts = check(rows, texts, range(400), 8)
    assert counts == [50] * 8
    held = groups(rows)
    assert max(len(c) for c in held) <= 5
    assert sum(len(c) > 1 for c in held) <= 5


def test_all_rows_linked(spark):
    texts = ["a"] * 31 + ["b"] * 6
    rows = manifest(spark, texts, shards=4)
    counts = check(rows, texts, range(37), 4)
    assert max(counts) - min(counts) <= 1


def test_bytes_are_even_to_a_document(spark):
    rng = random.Random(3)
    texts = ["x" * rng.randint(0, 400) + str(i % 200) for i in range(400)] + ["y" * 200_000]
    rows = manifest(spark, texts, shards=4, law="bytes")
    check(rows, texts, range(401), 4)
    small = manifest(spark, texts[:-1], shards=4, law="bytes")
    sums = Counter()
    for r in small:
        sums[r.shard] += r["size"]
    assert max(sums.values()) - min(sums.values()) <= 2 * 410
    with pytest.raises(ValueError):
        manifest(spark, texts, shards=4, law="other")


def test_repeated_and_null_ids_and_small_tables(spark):
    texts, ids = ["a", "a", "b", None, "a"], [1, 1, 1, None, None]
    rows = manifest(spark, texts, ids, shards=16)
    counts = check(rows, texts, ids, 16)
    assert max(counts) <= 1
    assert manifest(spark, [], shards=3) == []
    assert [r.shard for r in manifest(spark, ["x", "y"], shards=1)] == [0, 0]


def test_files_hold_the_documents_of_their_shard(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i // 2}") for i in range(40)], "doc_id long, text string")
    made = bs.shard_documents(docs, shards=3)
    bs.write_shards(docs, made, str(tmp_path / "out"))
    back = {r.doc_id: (r.shard, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {r.doc_id: (r.shard, f"t{r.doc_id // 2}") for r in made.collect()}
    with pytest.raises(ValueError):
        bs.write_shards(docs, bs.shard_documents(docs.union(docs), shards=3), str(tmp_path / "no"))
