import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelwright.llm.bpe_stream import Codec, Decoder, Encoder, Transducer, decode, encode, round_trip, sufficient_lookahead
from panelwright.llm.vocabulary import ByteBpe

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def codec():
    return Codec(open(FILE, "rb").read())


def digest(raw):
    return hashlib.sha256(raw).hexdigest()


def test_round_trip_matches_library(spark, library, docs_rows):
    df = spark.createDataFrame(docs_rows, "doc_id long, text string")
    for r in round_trip(df, FILE).collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == digest(np.array(ids, "<u4").tobytes())
        assert r.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False).encode())


HARD = ["", " ", "a" * 3001, "ab" * 9000, "\n\n \t a  b", "x<|endoftext|>y<|endoftext|>", "日本語 ñé's we'll", "\x00\x1f ‍🙂" * 50, "=" * 20001]


def test_edges(texts, library):
    df = texts(*HARD, None, "same", "same", extra="n_tokens")
    got = round_trip(df, FILE).orderBy("doc_id").collect()
    for r, t in zip(got, [*HARD, None, "same", "same"], strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(np.array(ids, "<u4").tobytes())), t
        assert r.decoded_sha256 == digest((t or "").encode())
    assert round_trip(df.limit(0), FILE).count() == 0
    back = decode(encode(df, FILE), FILE, "ids", "back").orderBy("doc_id").collect()
    assert [r.back for r in back] == [*HARD, "", "same", "same"]


def random_merges(rng, letters, size):
    symbols = [bytes([c]) for c in letters]
    merges = []
    while len(merges) < size:
        a, b = rng.choice(symbols), rng.choice(symbols)
        if a + b not in symbols and len(a + b) <= 12:
            merges.append((a, b))
            symbols.append(a + b)
    ids = {s: i for i, s in enumerate(symbols)}
    byte_id = np.zeros(256, np.int64)
    for c in letters:
        byte_id[c] = ids[bytes([c])]
    col = lambda f: np.array([ids[f(m)] for m in merges], np.int64)
    return merges, ByteBpe(col(lambda m: m[0]), col(lambda m: m[1]), col(lambda m: m[0] + m[1]), symbols, byte_id, {})


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_stable_tokens_equal_the_whole(seed):
    rng = random.Random(seed)
    merges, bpe = random_merges(rng, b"ab" if seed % 2 else b"abc", rng.randint(1, 25))
    rules = Transducer(bpe)
    assert rules.lookahead == sufficient_lookahead(merges)
    text = bytes(rng.choice(b"ab" if seed % 2 else b"abc") for _ in range(400))
    encoder = Encoder(rules, block=rng.randint(1, 9))
    got, held = [], 0
    for i in range(0, len(text), 5):
        got += encoder.feed(text[i : i + 5])
        held = max(held, len(encoder._buffer))
    assert got + encoder.finish() == rules.tokens(text)
    assert held <= rules.lookahead + 2 * 9


def test_naive_and_heap_agree(codec):
    rng = random.Random(3)
    for _ in range(200):
        raw = bytes(rng.choice(b"etaoin shr") for _ in range(rng.randint(1, 24)))
        assert codec.rules.tokens(raw) == codec.rules._by_heap([codec.rules.byte_id[b] for b in raw])


def test_decoder_state(library, codec):
    ids = library.encode("naïve 🙂 日本", add_special_tokens=False).ids
    one_by_one = Decoder(codec.rules.symbol)
    parts = [one_by_one.feed(np.array([i])) for i in ids] + [one_by_one.finish()]
    assert "".join(parts) == "naïve 🙂 日本"
    broken = [*ids[:-1], 64, *ids[3:6], 222, 64]
    one_by_one = Decoder(codec.rules.symbol)
    got = "".join([one_by_one.feed(np.array([i])) for i in broken]) + one_by_one.finish()
    assert got == library.decode(broken, skip_special_tokens=False)
    with pytest.raises(IndexError):
        one_by_one.feed(np.array([10**6]))
