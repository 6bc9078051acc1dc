import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelwright.llm.token_counts import TokenCounter, merged_sizes, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_whole_documents_match_library(spark, library, docs_rows):
    df = spark.createDataFrame(docs_rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in token_counts(df, FILE).collect()}
    for doc_id, text in docs_rows:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert got[doc_id] == (n, len(text.encode()), n > 1024)


HARD = ["", " ", "a" * 3001, "ab" * 2000, "\n\n \t a  b", "x<|endoftext|>y<|endoftext|>", "<|endoftext|", "日本語 ñé's we'll", "\x00\x1f ‍🙂", "  lead and trail  "]


def test_edges(texts, library):
    df = texts(*HARD, None, "same", "same", extra="n_tokens")
    got = token_counts(df, FILE).orderBy("doc_id").collect()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in [*HARD, None, "same", "same"]]
    assert [r.n_tokens for r in got] == want
    assert token_counts(df.limit(0), FILE).count() == 0


def test_long_text_is_cut_at_safe_places(library):
    counter = TokenCounter(open(FILE, "rb").read())
    counter._cut._piece = 7
    text = "one two  three\n\nfour<|endoftext|> five's\t\tsix " * 40
    assert counter.counts([text])[0] == len(library.encode(text, add_special_tokens=False).ids)


def test_overlapping_pairs_merge_left_to_right():
    class Table:
        made = np.array([5, 6])

        def ranks(self, left, right):
            out = np.full(len(left), np.iinfo(np.int64).max)
            out[(left == 1) & (right == 1)] = 0
            out[(left == 5) & (right == 5)] = 1
            return out

    runs = [1, 2, 3, 4, 5, 6, 7, 8]
    starts = np.cumsum([0, *runs[:-1]])
    got = merged_sizes(Table(), np.ones(sum(runs), np.int64), starts)
    assert got.tolist() == [1, 1, 2, 1, 2, 2, 3, 2]
