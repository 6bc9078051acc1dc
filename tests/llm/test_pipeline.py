import hashlib
import importlib
import re

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import test_line_dedup, test_ngram_join
from tests.llm.test_decontamination import brute as contamination

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    pipe = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [("documents", docs.cache())]
    for name, stage in pipe.STAGES:
        tables.append((name, stage(spark, tables[-1][1], SF).cache()))
    return tables


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_match_brute_force_on_their_input(stages):
    tables = dict(stages)
    columns = tables["documents"].columns
    assert all(t.columns == columns for name, t in stages[:-1])
    before = rows(tables["documents"])
    clean = rows(tables["toxicity"])
    toxic = {i for (i,) in duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where toxic = 0").fetchall()}
    assert set(clean) <= set(before) and toxic & {i for i, _ in before} <= {i for i, _ in clean}

    lines = rows(tables["line_dedup"])
    gone = test_line_dedup.brute(clean)
    want = []
    for i, text in clean:
        ls = text.split("\n")
        words = [k for k, line in enumerate(ls) if re.search(r"[^\x20\x09-\x0D]", line)]
        lost = set(gone.get(i, []))
        if not lost or len(lost) < len(words):
            want.append((i, "\n".join(line for k, line in enumerate(ls) if k not in lost)))
    assert lines == sorted(want)
    assert all(r.n_chars == len(r.text) for r in tables["line_dedup"].collect() if r.doc_id in gone)

    joined = rows(tables["ngram_join"])
    groups, _ = test_ngram_join.brute(lines)
    assert [i for i, _ in joined] == [i for i, _, c in groups if i == c]

    items = [(str(i), t) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    checked = rows(tables["decontamination"])
    want = []
    for i, t in joined:
        n, hit, _ = contamination(t, items)
        if not (hit and 20 * len(hit) >= n):
            want.append((i, t))
    assert checked == want

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = {r.doc_id: r for r in tables["bpe_round_trip"].collect()}
    assert sorted(last) == [i for i, _ in checked]
    for i, t in checked:
        assert last[i].n_tokens == len(library.encode(t, add_special_tokens=False).ids)
        assert last[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_kept_documents_lose_benchmark_spans(spark, tmp_path):
    pipe = importlib.import_module("corpus_pipeline")
    passage = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, f"start {passage} end" + " filler" * 900, 7), (2, passage, 7), (3, "clean", 7), (4, None, None)]
    out = pipe.decontamination_stage(spark, spark.createDataFrame(docs, "doc_id long, text string, n_chars long"), str(tmp_path))
    want = "start  end" + " filler" * 900
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, want, len(want)), (3, "clean", 7), (4, None, None)]


def test_odd_rows_pass_through(spark, tmp_path):
    pipe = importlib.import_module("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    odd = [(1, None, "en", "s", None, "x"), (2, "", "en", "s", 0, "x"), (None, "null id stays here", None, None, None, None), (3, "a few plain words", "en", "s", 17, "x")]
    for name, rows_, kind in (("documents", odd, schema), ("labels", [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, None)], "item_id long, text string")):
        spark.createDataFrame(rows_, kind).write.parquet(f"{tmp_path}/a/{name}.parquet")
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/b/{name}.parquet")
    out = pipe.run(spark, f"{tmp_path}/a").collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in out) == [(0, True), (1, False), (2, False), (3, True)]
    assert pipe.run(spark, f"{tmp_path}/b").count() == 0
