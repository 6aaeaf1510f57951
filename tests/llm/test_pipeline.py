"""The pipeline's stages on a small corpus with planted cases, each on its own input, against plain loops where they are exact."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sentrel.llm import decontaminate

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, spans string"


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(12)

    def prose(n):
        return " ".join(f"w{rnd.randrange(4000)}" for _ in range(n))

    passage = prose(70)
    texts = [prose(150) for _ in range(20)] + [None, "", "x"]
    near = [t.split() for t in texts[:5]]
    for words in near:
        words[rnd.randrange(len(words))] = "changed"
    texts += [" ".join(w) for w in near]  # 23 to 27: near copies of 0 to 4
    texts += [texts[7], texts[7]]  # 28, 29: copies of 7
    texts += [prose(20) + "\n" + passage + "\n" + prose(30) for _ in range(3)]  # 30 to 32: a shared passage
    return [(i, t, "en", "s", len(t or ""), "kept", "kept", "kept") for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, COLUMNS)


def test_stages_of_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-dedup", "benchmark decontamination", "BPE encoding and decoding"]


def test_near_copies_go_and_others_stay(spark, docs):
    stay = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    assert not stay & {23, 24, 25, 26, 27, 28, 29} and {*range(20), 30, 31, 32} <= stay


def test_later_copies_of_a_passage_go(spark, docs, corpus):
    out = {r["doc_id"]: r for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    passage = corpus[30][1].split("\n")[1]
    assert passage in out[30]["text"] and passage not in out[31]["text"] and passage not in out[32]["text"]
    assert all(out[i]["text"] == corpus[i][1] for i in range(20)) and out[31]["n_chars"] == len(out[31]["text"])


def test_columns_stay(spark, docs, tmp_path):
    """Each stage returns the columns of documents, whatever they are called; empty tables pass."""
    rows = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns
            assert out.where("fp <> 'kept' OR score <> 'kept' OR spans <> 'kept'").count() == 0


def test_benchmark_passages_are_cut(spark, docs, corpus, tmp_path):
    words = corpus[9][1].split()
    spark.createDataFrame([(1, " ".join(words[40:60]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path)).collect()}
    assert decontaminate.words_of(out[9]) == decontaminate.words_of(" ".join(words[:40] + words[60:])) and out[8] == corpus[8][1]


def test_run_ends_with_tokens(spark, docs, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([(1, "none of these words occur there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert {r["doc_id"] for r in out.where(F.col("n_tokens") > 10).collect()} >= {*range(5, 20), 30}
