"""One text of 20 MB without white space, among short ones."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from stratiq.llm import exact_dedup, language, near_dedup, pieces, suffix_dedup, token_counts
from stratiq.llm.queries import piece_model

SIZE = 20_000_000


@pytest.fixture(scope="module")
def long():
    return np.random.default_rng(0).choice(np.frombuffer(b"theandigors", np.uint8), SIZE).tobytes().decode()


@pytest.fixture(scope="module")
def docs(spark, long):
    return spark.createDataFrame([(1, "short text"), (2, long), (3, long[:150]), (4, None)], "doc_id long, text string").repartition(2).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_dedup(docs, long):
    near = by_id(near_dedup.components(docs, width=2))
    assert [near[i]["n_shingles"] for i in (1, 2, 3, 4)] == [1, 1, 1, 0] and all(r["kept"] for r in near.values())
    exact = by_id(exact_dedup.decide(docs))
    assert exact[2]["text_sha256"] == hashlib.sha256(long.encode()).hexdigest() and exact[2]["kept"]
    passages = by_id(suffix_dedup.digest(docs))
    assert (passages[2]["n_bytes"], passages[2]["n_removed"]) == (SIZE, 0) and (passages[3]["n_removed"], passages[3]["n_spans"]) == (150, 1)


def test_counts(docs, long):
    found = by_id(token_counts.count(docs, piece_model()))
    assert found[2]["n_pretokens"] == 1 and SIZE / 5 < found[2]["n_tokens"] < SIZE
    import sentencepiece

    ids = sentencepiece.SentencePieceProcessor(model_file=piece_model()).encode(long, add_bos=True, add_eos=True)
    got = by_id(pieces.digest(docs, piece_model()))[2]
    assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(long.encode()).hexdigest())


def test_language(docs, spark):
    model = language.fit(spark.createDataFrame([(1, "the hand", "en"), (2, "zzz qqq", "zq")], "doc_id long, text string, lang string"))
    found = by_id(language.annotate(docs, model))
    assert found[2]["lang_pred"] == "en" and found[4]["lang_pred"] == "und"
