"""The corpus pipeline on the smallest table, stage by stage, against plain rules."""

from __future__ import annotations

import functools
import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from stratiq.llm.queries import piece_model

from .test_operators import SPACE, WORD, brute_components, targets

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    found = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, found[-1], DATA).write.parquet(str(folder / name))
        found.append(spark.read.parquet(str(folder / name)))
    return [df.toPandas() for df in found]


def test_stages(stages):
    docs, known, single, apart, mixed, encoded = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    for df in (known, single, apart, mixed):
        assert list(df.columns) == list(docs.columns)
    assert set(known.doc_id) == set(docs.doc_id)  # all have letters and a known language

    best = {}
    for i, t in sorted(zip(known.doc_id, known.text, strict=True)):
        norm = SPACE.sub("", t)
        if norm not in best or len(t) > best[norm][0]:
            best[norm] = (len(t), i)
    assert sorted(single.doc_id) == sorted(i for _, i in best.values())

    groups = brute_components(list(zip(single.doc_id, single.text, strict=True)), 5)
    assert sorted(apart.doc_id) == sorted(i for i, g in groups.items() if g[2])

    size = {i: len(WORD.findall(t)) for i, t in zip(apart.doc_id, apart.text, strict=True)}
    sources = sorted(set(apart.source))
    want = targets([sum(size[i] for i in apart.doc_id[apart.source == s]) for s in sources])
    times = Counter(mixed.doc_id)
    assert set(times) <= set(apart.doc_id) and max(times.values()) <= 3
    for s, target in zip(sources, want, strict=True):
        taken = sum(size[i] * times[i] for i in apart.doc_id[apart.source == s])
        assert abs(taken - target) <= max(size[i] for i in apart.doc_id[apart.source == s]) / 2  # whole documents are taken

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    assert Counter(encoded.doc_id) == times
    for t, ids, sha in zip(encoded.text, encoded.ids, encoded.decoded_sha256, strict=True):
        assert list(ids) == model.encode(t, add_bos=True, add_eos=True) and sha == hashlib.sha256(model.decode(list(ids)).encode()).hexdigest()


def test_odd_rows(spark):
    """An empty table, null columns, a further column, and one that is named like an output."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    step = lambda docs, stages: functools.reduce(lambda df, stage: stage[1](spark, df, DATA), stages, docs)
    none = step(spark.createDataFrame([], schema), corpus_pipeline.STAGES)
    assert none.count() == 0 and none.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    rows = [(i if i % 2 else None, f"the hand of word {i} and that of {i * i}" if i % 5 else [None, "", "12 34"][i % 3], "en" if i % 3 else None, "s" if i % 4 else None, None, "kept") for i in range(40)]
    docs = step(spark.createDataFrame(rows, schema), corpus_pipeline.STAGES[:-1])
    found = docs.collect()
    assert docs.columns[-1] == "extra" and found and all(r["extra"] == "kept" and r["text"].startswith("the hand") for r in found)
    with pytest.raises(ValueError, match="already"):
        corpus_pipeline.STAGES[-1][1](spark, docs.withColumnRenamed("extra", "ids"), DATA)
