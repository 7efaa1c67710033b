"""The registered queries on the smallest tables: columns, folds, and rows against plain rules or their operators' brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from stratiq.llm import queries

from .test_operators import SPACE, WORD, brute_components, brute_ranges, targets

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_token_counts": ["doc_id", "n_pretokens", "n_tokens"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken", "shards"],
    "op4_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op5_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_site_quality": ["doc_id", "text_score", "site_prior", "score", "kept"],
    "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op10_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op13_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
}
#: Queries over other tables than documents.
OTHERS = {
    "op11_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op12_conversation_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas().set_index("doc_id")


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for name, query in queries.queries().items():
        if name in OTHERS:
            continue
        df = query(spark, DATA)
        assert df.columns == COLUMNS[name]
        out[name] = df.toPandas().set_index("doc_id").sort_index()
    return out


def test_every_document_once(docs, results):
    assert results.keys() == COLUMNS.keys() and {*results, *OTHERS} == {*queries.queries()}
    for name, found in results.items():
        assert list(found.index) == sorted(docs.index), name


def test_held_out_folds(docs, results):
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    assert all(r.held_out == (fold(i, 5) == 0) for i, r in results["op1_toxicity"].iterrows())
    assert all(r.held_out == (fold(i, 4) == 2) for i, r in results["op6_language"].iterrows())
    found = results["op6_language"]
    assert np.mean([found.lang_pred[i] == docs.lang[i] for i in docs.index if found.held_out[i] and docs.lang[i]]) > 0.95


def test_mixing_near_targets(docs, results):
    found = results["op3_mixing"]
    size = {i: len(WORD.findall(t or "")) for i, t in docs.text.items()}
    assert dict(found["size"]) == size and all(r.taken == len(r.shards) * r["size"] <= 3 * r["size"] for _, r in found.iterrows())
    sources = sorted(set(docs.source))
    total = [sum(size[i] for i in docs.index[docs.source == s]) for s in sources]
    for s, n, want in zip(sources, total, targets(total), strict=True):
        rows = found[docs.source.reindex(found.index) == s]
        assert set(rows.source_size) == {n} and rows.target.to_numpy() == pytest.approx(want)
        assert abs(rows.taken.sum() - want) <= rows["size"].max() / 2


def test_near_groups(docs, results):
    want = brute_components(list(docs.text.items()), 2)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in results["op4_near_dedup"].iterrows()} == want


def test_pieces(docs, results):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    for i, r in results["op5_sentencepiece"].iterrows():
        ids = model.encode(docs.text[i] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_base_rules(docs, results):
    for i, r in results["op8_quality_rules"].iterrows():
        words = WORD.findall(docs.text[i] or "")
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)


def test_exact_copies(docs, results):
    norms = {i: SPACE.sub("", t or "") for i, t in docs.text.items()}
    sizes = Counter(norms.values())
    best = {}
    for i in sorted(docs.index):
        n = norms[i]
        if n not in best or len(docs.text[i] or "") > len(docs.text[best[n]] or ""):
            best[n] = i
    for i, r in results["op9_exact_dedup"].iterrows():
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best[norms[i]], sizes[norms[i]], best[norms[i]] == i, hashlib.sha256(norms[i].encode()).hexdigest())


def test_passages(docs, results):
    assert {i: tuple(r) for i, r in results["op10_suffix_dedup"].iterrows()} == brute_ranges(list(docs.text.items()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, results, name):
    """The rows that DuckDB finds, all columns."""
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries.queries()[name](spark, DATA) if name in OTHERS else None
    found = df.toPandas() if df is not None else results[name].reset_index()
    assert list(found.columns) == OTHERS.get(name, COLUMNS.get(name)) and sorted(found.columns) == sorted(columns)
    rows = lambda table: Counter(tuple(str(int(x)) if isinstance(x, (bool, np.bool_)) else str(x) for x in r) for r in table)
    assert rows(found[columns].itertuples(index=False)) == rows(want.fetchall())
