"""Mixing with sources of so many blocks that a place times their number leaves 64 bits."""

from __future__ import annotations

from collections import Counter

from stratiq.llm import mixing


def many(spark):
    return spark.range(0, 5_200, 1, 4).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "if(id % 13 < 8, 'a', 'b') as source")


def test_mix_of_many_blocks(spark):
    """The fourth stage of the pipeline."""
    docs = many(spark)
    plan = mixing._planned(docs, "doc_id", "text", "source", (1, 2, 3), 3, 64, 7, 1, False)
    assert plan.selectExpr("max(_k)").first()[0] == 3_200 and plan.filter("_block < 0 or _block >= _k").isEmpty()
    got = Counter(r["doc_id"] for r in mixing.mix(docs, block_docs=1).collect())
    for source, low, high in (("a", 0, 8), ("b", 8, 13)):
        size = {i: 1 + i % 7 for i in range(5_200) if low <= i % 13 < high}
        want = sum(1 + i % 7 for i in range(5_200)) * {"a": 1, "b": 2}[source] / 3
        assert abs(sum(size[i] * got[i] for i in size) - want) <= 3.5 and max(got[i] for i in size) <= 3


def test_decide_of_many_blocks(spark):
    got = mixing.decide(many(spark), block_docs=1).collect()
    assert len(got) == 5_200 and all(r["taken"] == r["size"] * len(r["shards"]) and len(r["shards"]) <= 3 for r in got)
    for source in ("a", "b"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3.5
