"""The training-data operators against brute force, with null, empty, long, tied and repeated rows."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiq.llm import common, exact_dedup, language, mixing, near_dedup, pieces, quality_rules, site_quality, suffix_dedup, token_counts, toxicity
from stratiq.llm.queries import piece_model

SCHEMA = "doc_id long, text string, lang string, source string, _row string, score double"
WORDS = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when".split()
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed: int = 0, n: int = 60) -> list[str | None]:
    draw = random.Random(seed)
    base = [" ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(draw.randrange(5, 90))) for _ in range(n)]
    out: list[str | None] = list(base)
    for i in range(0, n, 3):  # near copies, exact copies, copies but for white space
        words = base[i].split()
        words[draw.randrange(len(words))] = "changed"
        out += [" ".join(words), base[i], base[i].replace(" ", "\n")]
    passage = " ".join(draw.choice(WORDS) for _ in range(60))
    out += [f"{t[:200]} {passage} {t[200:]}" for t in base[:12]]
    out += [None, "", "", " \t\n", "x", "x", "Word", "word ", "one two", "one two", "é ü ß 日本 😀", "a" * 5000, "ab " * 3000]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", "s1", None][i % 4], "clash", float(i)) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows + [rows[0], rows[5]], SCHEMA).repartition(3)  # two repeated rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# 9


def test_exact_dedup(docs, rows):
    all_ = rows + [rows[0], rows[5]]
    groups = defaultdict(list)
    for r in all_:
        groups[SPACE.sub("", r[1] or "")].append(r)
    want = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0]))
        sha, seen = hashlib.sha256(norm.encode()).hexdigest(), False
        for r in members:
            kept = r[0] == best[0] and not seen
            seen |= kept
            want[(r[0], best[0], len(members), kept, sha)] += 1
    assert bag(exact_dedup.decide(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_dedup_splits_hot_texts(spark):
    """A hot text is split row by row, also where its rows share an id or have none."""
    rows = [(i, "same  text" if i % 3 else f"own {i}") for i in range(600)] + [(7, "same text")] * 300 + [(None, "sametext")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({"hot_share": 4}, {"hot_rows": 70}):
        got = exact_dedup.decide(df, **options)
        assert got.filter("kept").count() == 201
        assert got.filter("group_size = 1000 and keep_id = 1").count() == 1000
        kept = exact_dedup.deduplicate(df, **options)
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, *range(0, 600, 3)])


def test_exact_dedup_keeps_columns(docs, empty):
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == exact_dedup.decide(docs).filter("kept").count()
    assert exact_dedup.decide(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


# 4


def shingles(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_components(rows, width, percent=80):
    sets = {r[0]: shingles(r[1], width) for r in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if i < j and sets[i] and sets[j] and label[i] != label[j]:
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * len(sets[i] | sets[j]):
                        low, high = sorted((label[i], label[j]))
                        label = {k: low if v == high else v for k, v in label.items()}
                        changed = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(docs, rows, width):
    want = brute_components(rows, width)
    got = near_dedup.components(docs, width=width).collect()
    assert len(got) == len(rows) + 2
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_near_dedup_beside_the_hub(spark):
    """Copies of which many are not linked to the hub, but to each other."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(draw.choice((1, 4, 9, 10, 11, 12))):
            words[draw.randrange(len(words))] = f"x{draw.randrange(9)}"
        rows.append((i, " ".join(words)))
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components(rows, 2)


def test_near_dedup_null_ids_and_columns(spark, docs, empty):
    df = spark.createDataFrame([(None, "a b c d e f g"), (3, "A b c d e f g"), (None, "lone words here"), (4, None)], "doc_id long, text string")
    assert bag(near_dedup.components(df, width=2), "doc_id", "component_id", "kept") == Counter({(None, 3, False): 1, (3, 3, True): 1, (None, None, True): 1, (4, 4, True): 1})
    assert bag(near_dedup.deduplicate(df, width=2), "doc_id", "text") == Counter({(3, "A b c d e f g"): 1, (None, "lone words here"): 1, (4, None): 1})
    assert near_dedup.components(empty).count() == 0
    assert near_dedup.deduplicate(docs).columns == docs.columns


def test_near_dedup_splits_hot_keys(spark, docs, rows, monkeypatch):
    """The same groups where every second key is looked up by broadcast and hubs are cut to parts of two pairs."""
    monkeypatch.setattr(common, "hot_keys", functools.partial(common.hot_keys, least=1, most=1))
    monkeypatch.setattr(near_dedup, "PAIRS", 2)
    got = near_dedup.components(docs, width=2).collect()
    assert len(got) == len(rows) + 2
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components(rows, 2)


# 3


def targets(sizes, weights=(1, 2, 3), most=3):
    """Rounds of sharing: what a source can't take goes to the others by weight."""
    want, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = sum(sizes) - sum(want[i] for i in range(len(sizes)) if i not in open_)
        level = left / sum(weights[i % len(weights)] for i in open_)
        over = {i for i in open_ if level * weights[i % len(weights)] > most * sizes[i]}
        for i in over or open_:
            want[i] = min(most * sizes[i], level * weights[i % len(weights)])
        if not over:
            break
        open_ -= over
    return want


def test_targets(spark):
    for sizes in ([100, 100, 100], [1000, 1000, 10], [0, 0], [5, 0, 7, 900, 20, 20, 3], []):
        names = ["B", "a", "b", "c", "d", "e", None][: len(sizes)]
        got = mixing.targets(spark.createDataFrame(list(zip(names, sizes, sizes, strict=True)), "_source string, _n long, _docs long"), (1, 2, 3), 3).orderBy("_s").collect()
        assert [r["_source"] for r in got] == names and [r["_target"] for r in got] == pytest.approx(targets(sizes))


def test_split_tree_is_exact():
    quotas = np.array([7, 0, 100, 13])
    shares = mixing.even(int(quotas.sum()), 5)
    found = mixing.split_tree(quotas, shares, (1,))
    assert (found.sum(axis=0) == quotas).all() and (found.sum(axis=1) == shares).all() and (found >= 0).all() and np.ptp(shares) <= 1
    assert (found == mixing.split_tree(quotas, shares, (1,))).all()


@pytest.mark.parametrize("group, few", [(4096, 2000), (2, 1)])
def test_mixing(spark, monkeypatch, group, few):
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    draw = random.Random(2)
    rows = [(i, " ".join(["w"] * draw.randrange(1, 60)), ["a", "b", "B", None][min(3, draw.randrange(6))]) for i in range(1200)] + [(5000, None, "a"), (5001, "", None), (5002, "w", "small"), (5003, "", "small"), (5004, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.decide(df, block_docs=64).collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    sources = sorted({r[2] for r in rows if r[2]}) + [None]
    total = {s: sum(size[r[0]] for r in rows if r[2] == s) for s in sources}
    want = dict(zip(sources, targets([total[s] for s in sources]), strict=True))
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[r["source"]]) and r["target"] == pytest.approx(want[r["source"]])
        assert len(r["shards"]) <= 3 and r["taken"] == len(r["shards"]) * r["size"] and all(0 <= s < 64 for s in r["shards"])
        taken[r["source"]] += r["taken"]
    for s in sources:
        assert abs(taken[s] - want[s]) <= 30
    assert bag(mixing.decide(df, block_docs=64), "doc_id", "taken") == Counter((r["doc_id"], r["taken"]) for r in got)
    mixed = mixing.mix(df, block_docs=64)
    assert mixed.columns == df.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: len(r["shards"]) for r in got if r["shards"]})


def test_mixing_shards_are_the_trees_runs(spark):
    """Of whole blocks, each shard holds as many of each source as the tree gives it, in runs that meet no other's."""
    rows = [(i, "one two three", "abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.decide(df, block_docs=20, shards=7).collect()
    planned = mixing._planned(df, "doc_id", "text", "source", (1, 2, 3), 3, 7, 7, 20, False).select("_id", "_source", "_k", "_block", "_passes", "_cuts", "_shards").collect()
    assert {r["_id"]: list(r["_shards"]) for r in planned} == {r["doc_id"]: list(r["shards"]) for r in got}
    cuts = {r["_source"]: list(r["_cuts"]) for r in planned}
    for source, ends in cuts.items():
        held = defaultdict(set)
        for r in planned:
            if r["_source"] == source:
                for t, shard in enumerate(r["_shards"]):
                    held[shard].add(t * r["_k"] + r["_block"])
        starts = [0, *ends[:-1]]
        for shard, (a, b) in enumerate(zip(starts, ends, strict=True)):
            assert held[shard] <= set(range(a, b)) and len(set(range(a, b)) - held[shard]) <= 1  # a last block may give nothing
    sums = [sum(c[k] - (c[k - 1] if k else 0) for c in cuts.values()) for k in range(7)]
    assert max(sums) - min(sums) <= 1  # quotas are dealt evenly


def test_mixing_without_ids(spark):
    """Half of the rows without id, among them copies: every source comes within half a document of its target."""
    rows = [(None if i % 2 else i, "word " * (10 if i % 4 else 30) if i % 3 else f"own {i} " * 9, "abc"[i % 3 and (i % 6 > 2) + 1]) for i in range(6000)]
    found = mixing.decide(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), block_docs=16)
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("size")).collect():
        assert abs(r["taken"] - r["target"]) <= r["size"] / 2, r


def test_mixing_edges(docs, empty):
    assert mixing.decide(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.decide(docs).count() == docs.count() and mixing.mix(docs).columns == docs.columns


# 5 and 2


def test_pieces_equal_the_library(docs, rows, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = {r["doc_id"]: r for r in pieces.encode(docs.drop("score"), piece_model(), digests=True, table_size=50).collect()}
    for r in rows:
        ids = model.encode(r[1] or "", add_bos=True, add_eos=True)
        found = got[r[0]]
        assert list(found["ids"]) == ids and found["n_tokens"] == len(ids) and found["decoded"] == model.decode(ids)
        assert found["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert pieces.digest(empty, piece_model()).count() == 0


def test_pieces_decode_round_trip(docs):
    both = pieces.decode(pieces.encode(docs.select("doc_id", "text"), piece_model(), decoded=False), piece_model())
    assert all(r["decoded"] == (r["text"] or "") for r in both.collect())
    with pytest.raises(ValueError, match="already"):
        pieces.decode(both, piece_model())


def test_pieces_any_text():
    table, draw = pieces.ChunkTable(pieces.load(piece_model()), 20), random.Random(1)
    parts = [" ", "  ", "a", "▁", "\n", "é", "hello", "日本", "😀", "<s>", "<0x41>", "\r", "x́", "\0", "12"]
    for _ in range(1500):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        ids = table.model.encode(text)
        assert table.text(text) == (np.array(ids, "<u4").tobytes(), table.model.decode(ids)), repr(text)


def test_token_counts(docs, rows, empty):
    scores, byte = token_counts.vocabulary(piece_model())
    longest = max(map(len, scores))

    def brute(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            width = len(word[end - 1].encode())
            ways = [(best[-1][0] + width * byte, best[-1][1] - width)]
            ways += [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in scores]
            best.append(max(ways))
        return -best[-1][1]

    got = {r["doc_id"]: r for r in token_counts.count(docs, piece_model(), most_nodes=500).collect()}
    for r in rows:
        words = WORD.findall(r[1] or "")
        assert (got[r[0]]["n_pretokens"], got[r[0]]["n_tokens"]) == (len(words), sum(brute("▁" + w) for w in words))
    assert token_counts.count(empty, piece_model()).count() == 0


def test_token_counts_equal_a_unigram_library():
    from tokenizers import Tokenizer, models

    scores, byte = token_counts.vocabulary(piece_model())
    vocab = [*scores.items(), *((f"<0x{i:02X}>", byte) for i in range(256)), ("<unk>", -100.0)]
    library = Tokenizer(models.Unigram(vocab, unk_id=len(vocab) - 1, byte_fallback=True))
    trie = token_counts.Trie(scores, byte, 10_000)
    for word in ["▁" + w + str(i % 7) for i, w in enumerate(WORDS * 5)] + ["▁日本語", "▁naïveté", "▁" + "xyz" * 30]:
        assert trie.count(word) == len(library.encode(word).ids), word


def test_token_counts_bounds_memory():
    """Long pre-tokens never enter the trie; counts are those of the trie."""
    scores, byte = token_counts.vocabulary(piece_model())
    wide, narrow = token_counts.Trie(scores, byte, 1_000_000), token_counts.Trie(scores, byte, 300, 40)
    draw = random.Random(7)
    for n in (1, 39, 40, 41, 200, 900):
        word = "▁" + "".join(draw.choice("theanding日é") for _ in range(n))
        assert narrow.count(word) == wide.count(word)
        assert len(narrow.forward) <= 300
    long = "".join(draw.choice("theanding") for _ in range(1_000_000))
    total, nodes = narrow.count("▁" + long), len(narrow.forward)
    assert 100_000 < total < 1_000_000 and nodes <= 300


# 6


def brute_languages(rows, texts, bits=language.BITS):
    """Posteriors by counting n-grams one at a time."""

    def each(text):
        codes = [(ord(c) + 1) * 2654435761 % 2**32 for c in text.lower()]
        two = [(((a ^ a >> 15) * 0x9E3779B1) + b) % 2**32 for a, b in zip(codes, codes[1:], strict=False)]
        three = [(((a ^ a >> 13) * 0x9E3779B1) + b) % 2**32 for a, b in zip(two, codes[2:], strict=False)]
        return [x >> 32 - bits for x in [*codes, *(x * 2654435761 % 2**32 for x in two), *(x * 2654435761 % 2**32 for x in three)]]

    names = sorted({lang for _, lang in rows})
    counts = {k: Counter(g for t, lang in rows if lang == k for g in each(t)) for k in names}
    whole = {k: sum(c.values()) + 0.5 * 2**bits for k, c in counts.items()}
    out = []
    for text in texts:
        logs = [np.log(sum(lang == k for _, lang in rows) / len(rows)) + sum(np.log((counts[k][g] + 0.5) / whole[k]) for g in each(text)) for k in names]
        out.append((names[int(np.argmax(logs))], 1 / np.exp(np.array(logs) - max(logs)).sum()))
    return out


def test_language(spark, empty, docs):
    words = {"aa": "alba casa mare luna".split(), "bb": "xyth qorr zemm vulp".split()}
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(words[k]) for _ in range(12)), k) for i in range(200) for k in ["aa" if i % 3 else "bb"]]
    more = [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, "casa " * 3000, None), (904, "½ ²³ Ⅷ ① _", None), (905, "casa xyth", None), (906, "A", None)]
    df = spark.createDataFrame(rows + rows[:9] + more, "doc_id long, text string, lang string").repartition(3)
    train = df.filter("doc_id % 4 <> 2")
    model = language.fit(train)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.annotate(df.drop("lang"), model).collect()}
    assert all(got[r[0]][0] == r[2] for r in rows) and all(0 <= s <= 1 for _, s in got.values())
    assert got[900] == got[901] == got[902] == got[904] == ("und", 0.0) and got[903][0] == "aa"
    texts = {r[0]: r[1] for r in rows + more}
    asked = [i for i in got if got[i][0] != "und"]
    want = brute_languages([(r["text"], r["lang"]) for r in train.collect() if r["text"] and r["lang"]], [texts[i] for i in asked])
    assert [got[i][0] for i in asked] == [x[0] for x in want] and [got[i][1] for i in asked] == pytest.approx([x[1] for x in want], abs=1e-4)
    nothing = language.fit(empty)
    assert {r["lang_pred"] for r in language.annotate(docs.drop("score"), nothing).collect()} == {"und"}
    for clash in ("score", "lang_pred"):
        with pytest.raises(ValueError, match="already"):
            language.annotate(spark.createDataFrame([("x", 1.0)], f"text string, {clash} double"), model)


def test_language_without_ids(spark):
    """Rows without id are drawn one by one: no language is lost, and the sample stays bounded."""
    rows = [(None, f"xa xb xc x{i}", "xx") for i in range(3000)] + [(None, "ya yb yc", "yy")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(df, per_language=300)
    assert [r["lang_pred"] for r in language.annotate(spark.createDataFrame([(1, "xa xb"), (2, "yc ya")], "doc_id long, text string"), model).orderBy("doc_id").collect()] == ["xx", "yy"]
    key = common.own_place(F.col("doc_id"), F.col("text"))
    drawn = df.filter(common.drawn(key, "language", 0.1)).groupBy("lang").count().collect()
    assert len(drawn) == 2 and all(200 < r["count"] < 400 for r in drawn)


def test_language_blocks_lose_no_gram(monkeypatch):
    draw = random.Random(5)
    texts = ["".join(draw.choice("abcdé日") for _ in range(n)) for n in (997, 1, 2, 0, 3, 50)]
    model = language.Model(["p", "q"], np.random.default_rng(1).normal(size=(1 << language.BITS, 2)).astype(np.float32) / 50, np.log([0.3, 0.7]))
    whole = model.score(texts)
    single = [model.score([t]) for t in texts]
    assert whole[0] == [x[0][0] for x in single] and whole[1] == pytest.approx([x[1][0] for x in single])
    for block in (1, 2, 3, 10, 500):
        monkeypatch.setattr(language, "BLOCK", block)
        found = model.score(texts)
        assert found[0] == whole[0] and found[1] == pytest.approx(whole[1])


# 8


def test_quality_statistics(docs, rows, empty):
    extra = ["a b c d e f a b c d e g", "l one\nl one\n\n \nl one\nx", "x y z w v " * 6, "#*$ %& |<> end"]
    df = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    for r in quality_rules.apply(df, []).join(df.distinct(), "doc_id").collect():
        text = r["text"] or ""
        words, at, lines = WORD.findall(text), defaultdict(list), [x for x in text.split("\n") if WORD.search(x)]
        for i in range(len(words) - 4):
            at[tuple(words[i : i + 5])].append(i)
        repeat = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
        assert (r["base_failed"], r["kept"]) == (failed, not failed)
    assert quality_rules.apply(empty, []).count() == 0


def test_quality_rules_learn_symbols(spark):
    draw = random.Random(6)
    rows, marks = [], []
    for i in range(400):
        poor = i % 4 == 0
        words = [draw.choice(WORDS) + str(draw.randrange(900)) + ("%%%" if poor else "") for _ in range(draw.randrange(15, 60))]
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            marks.append((i, 0 if poor else 1))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (7, None), (None, 1)], "doc_id long, quality int")
    rules = quality_rules.train(df, labels)
    assert rules and quality_rules.train(df, labels.limit(0)) == []
    got = {r["doc_id"]: r["kept"] for r in quality_rules.apply(df, rules).collect()}
    assert np.mean([got[i] == (i % 4 != 0) for i in got]) > 0.98


# 1


def test_toxicity(spark, empty):
    draw = random.Random(8)
    rows, marks = [], []
    for i in range(1500):
        words = [draw.choice(WORDS) + str(draw.randrange(30)) for _ in range(draw.randrange(10, 80))]
        toxic = i % 9 == 0
        if toxic:
            words[draw.randrange(len(words))] = draw.choice(("vile,", "Nasty"))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    df = spark.createDataFrame(rows + [(9000, None), (9001, ""), (9002, "calm " * 20000 + "vile")], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    machine = toxicity.fit(df, labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    got = {r["doc_id"]: r for r in toxicity.annotate(df, machine).collect()}
    wrong = [i for i, y in marks if held(i) and got[i]["predicted"] != y]
    assert len(wrong) <= 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[9000]["score"] == got[9001]["score"] < 0.5 and got[9002]["predicted"] == 1
    none = toxicity.fit(df, labels.limit(0))
    assert max(r["score"] for r in toxicity.annotate(df, none).collect()) < 1e-9
    assert toxicity.annotate(empty.drop("score"), machine).count() == 0
    with pytest.raises(ValueError, match="already"):
        toxicity.annotate(empty, machine)


def test_factorization_learns_a_pair():
    """Toxic only where two terms meet: no additive weights can tell."""
    draw = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(4000):
        a, b = draw.random(2) < 0.5
        rows.append(np.array(sorted({*([1] if a else []), *([2] if b else []), *draw.integers(10, 40, 4).tolist()}), np.int32))
        y.append(float(a and b))
    machine = toxicity._train(rows, np.array(y), 24, 10, 4.0, 60, 0.3, 1e-5, 3)
    assert {1, 2} <= set(machine.buckets.tolist())
    one, two = (int(np.flatnonzero(machine.buckets == k)[0]) for k in (1, 2))
    only, both = machine.score([np.array([one]), np.array([two])]), machine.score([np.array([one, two])])
    assert only.max() < 0.5 < both[0]


def test_factorization_scores_are_sums_over_pairs():
    """Scores against a loop over terms and pairs of terms."""
    draw = np.random.default_rng(2)
    machine = toxicity.Machine(24, -0.3, np.arange(30, dtype=np.int32), draw.normal(size=30), draw.normal(0, 0.3, (30, toxicity.FACTORS)))
    texts = [np.sort(draw.choice(30, n, replace=False)) for n in (0, 1, 2, 5, 20, 30)]
    for terms, score in zip(texts, machine.score(texts), strict=True):
        margin = -0.3 + sum(machine.weights[i] for i in terms) + sum(float(machine.factors[i] @ machine.factors[j]) for i in terms for j in terms if i < j)
        assert score == pytest.approx(1 / (1 + np.exp(-margin)))


def test_factorization_needs_its_factors():
    """Toxic where one of two terms stands alone: with the factors zeroed, held-out texts can't be told apart."""
    draw = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(6000):
        a, b = draw.random(2) < 0.5
        rows.append(np.array(sorted({*([1] if a else []), *([2] if b else []), *draw.integers(10, 400, 20).tolist()}), np.int32))
        y.append(float(a != b))
    y = np.array(y)
    machine = toxicity._train(rows[:4000], y[:4000], 24, 10, 4.0, 60, 0.3, 1e-5, 3)
    places = {int(b): i for i, b in enumerate(machine.buckets)}
    held = [np.array([places[k] for k in t.tolist() if k in places], int) for t in rows[4000:]]
    right = np.mean((machine.score(held) >= 0.5) == y[4000:])
    machine.factors[:] = 0
    assert right > 0.99 and np.mean((machine.score(held) >= 0.5) == y[4000:]) < 0.8


def test_toxicity_repeated_rows_and_conflicting_labels(spark):
    rows = [(i, f"w{i % 7} " + ("vile" if i % 2 else "calm")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, i % 2) for i in range(400)]
    labels, more = (spark.createDataFrame(m, "doc_id long, toxic int") for m in (marks, marks + [(i, 0) for i in range(400)] + [(None, 1), (3, None)]))
    one, two = toxicity.fit(df, labels), toxicity.fit(df, more)
    assert one.buckets.tolist() == two.buckets.tolist() and one.weights == pytest.approx(two.weights)
    got = toxicity.annotate(df.union(df), one).collect()
    assert len({(r["doc_id"], r["score"]) for r in got}) == 400 and all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_factorization_keeps_a_pair_of_neutral_terms():
    """Toxic where both terms meet or neither does: each alone is near neutral, below 4 standard deviations."""
    draw = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(4000):
        a, b = draw.random(2) < 0.5
        rows.append(np.array(sorted({*([1] if a else []), *([2] if b else []), *draw.integers(10, 400, 20).tolist()}), np.int32))
        y.append(float(a == b))
    y = np.array(y)
    for k in (1, 2):
        has = np.array([k in t for t in rows])
        assert abs(y[has].sum() - has.sum() * y.mean()) < 4 * np.sqrt(has.sum() * y.mean() * (1 - y.mean()))
    machine = toxicity._train(rows, y, 24, 10, 4.0, 60, 0.3, 1e-5, 3)
    assert machine.buckets.tolist() == [1, 2]
    one, two, both, none = machine.score([np.array([0]), np.array([1]), np.array([0, 1]), np.array([], int)])
    assert max(one, two) < 0.5 < min(both, none)


# 7


def brute_priors(rows, labels):
    """Posteriors of each row's path with the row's own label left out.  ``rows``: id, host, path."""
    y = dict(labels)
    mean = (sum(y[i] for i, _, _ in rows if i in y) + 1) / (sum(i in y for i, _, _ in rows) + 2)

    def sums(key):
        out = defaultdict(lambda: [0, 0])
        for r in rows:
            if r[0] in y:
                out[key(r)][0] += y[r[0]]
                out[key(r)][1] += 1
        return out

    def worth(groups, parent):
        big = [(g, n, parent[s]) for s, (g, n) in groups.items() if n > 1]
        return site_quality.strength(sum(n for _, n, _ in big), sum(n * n for _, n, _ in big), sum(n * (g / n - p) ** 2 for g, n, p in big), len(big), mean)

    hosts, paths = sums(lambda r: r[1]), sums(lambda r: r[1:])
    m = worth(hosts, {s: mean for s in hosts})
    above = {s: (g + m * mean) / (n + m) for s, (g, n) in hosts.items()}
    k = worth(paths, {s: above[s[0]] for s in paths})
    out = {}
    for r in rows:
        own, own_n = y.get(r[0], 0), int(r[0] in y)
        (hg, hn), (pg, pn) = hosts[r[1]], paths[r[1:]]
        out[r[0]] = (pg - own + k * (hg - own + m * mean) / (hn - own_n + m)) / (pn - own_n + k)
    return out


@pytest.mark.parametrize("few", [200_000, 1])
def test_site_quality_priors(spark, monkeypatch, few):
    monkeypatch.setattr(site_quality, "FEW_SITES", few)
    monkeypatch.setattr(common, "hot_keys", functools.partial(common.hot_keys, least=1, most=40))
    draw = random.Random(5)
    rows = [(i, "plain words in a row " * 4, draw.choice(("a", "b", "b=1:c", None)), draw.choice(("p", "q", None))) for i in range(300)] + [(999, None, None, "new")]
    labels = [(i, int(draw.random() < (0.9 if rows[i][2] == "a" else 0.3))) for i in range(0, 300, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame([*labels, (None, 1), (1, None), (3, 7)], "doc_id long, quality int")
    got = {r["doc_id"]: r["site_prior"] for r in site_quality.score(df, marks).collect()}
    want = brute_priors([(r[0], r[2], r[3]) for r in rows], labels)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_site_quality_edges(spark, empty):
    df = spark.createDataFrame([(1, "a b", "s", "p"), (2, None, None, None), (None, "", "s", "p")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    none = site_quality.score(df, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and all(r["kept"] for r in none)
    assert len(site_quality.score(df, labels).collect()) == 3 and site_quality.score(empty, labels).count() == 0


def test_site_quality_reads_words(spark):
    """Texts of one shape and one site that differ in their words alone."""
    draw = random.Random(2)
    good, poor = "amber basil cedar delta".split(), "embra lisab redac taled".split()
    rows = [(i, " ".join(draw.choice(good if i % 2 else poor) for _ in range(20)), "s", "p") for i in range(400)]
    labels = [(i, i % 2) for i in range(300)]
    got = site_quality.score(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert np.mean([r["kept"] == bool(r["doc_id"] % 2) for r in got]) > 0.95  # the bin in the middle holds both


def test_site_quality_separates_shapes(spark):
    rows = [(i, ("word, other. more " if i % 3 else "w### x*** y%%% | ") * 10, f"s{i % 5}", "en") for i in range(300)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 300, 2)]
    got = site_quality.score(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 > 0) for r in got)


# 10


def brute_ranges(rows, window=100):
    seen, out = set(), {}
    for i, text in sorted((r[0], r[1]) for r in rows):
        raw = (text or "").encode()
        mark = np.zeros(len(raw), bool)
        for p in range(len(raw) - window + 1):
            s = raw[p : p + window]
            if s in seen:
                mark[p : p + window] = True
            else:
                seen.add(s)
        kept = np.frombuffer(raw, np.uint8)[~mark].tobytes()
        out[i] = (len(raw), int(mark.sum()), int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, rows, empty):
    got = suffix_dedup.digest(docs).collect()
    assert len(got) == len(rows) + 2
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_ranges(rows)
    assert suffix_dedup.digest(empty).count() == 0


def test_suffix_dedup_hot_anchor(spark, monkeypatch):
    """A line in ever new surroundings goes window by window; a small limit makes it hot."""
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    draw = random.Random(9)
    line = " ".join(draw.choice(WORDS) for _ in range(16))
    rows = [(i, "".join(draw.choice("abcdefgh ") for _ in range(60 + i % 30)) + line + "".join(draw.choice("abcdefgh ") for _ in range(70))) for i in range(150)]
    rows += [(200 + i, rows[i][1][20:]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert len(suffix_dedup._hot_anchors(suffix_dedup._keyed(df, "doc_id", "text"), 100)) > 0
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(df).collect()} == brute_ranges(rows)


def test_suffix_dedup_streams_small_batches(spark, docs, rows):
    """Groups that run over the ends of Arrow batches."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(conf)
    try:
        for size in ("1", "3"):
            spark.conf.set(conf, size)
            assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(docs).collect()} == brute_ranges(rows)
    finally:
        spark.conf.set(conf, was)


def test_suffix_dedup_keeps_bytes_and_columns(docs):
    out = suffix_dedup.clean(docs)
    assert out.schema["_row"].dataType == docs.schema
    assert all(r["n_bytes"] - r["n_removed"] == len(r["kept_bytes"]) for r in out.collect())


@pytest.mark.parametrize("seed", range(4))
def test_intervals_equal_windows(seed):
    draw = np.random.default_rng(seed)
    base = draw.integers(97, 99 + seed, 300).astype(np.uint8)
    parts = [base, base[20:260], draw.integers(97, 99, 40).astype(np.uint8), base[100:], base[:150], np.full(130, 97, np.uint8)]
    text = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    left = np.repeat(ends, [len(p) for p in parts]) - np.arange(len(text))
    found, interval = suffix_dedup.repeated(text, left, 100)
    same = defaultdict(list)
    for p in range(len(text)):
        if left[p] >= 100:
            same[text[p : p + 100].tobytes()].append(p)
    got = defaultdict(list)
    for p, i in zip(found.tolist(), interval.tolist(), strict=True):
        got[i].append(p)
    assert sorted(sorted(v) for v in got.values()) == sorted(v for v in same.values() if len(v) > 1)
