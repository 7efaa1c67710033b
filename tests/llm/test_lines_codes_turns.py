"""Line dedup, vector codes and conversation repair against brute force, with null, empty, long, tied and repeated rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratiq.llm import conversations, line_dedup, vector_codes

BLANKS = " \t\n\x0b\x0c\r"


def signed(text):
    """Spark's 64-bit hash."""
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) * (h >> 63)


# 13


def brute_lines(rows, least_chars=20, least_docs=3):
    """For each row: remaining text."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    name = lambda i, t: (0, signed(t or "")) if i is None else (1, i)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(name(i, t))
    return ["\n".join(x for x in (t or "").split("\n") if len(holders[key(x)]) < least_docs or name(i, t) == max(holders[key(x)])) for i, t in rows]


def line_rows(seed=0, n=80, ids=True):
    draw = random.Random(seed)
    common = [f"this is common line {k} of the lot" + " x" * k for k in range(12)]
    rows = []
    for i in range(n):
        lines = [draw.choice([draw.choice(common), draw.choice(common).upper() + "\t", f"  a line of its own {draw.random()}", "short", "", "\r"]) for _ in range(draw.randrange(9))]
        rows.append((i if ids else None, "\n".join(lines)))
    return rows + [(1000, None), (1001, ""), (1002, "\n"), (1003, "ÉCOLE ÉCOLE ÉCOLE ÉCOLE"), (1004, "École école école école"), (1005, "x" * 300_000 + "\n" + common[0])]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_lines(spark, monkeypatch, parts):
    monkeypatch.setattr(line_dedup, "shuffle_parts", lambda _: parts)
    rows = line_rows()
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_lines"], r["kept_sha256"]) for r in line_dedup.digest(df).collect())
    all_ = rows + rows[:3]
    assert got == Counter((i, (t or "").count("\n") + 1, hashlib.sha256(k.encode()).hexdigest()) for (i, t), k in zip(all_, brute_lines(all_), strict=True))


def test_lines_dropped_counts_and_bitmaps(spark):
    rows = line_rows(3)
    texts, kept = dict(rows), dict(zip([i for i, _ in rows], brute_lines(rows), strict=True))
    for r in line_dedup.bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        lines = (texts[r["doc_id"]] or "").split("\n")
        keep = np.ones(len(lines), bool) if r["keep"] is None else line_dedup.unpacked(r["keep"], len(lines))
        assert "\n".join(itertools.compress(lines, keep)) == kept[r["doc_id"]]
        assert (r["n_lines"], r["n_dropped"]) == (len(lines), (~keep).sum())


def test_lines_null_and_text_ids_and_columns(spark):
    rows = line_rows(5, ids=False)
    got = Counter((r["doc_id"], r["kept_sha256"]) for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((i, hashlib.sha256(k.encode()).hexdigest()) for (i, _), k in zip(rows, brute_lines(rows), strict=True))
    named = [(f"n{i:05}", t, "keep", "row") for i, t in line_rows(6)]
    df = spark.createDataFrame(named, "doc_id string, text string, _keep string, _row string")
    out = line_dedup.deduplicate(df)
    want = [t if t is None else k for (_, t, *_), k in zip(named, brute_lines([x[:2] for x in named]), strict=True)]
    assert out.columns == df.columns and {r["doc_id"]: (r["text"], r["_keep"]) for r in out.collect()} == {i: (k, "keep") for (i, *_), k in zip(named, want, strict=True)}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.digest(none).count() == 0 and line_dedup.bitmaps(none).count() == 0


@pytest.mark.parametrize("least", [2, 3, 5])
def test_lines_pass_over_any_cut(least):
    """Partitions and batches cut anywhere, with a buffer of one line: same verdicts as a count of documents."""
    draw = random.Random(least)
    for _ in range(60):
        rows = sorted({(draw.randrange(4), -draw.randrange(7), draw.randrange(3)) for _ in range(draw.randrange(1, 40))})
        cuts = sorted({0, len(rows), *(i for i in range(1, len(rows)) if rows[i][:2] != rows[i - 1][:2] and draw.random() < 0.3)})
        found = []
        for part, (low, high) in enumerate(itertools.pairwise(cuts)):
            state = line_dedup.Pass(part, least, held=draw.choice([0, 2, 100]))
            at = low
            while at < high:
                to = min(high, at + draw.randrange(1, 5))
                a, d, p = (list(x) for x in zip(*rows[at:to], strict=True))
                arrays = [pa.array(a), pa.array(a), pa.array([-x for x in d]), pa.array([None] * len(d), pa.int64()), pa.array(p), pa.array(p)]
                for out in state.step(pa.RecordBatch.from_arrays(arrays, names=["_a", "_b", "_id", "_own", "_t", "_pos"])):
                    found += out.to_pylist()
                at = to
            for out in state.end():
                found += out.to_pylist()
        counts = defaultdict(list)
        for r in found:
            if r["_kind"] == line_dedup.COUNT:
                counts[r["_a"]].append((r["_part"], r["_n"]))
        lost = {(r["_a"], -r["_id"], r["_pos"]) for r in found if r["_kind"] == line_dedup.DROP}
        for r in found:
            if r["_kind"] == line_dedup.OPEN and sum(n for _, n in counts[r["_a"]]) >= least and (r["_n"], r["_part"]) != (1, min(counts[r["_a"]])[0]):
                lost.add((r["_a"], -r["_id"], r["_pos"]))
        docs = defaultdict(set)
        for a, d, _ in rows:
            docs[a].add(d)
        assert lost == {x for x in rows if len(docs[x[0]]) >= least and x[1] != min(docs[x[0]])}


# 11


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: id, vector, label; vectors of one length without faults."""
    kept = sorted(((i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows), key=lambda r: (r[0] is None, r[0], r[1]))
    width = -(-len(kept[0][1]) // parts)
    cut = [[(v + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            mine = defaultdict(list)
            for c in cut:
                mine[near(c[p], book)[1]].append(c[p])
            new.append([[sum(x) // len(mine[k]) for x in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(book)])
        books = new
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        labels[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, labels[lab], sha) for (i, _, lab), f, e in zip(kept, found, errors, strict=True))


COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize(("size", "rows", "entries"), [(32, 150, 64), (16, 90, 8), (20, 40, 64), (3, 60, 5)])
def test_codes(spark, size, rows, entries):
    draw = np.random.default_rng(size)
    data = [(i, [float(x) for x in np.float32(draw.normal(0, 1, size))], [None, 1, 2][i % 3]) for i in range(rows)]
    data += [(500 + i, data[7][1], 2) for i in range(20)] + [data[3], data[3]]
    bad = [(900, None, 1), (901, [], 1), (902, [None] + [0.0] * (size - 1), 1), (903, [float("nan")] * size, None), (904, [float("inf")] * size, 2), (905, [1.0] * (size + 1), 2), (906, [3e38] * size, 2)]
    df = spark.createDataFrame([(*x, "clash") for x in data + bad], "vec_id long, embedding array<float>, label int, code string").repartition(4)
    got = vector_codes.compress(df, entries=entries)
    assert got.columns == COLUMNS and Counter(map(tuple, got.collect())) == brute_codes(data, entries=entries)


def test_codes_search_is_exhaustive():
    draw = np.random.default_rng(1)
    for _ in range(40):
        points, book = draw.integers(-6, 6, (draw.integers(1, 80), 4)), draw.integers(-6, 6, (draw.integers(1, 70), 4))
        full = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        code, error = vector_codes.nearest(points, book)
        assert (code == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all()  # argmin: the lower of equals


def test_codes_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(empty).count() == 0
    df = spark.createDataFrame([(None, [0.5, -0.5], "a"), (2, [0.25, 0.0], None), (1, [0.0, 0.0], None)], "vec_id long, embedding array<double>, label string")
    found = {r["vec_id"]: r for r in vector_codes.compress(df, parts=2).collect()}
    assert [found[i]["code"] for i in (1, 2, None)] == ["0000", "0100", "0202"] and {r["error"] for r in found.values()} == {0}
    books = vector_codes.fit(df, parts=2)
    coded = vector_codes.encode(df, books)
    with pytest.raises(ValueError, match="already"):
        vector_codes.encode(coded, books)
    back = {r["vec_id"]: r["decoded"] for r in vector_codes.decode(coded, books).collect()}
    assert all(abs(x - y) <= 1 / 256 for r in df.collect() for x, y in zip(r["embedding"], back[r["vec_id"]], strict=True))


# 12


def brute_repair(roles, faults):
    """Least cost and the least string of edits, by a search over all strings in order of cost."""
    import heapq

    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, best = [(0, "", 0, 0)], None
    seen = set()
    while heap:
        cost, text, i, s = heapq.heappop(heap)
        if (i, s, text) in seen:
            continue
        seen.add((i, s, text))
        if best is not None and cost > best[0]:
            break
        if i == len(roles) and s in (0, 3):
            best = min(best or (cost, text), (cost, text))
            continue
        if text.count("I") < 3:
            for r in "ua":
                if (s, r) in step:
                    heapq.heappush(heap, (cost + 5, text + "I", i, step[s, r]))
        if i < len(roles):
            heapq.heappush(heap, (cost + 2, text + "D", i + 1, s))
            if faults[i] in "-t":
                torn = 5 * (faults[i] == "t")
                if (s, roles[i]) in step:
                    heapq.heappush(heap, (cost + torn, text + "K", i + 1, step[s, roles[i]]))
                for r in "ua":
                    if (s, r) in step:
                        heapq.heappush(heap, (cost + torn + 1, text + "R", i + 1, step[s, r]))
    return best


def test_repair_is_the_least_of_the_cheapest():
    draw = random.Random(2)
    for _ in range(400):
        n = draw.randrange(8)
        roles, faults = "".join(draw.choice("suax") for _ in range(n)), "".join(draw.choice("---tbd") for _ in range(n))
        assert conversations.settled([], [], roles, faults) == brute_repair(roles, faults)


def brute_audit(rows):
    """rows: conv, turn, role, text, present."""
    groups = defaultdict(list)
    for conv, turn, role, text, present in rows:
        groups[conv] += [(turn, " " if role is None else role, " " if text is None else text)] * bool(present)
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], signed(r[2])))
        initials, faults, seen = "".join(conversations.initial_of(r) for _, r, _ in turns), "", set()
        for _, role, text in turns:
            fault = "b" if not text.strip(BLANKS) else "d" if (role, text) in seen else "-" if re.search(rf"[.!?][{BLANKS}]*\Z", text) else "t"
            seen.add((role, text))
            faults += fault
        cost, audit = conversations.settled([], [], initials, faults)
        body, at, last = [], 0, ""
        for letter in audit:
            role = "assistant" if last == "u" else "user"
            if letter == "K":
                role = turns[at][1]
            if letter != "D":
                body.append(f"{role}:{'' if letter == 'I' else turns[at][2]}")
                last = role[0]
            at += letter != "I"
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
        out[conv] = (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest(), "\n".join(body))
    return out


def turn_rows(seed, convs=60, most=14):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        texts = [f"Said {draw.randrange(9)} here{draw.choice(['.', '!', '?', ' ', '. ', ''])}" for _ in range(4)] + ["", " \t", None, "."]
        for _ in range(draw.randrange(1, most)):
            turn = draw.choice([None, *range(-2, 20)])
            rows.append((conv, turn, draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), draw.choice(texts), draw.random() > 0.1, "clash"))
    return rows + [(7001, 1, "user", "Only dropped.", False, "clash"), (7002, None, "user", "No turn.", True, None)]


TURNS = "conv_id long, turn long, role string, text string, present boolean, _block string"


@pytest.mark.parametrize(("parts", "most"), [(1, 2048), (9, 2048), (9, 1), (30, 3)])
def test_conversations(spark, monkeypatch, parts, most):
    """Any cut into partitions and blocks gives the rows of a plain pass."""
    monkeypatch.setattr(conversations, "shuffle_parts", lambda _: parts)
    monkeypatch.setattr(conversations, "MOST_ROWS", most)
    rows = turn_rows(parts + most) + [(8000, i, ["user", "assistant"][i % 2], f"Turn {i % 57} of a long one.", True, "") for i in range(400)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    want = brute_audit([r[:5] for r in rows])
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.audit(df, present=F.col("present")).collect()}
    assert got == {c: r[:-1] for c, r in want.items()}
    bodies = defaultdict(list)
    for r in conversations.repaired(df, present=F.col("present")).collect():
        bodies[r["conv_id"]].append((r["place"], f"{r['role']}:{r['text']}"))
    assert {c: "\n".join(x for _, x in sorted(b)) for c, b in bodies.items()} == {c: r[-1] for c, r in want.items() if r[-1]}
    assert all([p for p, _ in sorted(b)] == list(range(len(b))) for b in bodies.values())


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(12) for t, r, x in [(0, "system", "A. B!"), (1, "user", "Why?"), (2, None, None), (None, "assistant", "Yes.")]]
    rows.append((None, None, "user", "Lost."))
    want = Counter()
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x, r = " " if x is None else x, " " if r is None else r
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        want[(c, t, "user" if kind == 4 else r, x, kind != 0)] += 1 + (kind == 3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, conversations.damaged(df).collect())) == want
    assert conversations.audit(conversations.damaged(df.limit(0)), present=F.col("present")).count() == 0


def test_one_long_turn(spark):
    text = "word " * 4_000_000 + "."
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "Yes."), (2, 0, "user", "No.")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in conversations.audit(df).collect()}
    assert got[1]["repaired_sha256"] == hashlib.sha256(f"user:{text}\nassistant:Yes.".encode()).hexdigest() and got[2]["audit"] == "D"
