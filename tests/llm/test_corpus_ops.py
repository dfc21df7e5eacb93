"""The corpus-wide operators and the pipeline against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerf.llm import graph, neardup, repeats
from kerf.llm.suffixarray import permuted_prefixes, suffix_array
from tests.llm import brute


def edited(rng: random.Random, words: list[str], share: float) -> str:
    return " ".join(rng.choice("pqrst") * 3 + str(rng.randint(0, 999)) if rng.random() < share else w for w in words)


def corpus(seed: int, group: int) -> list[tuple[int | None, str | None]]:
    """Exact copies, near copies about the threshold, chains, empty and short texts."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    out: list[str | None] = [None, "", " \t", "one", "one", "two words here", " ".join(text(5000))]
    for k in range(6):
        base = text(120)
        out += [" ".join(base)] * (1 + k % 3) + [edited(rng, base, 0.01 + 0.005 * k) for _ in range(4)]
    base = text(150)
    out += [edited(rng, base, 0.008) for _ in range(group)]
    chain = text(200)
    for _ in range(5):
        chain = chain[8:] + text(8)
        out.append(" ".join(chain))
    out += [" ".join(text(90)) for _ in range(30)]
    rng.shuffle(out)
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, m string, row int").repartition(3).cache()


@pytest.mark.parametrize("small, limit, block", [(64, neardup.LIMIT, neardup.ROWS), (8, 3000, neardup.ROWS), (64, neardup.LIMIT, 4)])
def test_near_duplicates(spark, monkeypatch, small, limit, block):
    """Whole, and with nodes so small and blocks so tight that every path is taken."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "ROWS", block)
    rows = corpus(3, 90)
    got = neardup.near_duplicates(frame(spark, rows), limit=limit).collect()
    want = brute.near(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(w[:3] for w in want)


def test_near_duplicates_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, ""), (2, "a b c d e f"), (None, "x y z")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 2), (5, 2), (None, 2), (None, None), (7, 7), (2, 2), (None, None)], key=str)
    kept = neardup.distinct_documents(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "m", "row"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 7, None, None], key=str)
    assert neardup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("small", [64, 4])
def test_thresholds(spark, monkeypatch, small):
    """The pipeline's stage drops near copies from 0.80 on, op1's threshold stays at 0.85."""
    import corpus_pipeline

    monkeypatch.setattr(neardup, "SMALL", small)
    rng = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"v{rng.randint(0, 10**6)}" for _ in range(104)]
        # 100 shingles in common of 100 + more: 0.855, 0.82, 0.80 and 0.79.
        more = (17, 22, 25, 26)[k % 4]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + [f"z{k}_{i}" for i in range(more)]))]
    docs = frame(spark, rows)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    second = lambda some: {2 * k + 1 for k in range(60) if k % 4 in some}
    assert ids(corpus_pipeline.near_dedup_stage(spark, docs, "")) == set(range(0, 120, 2)) | second({3})
    assert ids(neardup.distinct_documents(docs)) == set(range(0, 120, 2)) | second({1, 2, 3})


def test_plan():
    """A lower threshold branches more often, is more lenient and has more trees; the chance of a miss holds."""
    low, high = neardup.plan(80), neardup.plan(85)
    assert (low.again, high.again) == (25, 18)
    assert low.lenient < high.lenient and low.trees > high.trees
    assert all(neardup.missed(p.percent, p.again, p.lenient, p.trees, neardup.FIRST) <= neardup.CHANCE for p in (low, high))
    with pytest.raises(ValueError):
        neardup.plan(40)


def test_chance_of_a_miss():
    """Many pairs at the threshold, by the operator's own trees and cut, at the first and the deepest level."""
    rng = np.random.default_rng(6)
    by = neardup.plan(85)
    chance = [neardup.missed(85, by.again, by.lenient, n, k) for n, k in ((by.trees, neardup.FIRST), (by.deep, neardup.DEEPEST))]
    assert sum(chance) < 1e-4
    pairs = 20_000
    sketches = rng.integers(0, 1 << 16, (2, pairs, neardup.COORDINATES)).astype(np.uint16)
    sketches[1] = np.where(rng.random(sketches[1].shape) < 0.85, sketches[0], sketches[1])
    agree = (sketches[0] == sketches[1]).mean(axis=1) >= by.lenient
    for trees, levels in ((by.trees, neardup.FIRST), (by.deep, neardup.DEEPEST)):
        met = np.zeros(pairs, bool)
        for at in range(0, pairs, 2000):
            part = sketches[:, at : at + 2000].reshape(-1, neardup.COORDINATES)
            got = neardup._paths({"m": list(range(len(part))), "sketch": [s.tobytes() for s in part]}, range(trees), levels, by.again)
            m, node = np.array(got["m"]), np.array(got["node"], np.int64)
            size = len(part) // 2
            order = np.lexsort((node, m % size))
            m, node = m[order], node[order]
            both = (m[1:] % size == m[:-1] % size) & (node[1:] == node[:-1])
            met[at + m[1:][both] % size] = True
        assert (~(met & agree)).sum() <= 6, (trees, levels)


def test_exact_components(spark, monkeypatch):
    """Loose candidate groups of chains, copies and strangers, in blocks of three, have the components that all pairs have."""
    monkeypatch.setattr(neardup, "ROWS", 3)
    rng = random.Random(12)
    rows, group = [], {}
    for g in range(4):
        chain = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
        for k in range(12):
            chain = chain[5:] + [f"x{g}_{k}_{j}" for j in range(5)]
            rows.append((len(rows), " ".join(chain)))
        rows += [(len(rows) + k, f"stranger {g} {k} " * 3 + str(rng.random())) for k in range(5)]
        group |= {m: g for m, _ in rows if m not in group}
    sets = spark.createDataFrame([(m, m, 120, group[m]) for m, _ in rows], "m long, at long, n long, `group` long")
    texts = spark.createDataFrame(rows, "row long, text string")
    got = neardup.exact_components(lambda some: texts.join(some, F.col("row") == F.col("at")).drop("row", "at"), sets, neardup.LIMIT, 85)
    label = {r["vertex"]: r["root"] for r in got.collect()}
    first: dict[int, int] = {}
    for m, _ in rows:
        first.setdefault(label.get(m, m), m)
    assert [first[label.get(m, m)] for m, _ in rows] == [w[2] for w in brute.near(rows)]


def test_unstable_input(spark):
    """Rows that may come in other partitions each time are written first."""
    rows = corpus(5, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = neardup.near_duplicates(docs.where(F.rand() >= 0)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(w[:3] for w in brute.near(rows))


def test_links_of_sides():
    a, b = np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64)
    assert len(neardup.links([a, b, a + np.uint64(1000)])) == 1
    assert neardup.links([a, b], np.array([0, 0])) == []
    assert neardup.links([]) == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)]
    parent = {v: v for e in edges for v in e}

    def root(v: int) -> int:
        while parent[v] != v:
            v = parent[v]
        return v

    for x, y in edges:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    got = {r["vertex"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for e in edges if e[0] != e[1] for v in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for t in range(600):
        x = rng.integers(1, rng.choice([2, 3, 5, 20]) + 1, rng.integers(0, 60))
        x = np.tile(x[: max(1, len(x) // 6)], 7) if t % 4 == 0 else x
        s = np.concatenate([x, [0]])
        order = sorted(range(len(s)), key=lambda i: s.tolist()[i:])
        assert suffix_array(s).tolist() == order
        shared = np.zeros(len(s), int)
        for a, b in zip(order[1:], order):
            while s[a + shared[a]] == s[b + shared[a]]:
                shared[a] += 1
        assert permuted_prefixes(s, suffix_array(s)).tolist() == shared.tolist()


def passages(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    shared = [text(n) for n in (100, 101, 99, 300, 1000)]
    out: list[str | None] = [None, "", "short", "z" * 400, "z" * 150, "ab" * 200, shared[0]]
    for _ in range(25):
        out.append(text(rng.randint(0, 200)) + rng.choice(shared) + text(rng.randint(0, 300)) + rng.choice(shared) + text(rng.randint(0, 50)))
    out += [out[10]] * 5
    return list(enumerate(out))


def test_reach():
    """Each level knows more symbols, the last one all; a string has the symbols that are asked of it."""
    for level in range(8):
        for at, (before, after) in enumerate(repeats.reach(level)):
            assert before <= at and after <= 76 - at and (level < 7 or before + after == 76)


@pytest.mark.parametrize("hot", [repeats.HOT, 40, 1])
def test_repeats(spark, hot):
    """Whole, and with grams so hot that they are split by their neighbours, to the last level."""
    rows = passages(2)
    got = repeats.without_repeats(frame(spark, rows), hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats(rows))


def test_repeats_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 500)
    monkeypatch.setattr(repeats, "CHUNK", 300)
    repeats._POWERS.clear()
    rng = random.Random(1)
    same = "".join(rng.choice("abcdef") for _ in range(500))
    got = repeats.without_repeats(frame(spark, [(3, same), (3, same), (None, same), (1, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (3, 500), (3, 500)]
    assert repeats.without_repeats(frame(spark, [(3, same)]).limit(0)).count() == 0
    repeats._POWERS.clear()


def test_runs_cover_every_string():
    """Each string belongs to exactly one run, and equal strings to runs with equal grams."""
    rng = random.Random(7)
    text = ("".join(rng.choice("ab") for _ in range(700)) + "q" * 300) * 2
    data = np.frombuffer(text.encode(), np.uint8)
    gram, start, n, anchor = repeats.runs(data, np.array([900, len(data)]))
    owner = {s + k: int(g) for g, s, c in zip(gram, start, n) for k in range(c)}
    assert all(s + c - 1 <= p <= s + 76 and repeats.grams(data[p : p + 24])[0] == g for g, s, c, p in zip(gram, start, n, anchor))
    assert set(owner) == {i for i in range(len(data) - 99) if i + 100 <= 900 or i >= 900}
    by_text: dict[str, set] = {}
    for i, g in owner.items():
        by_text.setdefault(text[i : i + 100], set()).add(g)
    assert all(len(g) == 1 for g in by_text.values())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    good = lambda n: " ".join(rng.choice(["the", "river", "runs", "by", "an", "old", "mill", "and", "turns", f"w{rng.randint(0, 500)}"]) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["BUY", "###", "now!!", "click", "|", "$$$"]) for _ in range(n))
    item = " ".join(f"question{k}" for k in range(14))
    base = good(80)
    rows = [(i, good(60)) for i in range(80)] + [(100 + i, junk(60)) for i in range(80)]
    rows += [(300, base), (301, base), (302, base + " end"), (303, good(30) + " " + item + " " + good(30)), (304, good(50) + " write to a.b@c.org"), (305, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows[:160]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]
    table = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, table, str(tmp_path)).write.parquet(out)
        table = spark.read.parquet(out)
        if name != "bpe":
            assert table.columns == docs.columns
        seen[name] = {r["doc_id"]: r for r in table.collect()}
    assert not any(100 <= i < 300 for i in seen["quality"]) and all(i in seen["quality"] for i in range(80))
    assert {300, 301, 302} & set(seen["near_dedup"]) == {300}
    assert 303 in seen["near_dedup"] and 303 not in seen["decontaminate"]
    assert seen["pii"][304]["text"].endswith("write to [email]") and seen["pii"][304]["n_chars"] == len(seen["pii"][304]["text"])
    for i, r in seen["bpe"].items():
        assert r["decoded_sha256"] == brute.sha(seen["pii"][i]["text"] or "") and r["n_tokens"] == len(r["ids"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["bpe"])
