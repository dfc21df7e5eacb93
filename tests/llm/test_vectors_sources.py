"""Ball clusters, SimHash groups and source divergence against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from kerf.llm import balltree, divergence, simhash
from tests.llm import brute


def test_tree_is_exact():
    """Sums, ties and distances of trees against all distances, for loose and tight vectors."""
    rng = np.random.default_rng(5)
    for spread, n, leaf in ((1, 3000, 8), (40, 900, 32), (0, 200, 4), (3, 1, 32)):
        middle = rng.integers(-300, 300, (4, 6))
        v = middle[rng.integers(0, 4, n)] + (rng.integers(-spread, spread + 1, (n, 6)) if spread else 0)
        v = np.concatenate([v, np.repeat(v[:1], 500, 0)])
        c = np.concatenate([middle, middle[:2], v[:3]])  # equal centroids tie
        tree, order = balltree.Tree.grown(v, leaf)
        tree = balltree.Tree.unpacked(tree.packed(), 6)
        all_ = ((v[:, None, :] - c[None]) ** 2).sum(2)
        want = all_.argmin(1)[order]
        at, away = tree.assigned(c)
        assert (at == want).all() and (away == all_.min(1)[order]).all()
        count, sums, inertia = tree.summed(c)
        assert (count == np.bincount(want, minlength=len(c))).all()
        assert (sums == np.array([v[order][want == k].sum(0) for k in range(len(c))])).all()
        assert (inertia == np.bincount(want, all_.min(1)[order], len(c)).astype(int)).all()
        nodes, _, each, _ = tree.walk(c)
        assert tree.count[nodes].sum() + len(each) == len(v)
    # Tight groups far apart are settled by whole balls, almost without a look at vectors.
    v = np.concatenate([np.full((4000, 6), 1000) + rng.integers(0, 3, (4000, 6)), rng.integers(0, 3, (4000, 6))])
    assert len(balltree.Tree.grown(v)[0].walk(np.array([[1000] * 6, [0] * 6]))[2]) == 0


def clusters(rows: list[tuple], k: int, dim: int) -> list[tuple]:
    """(id, cluster, distance, inertia of the cluster, inertia, hash) of each row that counts."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    drawn = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in drawn[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(3):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(cs)):
            own = [v for (_, v), o in zip(kept, of) if o == n]
            if own:
                cs[n] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *near(v)) for i, v in kept]
    each = Counter()
    for _, d, n in last:
        each[n] += d
    return [(i, n, d, each[n], sum(each.values()), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for i, d, n in last]


@pytest.mark.parametrize("n", [0, 3, 700])
def test_clusters(spark, n):
    rng = random.Random(n)
    rows = [(rng.randint(0, 400), [rng.gauss(k % 5 - 2, 0.2) for _ in range(64)]) for k in range(n)]
    rows += rows[: n // 3] * 2 + [(9, v) for _, v in rows[:1]] * 50
    rows += [(None, [0.5] * 64)] * bool(n) + [(1, None), (2, []), (3, [0.1] * 63), (4, [0.1] * 65), (5, [0.1] * 63 + [None]), (6, [float("nan")] + [0.0] * 63), (7, [float("inf")] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string").repartition(3)
    got = balltree.cluster_report(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(clusters(rows, 16, 64), key=str)


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="in magnitude"):
        balltree.cluster_report(df).collect()


def plain_print(text: str | None) -> int:
    words = brute.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    n = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def groups(prints: list[int]) -> list[int]:
    """The number of the group of each fingerprint, by all pairs."""
    at = list(range(len(prints)))

    def root(k: int) -> int:
        while at[k] != k:
            k = at[k]
        return k

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            at[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(prints))]


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "one two", "a b c", "ÄÖ Straße x", "x " * 9, "a\x0bb\x0cc\x1cd e"]
    texts += [" ".join(rng.choice(["Ab", "c", "déf", "日本"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    texts.append(" ".join(str(rng.randint(0, 10**6)) for _ in range(simhash.CHUNK + 1000)))
    for t in texts:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain_print(t)


@pytest.mark.parametrize("hot", [1000, 8, 1])
def test_links(spark, hot):
    """Every pair within three bits, and no other, whether or not keys are split."""
    rng = random.Random(hot)
    prints = {0, -1, 1, 7, 15, -(1 << 63), (1 << 63) - 1}
    for _ in range(12):
        middle = rng.getrandbits(64)
        for _ in range(25):
            x = middle
            for b in rng.sample(range(64), rng.randint(0, 4)) if rng.random() < 0.6 else rng.sample(range(32), 5):
                x ^= 1 << b
            prints.add(x - (1 << 63))
    rows = sorted(prints)
    found, written = simhash.links(spark.createDataFrame([(x,) for x in rows], "fp long").repartition(2), hot=hot)
    got = {(min(r), max(r)) for r in map(tuple, found.collect())}
    assert got == {(a, b) for a, b in combinations(rows, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert bool(len(written) > 1) == (hot < 1000)


def test_simhash_groups(spark):
    rng = random.Random(2)
    rows: list[tuple[int | None, str | None]] = [(900, None), (901, ""), (None, " "), (None, "a b c d e f"), (40, "A b c d E f"), (40, "a b c d e f"), (None, "nobody else has this")]
    for k in range(12):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 900))]
        rows += [(k * 50 + j, " ".join(words if j < 2 else [f"v{j}" if i == j * 5 else w for i, w in enumerate(words)])) for j in range(8)]
    rng.shuffle(rows)
    prints = [plain_print(t) for _, t in rows]
    own = groups(prints)
    least: dict[int, int] = {}
    for (i, _), k in zip(rows, own):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    want = [(i, f"{p:016x}", least.get(k)) for (i, _), p, k in zip(rows, prints, own)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string").repartition(3)
    assert sorted(map(tuple, simhash.simhash_report(df).collect()), key=str) == sorted(want, key=str)
    assert len(set(least.values())) < len({p for p in prints})
    assert simhash.simhash_report(df.limit(0)).collect() == []


def audited(rows: list[tuple], least: int, top: int) -> list[tuple]:
    docs = [(lang or "", source or "", brute_terms(text)) for text, lang, source in rows]
    has, n = Counter(), Counter()
    for lang, source, ts in docs:
        has.update({(lang, t) for t in ts})
        n.update((lang, source, t) for t in ts)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for (x, t), c in has.items() if x == lang and c >= least]
        sources = sorted({d[1] for d in docs if d[0] == lang})
        spare = 2 * len(kept)
        scaled = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts.values()) + spare) for t in kept}
        by = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        p = {s: scaled(by[s]) for s in sources}
        q = scaled({t: sum(by[s][t] for s in sources) for t in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            best = [(-f(p[s][t], q[t]), t.encode()) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, got in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(got)]
    return out


def brute_terms(text: str | None) -> list[str]:
    out, now = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            out += [now] * bool(now)
            now = ""
        else:
            now += c.lower() if c.isascii() else c
    return out


@pytest.mark.parametrize("shard, block", [(16384, 32), (7, 2), (3, 1)])
def test_divergence(spark, shard, block):
    rng = random.Random(shard)
    vocabulary = [f"{a}{b}" for a in "abcdeÄé" for b in ("x", "Yz", "日", "q")]
    rows = [(None, "en", "s0"), ("", None, None), (None, None, "only"), ("rare words here", "xx", "a"), ("", "xx", "b"), ("", "xx", "c")]
    for k in range(160):
        text = " ".join(rng.choice(vocabulary[k % 9 :]) for _ in range(rng.randint(1, 40)))
        rows.append((text + "! 12 a1b", rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "ß", "s2", None, "z:9"])))
    rows += [rows[-1]] * 30
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "text string, lang string, source string, term int, n int, shard string").repartition(3)
    got = divergence.source_divergence(df, shard=shard, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(audited(rows, 10, 10))
    assert divergence.source_divergence(df.limit(0)).collect() == []


def test_scaled_counts_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        total = rng.randint(2, 9 * 10**15)
        count = rng.randint(0, total - 2)
        assert int(divergence.scaled(np.array([count]), total)[0]) == 1 + 10**9 * (count + 2) // total


def test_blocks_keep_their_vectors():
    b = divergence.Block(9, [("ä b\n", 3, np.array([0, 4, 8]), np.array([5, 6, 10**9 + 1])), ("", 1, np.zeros(0, np.int64), np.zeros(0, np.int64))])
    c = divergence.Block.unpacked(b.packed())
    assert c.terms == 9
    assert [(g[0], g[1], g[2].tolist(), g[3].tolist()) for g in c.groups] == [(g[0], g[1], g[2].tolist(), g[3].tolist()) for g in b.groups]
