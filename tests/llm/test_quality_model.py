"""The quality classifier restated with plain numbers and dicts, and its accuracy on rows it hasn't seen."""

from __future__ import annotations

import math
import os
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from kerf.llm import quality

MASK = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def shape(word: bytes) -> bytes:
    return bytes(ord("9") if c in b"0123456789" else ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else c for c in word)


def plain_features(text: str | None) -> dict[int, float]:
    """Value of each place; place 0 is the bias."""
    words = (text or "").encode().split()
    own = [xxhash.xxh64_intdigest(w.lower()) for w in words]
    form = [xxhash.xxh64_intdigest(b"\0" + shape(w)[:1] + shape(w)[-3:]) for w in words]
    grams = own + form + [(a * ODD + b) & MASK for x in (own, form) for a, b in zip(x, x[1:])]
    n = Counter(1 + ((g * ODD & MASK) >> (64 - quality.BITS)) % ((1 << quality.BITS) - 1) for g in grams)
    return {0: 1.0} | {k: float(np.float32(quality.SCALE * c / max(1, len(grams)))) for k, c in n.items()}


class PlainLearner:
    def __init__(self, p: quality.Ftrl) -> None:
        self.p, self.z, self.n = p, {}, {}

    def weight(self, k: int) -> float:
        z, n = self.z.get(k, 0.0), self.n.get(k, 0.0)
        if abs(z) <= self.p.l1:
            return 0.0
        return -(z - math.copysign(self.p.l1, z)) / ((self.p.beta + math.sqrt(n)) / self.p.alpha + self.p.l2)

    def score(self, values: dict[int, float]) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(self.weight(k) * v for k, v in values.items())))))

    def learn(self, values: dict[int, float], label: int) -> None:
        off = self.score(values) - label
        for k, v in values.items():
            w, g, n = self.weight(k), off * v, self.n.get(k, 0.0)
            self.z[k] = self.z.get(k, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.p.alpha * w
            self.n[k] = n + g * g


def plain_model(docs: list[tuple], labels: list[tuple], sample: int) -> PlainLearner:
    """All labels but held-out ones, the lowest hashes of ids first; each label meets each row of its document."""
    pick = lambda i: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))[0]
    allowed = sorted((pick(i), i, y) for i, y in labels if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 5 != 0)[:sample]
    rows = [(p, y, t) for p, i, y in allowed for d, t in docs if d == i]
    rows.sort(key=lambda r: (r[0], r[1], quality.features(r[2])[0].tobytes()))
    model = PlainLearner(quality.Ftrl())
    for epoch in range(model.p.epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            model.learn(plain_features(rows[k][2]), rows[k][1])
    return model


def test_updates():
    """One example after the other, with weights that come back to nought and repeated examples."""
    rng = random.Random(1)
    ours, plain = quality.Learner(quality.Ftrl()), PlainLearner(quality.Ftrl())
    texts = [" ".join(rng.choices(["the", "Mill", "9x", "BUY", "now!", "é"], k=rng.randint(0, 12))) for _ in range(12)]
    for _ in range(150):
        t, y = rng.choice(texts), rng.randint(0, 1)
        at, value = quality.features(t)
        values = plain_features(t)
        assert {int(k): float(v) for k, v in zip(at, value)} == pytest.approx(values)
        ours.learn(at, value.astype(np.float64), y)
        plain.learn(values, y)
    w = ours.weights()
    assert {int(k): float(w[k]) for k in np.flatnonzero(w)} == pytest.approx({k: plain.weight(k) for k in plain.z if plain.weight(k)}, abs=1e-9)


@pytest.mark.parametrize("sample", [quality.SAMPLE, 25])
def test_report(spark, sample):
    """Scores of all rows: ties of ids, labels that repeat or disagree, ids that repeat, nulls, a very long text."""
    rng = random.Random(sample)
    words = ["the", "river", "Old", "mill", "9", "BUY", "###", "click", "now!!"]
    docs = [(i, " ".join(rng.choices(words[: rng.randint(2, 9)], k=rng.randint(0, 30)))) for i in range(60)]
    docs += docs[:5] + [(3, "another text of three"), (61, None), (62, ""), (63, " \t"), (None, "the mill"), (64, "river mill " * 40_000)]
    labels = [(i, rng.randint(0, 1)) for i in range(58)] + [(7, 0), (7, 1), (7, 1), (64, 1), (61, 0), (None, 1), (9, None), (10, 5), (999, 1)]
    model = plain_model(docs, labels, sample)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, y string").repartition(3)
    y = spark.createDataFrame([(i, q, 1, "x") for i, q in labels], "doc_id long, quality int, toxic int, text string").repartition(2)
    weights = quality.fit(d, y, ~quality.held_out("id"), sample)
    got = sorted(((r["doc_id"], r["score"]) for r in quality.score(d, weights).collect()), key=str)
    want = sorted(((i, model.score(plain_features(t))) for i, t in docs), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert sorted(s for _, s in got) == pytest.approx(sorted(s for _, s in want), abs=1e-4)
    if sample == quality.SAMPLE:
        report = {(r["doc_id"], round(r["score"], 4)): r for r in quality.quality_report(d, y).collect()}
        assert all(r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for (i, _), r in report.items())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no tables here")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.quality_report(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 50
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    print("held out:", len(rows), right)
    assert right > 0.85
