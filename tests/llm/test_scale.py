"""What must hold at any size: rows keep their numbers, and time follows the length of a text."""

from __future__ import annotations

import random
import time
from itertools import cycle

import pytest
from pyspark.sql import functions as F

from kerf.llm import common, decontam, neardup, repeats, secrets
from tests.llm import brute
from tests.llm.test_corpus_ops import corpus


@pytest.fixture
def many_files(spark, tmp_path):
    """A table of twelve files, and a session whose parallelism changes whenever a step is written."""
    rows = corpus(11, 30)
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(60))
    rows = [(i, t if t is None or i % 7 else f"{t} {passage} {i}") for i, t in rows]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(path)
    return rows, path


@pytest.fixture
def changing(spark, monkeypatch):
    turns = cycle((4, 3, 7, 2, 16, 1))
    plain = common.materialize

    def materialize(df, name):  # noqa: ANN001, ANN202
        out = plain(df, name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(next(turns)))
        spark.conf.set("spark.sql.files.openCostInBytes", str(next(turns) * 1000))
        return out

    for module in (common, repeats, neardup):
        monkeypatch.setattr(module, "materialize", materialize)
    yield
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_stay(spark, many_files):
    rows, path = many_files
    seen = []
    for parallel in (4, 3, 16):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(parallel))
        df = common.numbered(spark.read.parquet(path).where("doc_id >= 0"), "doc_id_")
        seen.append({tuple(r) for r in df.select("doc_id", "doc_id_").collect()})
        assert len({k for _, k in seen[-1]}) == len(rows) and min(k for _, k in seen[-1]) >= 0
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert seen[0] == seen[1] == seen[2]
    # A file that is read twice, and an input with a column of the name of Spark's own, are written first.
    for df in (spark.read.parquet(path, path), spark.read.parquet(path).withColumn("_metadata", F.lit(1)), spark.read.parquet(path).unionAll(spark.read.parquet(path))):
        got = common.numbered(df)
        assert got.columns == [*df.columns, "row"]
        assert got.select("row").distinct().count() == df.count()


def test_near_duplicates_while_executors_change(spark, many_files, changing):
    rows, path = many_files
    got = neardup.near_duplicates(spark.read.parquet(path)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(w[:3] for w in brute.near(rows))
    kept = neardup.distinct_documents(spark.read.parquet(path), percent=85)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in brute.near(rows)})


def test_repeats_while_executors_change(spark, many_files, changing):
    rows, path = many_files
    got = repeats.without_repeats(spark.read.parquet(path)).collect()
    want = brute.repeats(rows, 100)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"]))) for r in got) == sorted(want)
    assert sum(r["n_removed"] for r in got) > 0


def test_secrets_of_a_long_text():
    """Hex strings and long tokens, 700 KB: base spans as the patterns say, in time that follows the length."""
    rng = random.Random(2)
    hexes = [f"{rng.getrandbits(128):032x}" for _ in range(20_000)]
    began = time.perf_counter()
    found = secrets.candidates(" ".join(hexes))
    assert time.perf_counter() - began < 3
    assert [(k, a, b) for k, a, b, _ in found] == [("hex", 33 * i, 33 * i + 32) for i in range(20_000)]
    began = time.perf_counter()
    secrets.candidates("eyJ" * 200_000)
    secrets.candidates("-----BEGIN PRIVATE KEY-----" * 20_000)
    assert time.perf_counter() - began < 3


def test_entropy_spans_keep_clear_of_others():
    rng = random.Random(3)
    pieces = ["token=", " ", "AKIA", ".", "\n", "==", "deadbeef" * 4]
    for _ in range(300):
        text = "".join(rng.choice([*pieces, "".join(rng.choices("abcXYZ0189_-/+", k=rng.randint(5, 40)))]) for _ in range(12))
        found = secrets.candidates(text)
        others = [(a, b) for k, a, b, _ in found if k != "entropy"]
        want = [
            (m.start(), m.end())
            for m in secrets.LONG.finditer(text)
            if secrets._mixed(m[0]) and secrets.entropy(m[0]) >= secrets.MIN_ENTROPY and not any(a < m.end() and m.start() < b for a, b in others)
        ]
        assert [(a, b) for k, a, b, _ in found if k == "entropy"] == want


def hits(items: list[tuple[int, str]], words: list[str], window: int = 10) -> tuple[list[int], list[int]]:
    hit, ids = set(), set()
    for i, t in items:
        own = t.split()
        n = min(window, len(own))
        for a in range(len(own) - n + 1 if own else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[a : a + n]:
                    hit |= set(range(p, p + n))
                    ids.add(i)
    return sorted(hit), sorted(ids)


@pytest.mark.parametrize("seed", range(40))
def test_shared_runs(seed):
    """Items of very few different words, so that most runs are shared by most items."""
    rng = random.Random(seed)
    some = "abc"
    base = rng.choices(some, k=8)
    items = [(k, " ".join((base if rng.random() < 0.5 else []) + rng.choices(some[: rng.randint(1, 3)], k=rng.randint(0, 25)))) for k in range(rng.choice([3, 40]))]
    words: list[str] = []
    for _ in range(6):
        own = rng.choice(items)[1].split()
        at = rng.randint(0, len(own))
        words += rng.choices(some, k=rng.randint(0, 20)) + own[at : at + rng.randint(1, 30)]
    n, hit, _, ids = decontam.scan(iter([decontam.Matcher(items)]), [" ".join(words)])[0]
    assert (n, (hit, ids)) == (len(words), hits(items, words))


def test_items_with_a_shared_beginning():
    """4,000 items that begin alike cost about what 4,000 different ones do."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    same = "which of the following statements is true about"
    text = " ".join(" ".join(rng.choices(words, k=6)) + " " + same for _ in range(4000))
    took = []
    for front in (lambda: same, lambda: " ".join(rng.choices(words, k=8))):
        matcher = decontam.Matcher([(k, front() + " " + " ".join(rng.choices(words, k=14))) for k in range(4000)])
        began = time.perf_counter()
        assert decontam.scan(iter([matcher]), [text])[0][0] == 14 * 4000
        took.append(time.perf_counter() - began)
    assert took[0] < 2 * took[1] + 0.2
