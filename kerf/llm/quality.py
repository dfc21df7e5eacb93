"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

Features are word unigrams and bigrams of the whole text, and the same of coarse word
shapes, hashed into ``2 ** BITS`` weights. Each counts by its share of all features of the
document. A document with no words has the bias alone.

Fitting reads at most ``sample`` labelled rows (a documented bound: the labels'
information saturates and the fit is one task), chosen by a hash of their id over
all labelled rows, so the choice doesn't depend on how rows are stored. Features of
the sample are made in parallel; one task then runs the updates over them in the
order of the hash. Weights have a fixed size and are broadcast; scoring is a sparse
dot product in one pass over all documents, without a shuffle.

Null text counts as empty. Labels of unknown documents, null labels and labels other
than 0 and 1 are ignored; a document labelled several times is trained on as often.
Without labels all scores are 0.5. Repeated rows give repeated results. The label
and text columns alone are read, so other columns neither clash nor leak.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kerf.llm.common import filter_rows, id_and_text, map_rows, materialize, short_batches

BITS = 18
#: Labelled rows that are trained on at most.
SAMPLE = 20_000
THRESHOLD = 0.3
#: Sum of a document's feature values.
SCALE = 20.0


@dataclass(frozen=True)
class Ftrl:
    """Step sizes and penalties of the follow-the-regularised-leader updates."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 4


#: Digits, capitals, and all other letters look alike in a word's shape.
_SHAPE = bytes(
    0x39 if c in b"0123456789" else 0x58 if 0x41 <= c <= 0x5A else 0x78 if 0x61 <= c <= 0x7A or c >= 0x80 else c for c in range(256)
)


class _Words(dict):
    """Number of each word seen, for tables of its hash and its shape's hash; bounded."""

    LIMIT = 150_000

    def __init__(self) -> None:
        super().__init__()
        self.own = np.zeros(1 << 16, np.uint64)
        self.shape = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        if k >= len(self.own):
            self.own, self.shape = (np.concatenate([x, np.zeros(len(x), np.uint64)]) for x in (self.own, self.shape))
        shape = word.translate(_SHAPE)
        self.own[k] = xxhash.xxh64_intdigest(word.lower())
        self.shape[k] = xxhash.xxh64_intdigest(b"\0" + shape[:1] + shape[-3:])
        return k


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def places(text: str | None) -> np.ndarray:
    """Place of the weight of each n-gram of the text, as often as it occurs."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    known = _words()
    if len(known) > known.LIMIT:
        known.clear()
    k = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    own, shape = known.own[k], known.shape[k]
    odd = np.uint64(0x9E3779B97F4A7C15)
    mixed = np.concatenate([own, shape, own[:-1] * odd + own[1:], shape[:-1] * odd + shape[1:]]) * odd
    return 1 + ((mixed >> np.uint64(64 - BITS)) % np.uint64((1 << BITS) - 1)).astype(np.uint32)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of weights, each once, and values. Place 0 is the bias."""
    ids, n = np.unique(places(text), return_counts=True)
    value = SCALE * n / max(1, n.sum())
    return np.concatenate([np.zeros(1, np.uint32), ids.astype(np.uint32)]), np.concatenate([[1.0], value]).astype(np.float32)


def margin(weights: np.ndarray, text: str | None) -> float:
    """The dot product of weights and features."""
    at = places(text)
    return float(weights[0]) + (SCALE * float(weights[at].mean()) if len(at) else 0.0)


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Learner:
    """FTRL-proximal: keeps sums of gradients and of their squares, weights follow from them."""

    def __init__(self, p: Ftrl) -> None:
        self.p = p
        self.z = np.zeros(1 << BITS)
        self.n = np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        p, z, n = self.p, self.z[at], self.n[at]
        w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
        return np.where(np.abs(z) <= p.l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ value)) - label) * value
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = grown


def sample_of(docs: DataFrame, labels: DataFrame, allowed: Column | None, sample: int, label: str = "quality") -> DataFrame:
    """``pick, doc_id, y, text`` of at most ``sample`` labelled documents."""
    y = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    if allowed is not None:
        y = y.where(allowed)
    # The bound comes before texts move: hashes are compared, ties broken by id.
    picked = y.withColumn("pick", F.xxhash64("id")).orderBy("pick", "id", "y").limit(sample)
    # At most ``sample`` ids, so they may be broadcast, and no text is shuffled.
    return id_and_text(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("pick", "doc_id", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = SAMPLE, params: Ftrl = Ftrl()) -> np.ndarray:
    """Weights as float32. ``allowed`` is a condition over ``id``, the label's document."""
    rows = sample_of(docs, labels, allowed, sample)

    def make():  # noqa: ANN202
        def step(cols: dict[str, list]) -> dict[str, list]:
            made = [features(t) for t in cols["text"]]
            return {"pick": cols["pick"], "y": cols["y"], "at": [a.tobytes() for a, _ in made], "value": [v.tobytes() for _, v in made]}

        return step

    made = materialize(map_rows(rows, make, "pick long, y int, at binary, value binary"), "quality-sample")
    short_batches(docs.sparkSession)
    out = StructType.fromDDL("weights binary")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in batches:
            seen += zip(*(b.column(c).to_pylist() for c in ("pick", "y", "at", "value")))
        seen.sort(key=lambda r: r[:3])
        learner = Learner(params)
        for epoch in range(params.epochs):
            for k in np.random.default_rng(epoch).permutation(len(seen)):
                _, y, at, value = seen[k]
                learner.learn(np.frombuffer(at, np.uint32), np.frombuffer(value, np.float32).astype(np.float64), y)
        yield pa.RecordBatch.from_arrays([pa.array([learner.weights().astype(np.float32).tobytes()])], schema=to_arrow_schema(out))

    got = made.coalesce(1).mapInArrow(train, out).collect()
    return np.frombuffer(got[0]["weights"], np.float32) if got else np.zeros(1 << BITS, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():  # noqa: ANN202
        w = shared.value

        def step(cols: dict[str, list]) -> dict[str, list]:
            scores = []
            for t in cols["text"]:
                scores.append(float(sigmoid(margin(w, t))))
            return cols | {"score": scores}

        return step

    return map_rows(id_and_text(docs), make, "doc_id long, score double")


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():  # noqa: ANN202
        w = shared.value
        return lambda cols: [float(sigmoid(margin(w, t))) >= threshold for t in cols[text_col]]

    return filter_rows(docs, [text_col], make)


def held_out(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % 5 == 0


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights = fit(docs, labels, ~held_out("id"))
    got = score(docs, weights)
    return got.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
