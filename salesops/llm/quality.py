"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A grade y of 0 .. K-1 has P(y <= k) = sigmoid(threshold_k - w . x): one weight for every hashed feature,
shared by all grades, and ordered thresholds. From the K - 1 thresholds follow the expected grade and
the tail probability P(y >= good), by which documents are selected.

Features of a text are its distinct words in lower case, their beginnings, what its words look like
(letters, capitals and marks, by the share of such words) and how often a word repeats the one before.
Names are hashed; of the hashes those in enough of the rated texts are used. All of the text counts,
whatever its length.

The fit takes a sample of the rated documents bounded by ``max_train`` (the smallest hashes of doc_id).
Gradients are summed in tasks over the written features, and the driver moves the weights by L-BFGS: it holds
nothing but vectors of at most ``max_features`` numbers.

Defined results: null and empty texts have no features, their grade follows from the thresholds; ratings
of unknown documents, and null ratings, are not used; several ratings of one document are each an
example; without ratings, or with one grade only, every document gets the most frequent grade, the best
one if there is none. Repeated rows are judged alike; an empty table gives no rows; other columns pass
through ``select_good`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from salesops.llm.common import written


class Fit(NamedTuple):
    max_train: int = 12_000
    max_features: int = 30_000
    min_texts: int = 12
    ridge: float = 1.0
    steps: int = 25
    tasks: int = 6


class Model(NamedTuple):
    """Hashes of the features, ascending, their weights, and the ordered thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


# Letters of a beginning that stands for the word.
PREFIX = 5
_LOOKS = re.compile(r"[a-zß-öø-ÿœ]+|[A-ZÀ-ÖØ-ÞŒ]+|[0-9]+|[^\w]|\w+")


def _look(word: str) -> str:
    """What a word looks like: a for small letters, A for capitals, 0 for digits, marks as they are."""
    out = []
    for run in _LOOKS.findall(word)[:6]:
        c = run[0]
        kind = "0" if c.isdigit() else ("a" if c.islower() else "A") if c.isalpha() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def _share(part: int, whole: int) -> int:
    """0 for none, then higher by one for every doubling up to all."""
    return 0 if not part else max(1, 8 + int(np.ceil(np.log2(part / whole))))


class Features:
    """Hashed features of texts; looks of words are remembered, within bounds."""

    def __init__(self) -> None:
        self.looks: dict[str, str] = {}

    def of(self, text: str | None) -> list[int]:
        words = (text or "").split()
        if not words:
            return []
        n = len(words)
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        if len(self.looks) > 30_000:
            self.looks.clear()
        looks: dict[str, int] = {}
        names = set()
        for w, k in counts.items():
            look = self.looks.get(w)
            if look is None:
                look = self.looks[w] = _look(w)
            looks[look] = looks.get(look, 0) + k
            small = w.lower().strip(".,;:!?\"'()*%$&#|")
            names.add(small)
            if len(small) > PREFIX:
                names.add(small[:PREFIX] + "-")
        for look, k in looks.items():
            names.add(f"look {look} {_share(k, n)}")
        again = sum(map(str.__eq__, words[1:], words))
        names.add(f"again {_share(again, n)}")
        names.add(f"same {_share(max(counts.values()), n) if n > 20 else -1}")
        return sorted({xxh32_intdigest(x) for x in names})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Features()
    for batch in batches:
        found = [make.of(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("grade"), pa.array(found, pa.list_(pa.int64()))], names=["grade", "features"]
        )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def loss_and_gradient(
    scores: np.ndarray, grades: np.ndarray, thresholds: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood, its derivatives by every score, and by the thresholds."""
    bounds = np.concatenate([[-np.inf], thresholds, [np.inf]])
    high, low = bounds[grades + 1] - scores, bounds[grades] - scores
    upper, lower = _sigmoid(high), _sigmoid(low)
    p = np.maximum(upper - lower, 1e-12)
    slope_high, slope_low = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_threshold = np.bincount(grades, -slope_high, len(bounds) - 1)[: len(thresholds)]
    by_threshold += np.bincount(grades, slope_low, len(bounds) - 1)[1:]
    return float(-np.log(p).sum()), slope_high - slope_low, by_threshold


def _unpack(x: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights, and thresholds from the first one and the logarithms of the gaps between them."""
    cut = len(x) - (grades - 1)
    return x[:cut], x[cut] + np.concatenate([[0.0], np.cumsum(np.exp(x[cut + 1 :]))])


def _lbfgs(start: np.ndarray, value, steps: int, memory: int = 8) -> np.ndarray:
    """Minimise a smooth convex function; ``value`` gives the function and its gradient."""
    x, (f, g) = start, value(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction = -g
        kept = []
        for s, y in reversed(moves):
            a = (s @ direction) / (y @ s)
            direction = direction - a * y
            kept.append(a)
        if moves:
            s, y = moves[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction / max(1.0, np.abs(g).sum() ** 0.5)
        for (s, y), a in zip(moves, reversed(kept)):
            direction = direction + (a - (y @ direction) / (y @ s)) * s
        step = 1.0
        while True:
            there = x + step * direction
            f_there, g_there = value(there)
            if f_there <= f + 1e-4 * step * (g @ direction) or step < 1e-4:
                break
            step /= 4
        if f_there >= f:
            break
        if (there - x) @ (g_there - g) > 1e-10:
            moves = [*moves, (there - x, g_there - g)][-memory:]
        done = f - f_there < 1e-6 * abs(f)
        x, f, g = there, f_there, g_there
        if done:
            break
    return x


def fit(docs: DataFrame, ratings: DataFrame, grades: int, how: Fit = Fit()) -> Model:
    """Fit on documents (doc_id, text) rated in ``ratings`` (doc_id, grade)."""
    spark = docs.sparkSession
    rated = ratings.filter("grade IS NOT NULL AND doc_id IS NOT NULL")
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(how.max_train)
    chosen = written(chosen.select("doc_id", F.col("grade").cast("int").alias("grade")), "ratings")
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", "text").join(chosen, "doc_id")
    found = texts.select("grade", "text").mapInArrow(_features, "grade int, features array<long>")
    found = written(found, "rated-features")
    seen = found.groupBy("grade").count().collect()
    if len(seen) < 2:
        sure = seen[0]["grade"] if seen else grades - 1
        bounds = np.where(np.arange(grades - 1) < sure, -9.0, 9.0) + np.arange(grades - 1) * 1e-3
        return Model(np.zeros(0, np.int64), np.zeros(0), bounds)
    common = found.select(F.explode("features").alias("f")).groupBy("f").count().filter(F.col("count") >= how.min_texts)
    rows = common.orderBy(F.desc("count"), "f").limit(how.max_features).collect()
    hashes = np.sort(np.array([r["f"] for r in rows], dtype=np.int64))
    counts = np.zeros(grades)
    for r in seen:
        counts[r["grade"]] = r["count"]
    below = np.clip(np.cumsum(counts)[:-1] / counts.sum(), 1e-3, 1 - 1e-3)
    bounds = np.log(below / (1 - below)) + np.arange(grades - 1) * 1e-3
    start = np.concatenate([np.zeros(len(hashes)), bounds[:1], np.log(np.maximum(np.diff(bounds), 1e-3))])
    placed = _placed(found, spark.sparkContext.broadcast(hashes), how.tasks)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, thresholds = _unpack(x, grades)
        k = len(weights)
        shared = spark.sparkContext.broadcast((weights, thresholds))
        total, gradient = 0.0, np.zeros(len(x))
        for loss, by_weight, by_threshold in _parts(placed, shared):
            total += loss
            gradient[:k] += by_weight
            gradient[k] += by_threshold.sum()
            after = by_threshold[::-1].cumsum()[::-1][1:]
            gradient[k + 1 :] += after * np.exp(x[k + 1 :])
        shared.destroy()
        return total + 0.5 * how.ridge * (weights @ weights), gradient + np.pad(how.ridge * weights, (0, len(x) - k))

    best = _lbfgs(start, value, how.steps)
    weights, thresholds = _unpack(best, grades)
    return Model(hashes, weights, thresholds)


def _placed(found: DataFrame, hashes, tasks: int) -> DataFrame:
    """The written examples with places in the weights instead of hashes, a few large rows per task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hashes.value
        for batch in batches:
            lists = batch.column("features")
            values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = np.searchsorted(known, values)
            held = np.zeros(len(values), dtype=bool) if not len(known) else known[np.minimum(at, len(known) - 1)] == values
            sums = np.concatenate([[0], np.cumsum(held)])[offsets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("grade").to_numpy().tolist()], pa.list_(pa.int32())),
                    pa.array([sums], pa.list_(pa.int64())),
                    pa.array([at[held]], pa.list_(pa.int32())),
                ],
                names=["grades", "offsets", "places"],
            )

    spread = found.repartition(tasks)
    return written(spread.mapInArrow(rows, "grades array<int>, offsets array<long>, places array<int>"), "examples")


def _parts(placed: DataFrame, shared) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Loss and gradient of every task, in a fixed order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                grades, offsets, places = (batch.column(c)[i].values.to_numpy() for c in range(3))
                owner = np.repeat(np.arange(len(grades)), np.diff(offsets))
                scores = np.bincount(owner, weights[places], len(grades))
                loss, by_score, by_threshold = loss_and_gradient(scores, grades, thresholds)
                by_weight = np.bincount(places, by_score[owner], len(weights))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(places.astype(np.int64).sum())], pa.int64()),
                        pa.array([loss], pa.float64()),
                        pa.array([by_weight.tobytes()], pa.binary()),
                        pa.array([by_threshold.tobytes()], pa.binary()),
                    ],
                    names=["at", "loss", "w", "t"],
                )

    found = placed.mapInArrow(rows, "at long, loss double, w binary, t binary").collect()
    for row in sorted(found, key=lambda r: (r["at"], r["loss"])):
        yield row["loss"], np.frombuffer(row["w"]), np.frombuffer(row["t"])


class Scorer:
    def __init__(self, model: Model):
        self.features = Features()
        self.weight = dict(zip(model.hashes.tolist(), model.weights.tolist()))
        self.thresholds = model.thresholds

    def tails(self, texts: Iterator[str | None]) -> np.ndarray:
        """P(y >= 1), ..., P(y >= K - 1) of every text."""
        get = self.weight.get
        scores = np.array([sum(get(f, 0.0) for f in self.features.of(t)) for t in texts], dtype=float)
        return 1 - _sigmoid(self.thresholds[None, :] - scores[:, None])


def score(docs: DataFrame, model: Model, good: int) -> DataFrame:
    """Rows (doc_id, expected_grade, p_good): p_good is P(grade >= good)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            tails = scorer.tails(t.as_py() for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, good - 1])],
                names=["doc_id", "expected_grade", "p_good"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(rows, "doc_id long, expected_grade double, p_good double")


def select_good(docs: DataFrame, model: Model, good: int, at_least: float = 0.5) -> DataFrame:
    """The documents with P(grade >= good) of at least so much, with all of their columns."""
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            tails = scorer.tails(t.as_py() for t in batch.column(column))
            yield batch.filter(pa.array(tails[:, good - 1] >= at_least))

    return docs.mapInArrow(rows, docs.schema)


# Grades of the ratings table: a point for quality and one for not being toxic.
GRADES = 3


def grade() -> Column:
    return (F.col("quality") + 1 - F.col("toxic")).cast("int")


def ratings_of(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", grade().alias("grade"))
