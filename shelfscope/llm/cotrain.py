"""Quality classifier by co-training two views of a page.

The content view sees what the text is made of (shares of symbols, capitals,
digits, marks; word lengths; repetition); the metadata view sees what
surrounds it (language, source, length, lines).  Each view has a logistic
classifier.  Starting from the labelled documents, every round lets each
classifier label anew all unlabelled documents outside the held-out ids, and
hands every one it is sure of to the *other* classifier for training.  In the
end both are calibrated on labelled documents and their log odds are added,
each weighed by how well it does there; every document gets a score.

Features of every whole text are computed once and kept in the shared folder.
Fitting reads at most ``SAMPLE`` labelled documents (those with the smallest
hash of their id) and all unlabelled ones: a Newton step adds up gradient and
Hessian over the partitions of their features, so only sums reach the driver.
Handed-over labels of a class weigh together at most as much as the given ones
of that class, and none more than a given one, so that they neither drown
these on large tables nor shift the classes' proportion.

Defined results: null and blank texts have zero content features; null language
and source are values like others; null labels are ignored, a document labelled
more than once is good only if every label says so; with one class among the
labels every score is that class's smoothed share; repeated rows score alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import id_remainder, stored, text_batches, utf8

SAMPLE = 8000   # labelled documents used for fitting, at most
ROUNDS = 5
SURE = 0.95      # least confidence of a pseudo-label
STEPS = 25       # Newton steps of a round, at most
SETTLED = 1e-4   # a step that changes no weight by more ends the round
_MERGERS = 16    # tasks that add up the sums of the partitions
_HASHED = 32     # buckets of the language and source names
_PIECE = 8 << 20

_KINDS = {"symbol": b"#*$%&|<>", "digit": b"0123456789", "mark": b".,;:?", "shout": b"!",
          "capital": bytes(range(65, 91)), "bracket": b"()[]{}\"'"}


def content(text: bytes) -> list[float]:
    """Content view of a text."""
    words = text.split()
    if not words:
        return [0.0] * (len(_KINDS) + 6)
    n = len(words)
    size = sum(map(len, words))
    distinct = len(set(words))
    counts = [size - len(text.translate(None, k)) + len(text) - size for k in _KINDS.values()]
    runs = sum(a == b for a, b in zip(words, words[1:]))
    return [math.log1p(20 * c / size) for c in counts] + [
        size / n / 10, distinct / n, math.log1p(20 * runs / n), math.log1p(n) / 5,
        distinct / math.sqrt(n) / 5, 1.0 if n < 20 else 0.0]


def metadata(text: bytes, lang: str | None, source: str | None) -> list[float]:
    """Metadata view: numbers, then the buckets of language and source."""
    from zlib import crc32

    lines = text.count(b"\n") + 1
    numbers = [math.log1p(len(text)) / 10, math.log1p(lines) / 5, math.log1p(len(text) / lines) / 10]
    names = [0.0] * (2 * _HASHED)
    names[crc32((lang or "").encode()) % _HASHED] = 1.0
    names[_HASHED + crc32((source or "").encode()) % _HASHED] = 1.0
    return numbers + names


def _feature_batches(batches):
    for batch in text_batches(batches, "text", _PIECE):
        texts = [t or b"" for t in utf8(batch.column("text"))]
        langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([content(t) for t in texts], pa.list_(pa.float32())),
             pa.array([metadata(t, a, b) for t, a, b in zip(texts, langs, sources)], pa.list_(pa.float32()))],
            names=["doc_id", "x", "m"])


def _views(batch) -> list[np.ndarray]:
    """Both views of a batch as arrays (documents by features)."""
    return [batch.column(c).flatten().to_numpy().astype(float).reshape(batch.num_rows, -1) for c in ("x", "m")]


def _summed(table: DataFrame, part, width: int) -> np.ndarray:
    """Sum over all batches of ``table`` of the ``width`` numbers that ``part`` makes of one."""
    def first(batches):
        from pyspark import TaskContext

        total = sum((part(b) for b in batches if b.num_rows), np.zeros(width))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([total], pa.list_(pa.float64()))], names=["part", "sums"])

    def merge(batches):
        total = sum((row for b in batches if b.num_rows
                     for row in b.column("sums").flatten().to_numpy().reshape(b.num_rows, -1)), np.zeros(width))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    # in the order of the partitions: floating-point sums depend on it
    sums = (table.mapInArrow(first, "part int, sums array<double>").repartition(_MERGERS, "part")
            .sortWithinPartitions("part").mapInArrow(merge, "sums array<double>").toArrow())
    return sum((np.asarray(row.values) for row in sums.column("sums")), np.zeros(width))


def _moments(batch) -> np.ndarray:
    return np.concatenate([[batch.num_rows], *(m for v in _views(batch) for m in (v.sum(axis=0), (v ** 2).sum(axis=0)))])


class Logistic:
    """Ridge logistic regression on standardised features and their squares, by Newton steps."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, ridge: float = 1.0):
        self.mean, self.std = mean, std
        self.w = np.zeros(2 * len(mean) + 1)
        self.keep = np.full(len(self.w), ridge)
        self.keep[-1] = 1e-6

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.hstack([z, z ** 2 / 6, np.ones((len(z), 1))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self._wide(x) @ self.w

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Count, log loss, gradient and Hessian (row by row) over documents with labels ``y``."""
        z = self._wide(x)
        odds = np.clip(z @ self.w, -30, 30)
        p = 1 / (1 + np.exp(-odds))
        return np.concatenate([[len(y), np.logaddexp(0, odds).sum() - y @ odds], z.T @ (p - y),
                               ((z * (p * (1 - p) + 1e-6)[:, None]).T @ z).ravel()])

    def step(self, sums: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss with the ridge, and the Newton step to subtract from the weights."""
        n = len(self.w)
        step = np.linalg.solve(sums[2 + n:].reshape(n, n) + np.diag(self.keep), sums[2:2 + n] + self.keep * self.w)
        return float(sums[1] + self.keep @ self.w ** 2 / 2), step


def _descend(models: list[Logistic], sums) -> bool:
    """Newton steps on all models, ``sums(models)`` giving what each is fitted to; a step that raises the
    loss is halved.  False if no model moved."""
    best = [(math.inf, m.w, np.zeros_like(m.w)) for m in models]
    for k in range(STEPS):
        for i, (model, own) in enumerate(zip(models, sums(models))):
            loss, step = model.step(own)
            at_least, w, last = best[i]
            best[i] = (loss, model.w, step) if loss <= at_least + 1e-9 * abs(loss) else (at_least, w, last / 2)
        moving = any(np.abs(step).max() >= SETTLED for _, _, step in best)
        for model, (_, w, step) in zip(models, best):
            model.w = w - step if moving and k + 1 < STEPS else w
        if not moving:
            return k > 0
    return True


def _handed(teachers: list[Logistic], students: list[Logistic]):
    """Sums of each student over the documents that the other view's teacher calls bad, then good."""
    def part(batch):
        views, out = _views(batch), []
        for k, student in enumerate(students):
            p = 1 / (1 + np.exp(-np.clip(teachers[1 - k].odds(views[1 - k]), -30, 30)))
            for value, sure in enumerate((1 - p >= SURE, p >= SURE)):
                out.append(student.sums(views[k][sure], np.full(int(sure.sum()), float(value))))
        return np.concatenate(out)
    return part


def _calibrated(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (log odds, label)."""
    x, w = np.column_stack([np.clip(odds, -30, 30), np.ones(len(odds))]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(2),
                                x.T @ (p - y) + 1e-2 * (w - [1, 0]))
    return float(w[0]), float(w[1])


class CoTrained:
    """Two views trained on each other's confident labels; ``views`` are arrays (documents by features),
    ``pool`` the unlabelled documents as a table ``x, m``."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, pool: DataFrame, rounds: int = ROUNDS):
        # the last quarter of the labelled documents is kept for calibration
        cut = max(1, len(y) * 3 // 4)
        given, told = [v[:cut] for v in views], y[:cut].astype(float)
        free = _summed(pool, _moments, 1 + 2 * sum(v.shape[1] for v in views))
        models, at = [], 1
        for v in given:
            d = v.shape[1]
            n = free[0] + len(v)
            mean = (free[at:at + d] + v.sum(axis=0)) / n
            square = (free[at + d:at + 2 * d] + (v ** 2).sum(axis=0)) / n
            models.append(Logistic(mean, np.sqrt(np.maximum(square - mean ** 2, 0)) + 1e-6))
            at += 2 * d
        _descend(models, lambda now: [m.sums(v, told) for m, v in zip(now, given)])
        self.pool, self.handed = int(free[0]), [0, 0]
        width = [2 + len(m.w) + len(m.w) ** 2 for m in models]
        weight = len(told) * np.array([1 - told.mean(), told.mean()])  # of the given labels, bad and good

        def sums(teachers):
            def both(students):
                parts = np.split(_summed(pool, _handed(teachers, students), 2 * sum(width)),
                                 [width[0], 2 * width[0], 2 * width[0] + width[1]])
                out = []
                for k, (student, v) in enumerate(zip(students, given)):
                    own = parts[2 * k:2 * k + 2]
                    self.handed[k] = int(own[0][0] + own[1][0])
                    out.append(student.sums(v, told) + sum(
                        min(1.0, w / max(1.0, s[0])) * s for w, s in zip(weight, own)))
                return out
            return both
        for _ in range(rounds):
            if not _descend(models, sums([copy(m) for m in models])):
                break
        self.models = models
        held = slice(cut, None) if 0 < y[cut:].sum() < len(y[cut:]) else slice(None)
        self.curves = [_calibrated(m.odds(v[held]), y[held]) for m, v in zip(models, views)]
        self.prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        # what a view adds to the prior is weighed by the log loss it saves on the held labels
        rate = 1 / (1 + math.exp(-self.prior))
        base = -np.mean(y[held] * math.log(rate) + (1 - y[held]) * math.log(1 - rate))
        self.weights = []
        for k, v in enumerate(views):
            q = np.clip(1 / (1 + np.exp(-self.view(k, v[held]))), 1e-6, 1 - 1e-6)
            loss = -np.mean(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q))
            self.weights.append(float(np.clip((base - loss) / base, 0, 1)) if base > 0 else 0.0)

    def view(self, k: int, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds of one view."""
        a, b = self.curves[k]
        return np.clip(a * np.clip(self.models[k].odds(x), -30, 30) + b, -30, 30)

    def odds(self, views: list[np.ndarray]) -> np.ndarray:
        return self.prior + sum(w * (self.view(k, v) - self.prior) for k, (w, v) in enumerate(zip(self.weights, views)))


def _score_batches(model: CoTrained | None, share: float):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if model is None or not n:
                own = [np.full(n, share)] * 3
            else:
                views = _views(batch)
                odds = [model.view(0, views[0]), model.view(1, views[1]), model.odds(views)]
                own = [1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in odds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, own)],
                                             names=["doc_id", "content_score", "metadata_score", "score"])
    return run


def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.5,
          sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, content_score, metadata_score, score, kept``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    features = stored(docs.select("doc_id", "text", "lang", "source").mapInArrow(
        _feature_batches, f"doc_id {id_type}, x array<float>, m array<float>"), "cotrain-features")
    told = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.min(F.col("quality").cast("int")).alias("quality")))
    train = id_remainder(F.col("doc_id"), modulus) != remainder
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = told.where(train).orderBy(*order).limit(sample).withColumnRenamed("doc_id", "_id")
    known = (features.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
             .select(F.xxhash64("doc_id").alias("o"), "x", "m", "quality").orderBy("o").toPandas())
    y = known["quality"].to_numpy(dtype=float)
    model, share = None, float((y.sum() + 1) / (len(y) + 2))
    if 0 < y.sum() < len(y):
        pool = features.join(told.select("doc_id"), "doc_id", "left_anti").where(F.col("doc_id").isNotNull() & train)
        views = [np.array(known[c].tolist(), float) for c in ("x", "m")]
        model = CoTrained(views, y, stored(pool.select("x", "m"), "cotrain-pool"), rounds)
    held_out = F.coalesce(id_remainder(F.col("doc_id"), modulus) == remainder, F.lit(False))
    scored = features.mapInArrow(
        _score_batches(model, share), f"doc_id {id_type}, content_score double, metadata_score double, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "content_score", "metadata_score", "score",
                         (F.col("score") >= threshold).alias("kept"))
