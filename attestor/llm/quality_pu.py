"""Quality classifier by positive-unlabelled learning.

A small network learns from trusted positives and unlabelled texts alone. It minimises the non-negative
unbiased risk  prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]),  where the prior, the
share of positives among unlabelled texts, is estimated from the scores that a model gives trusted positives and
unlabelled texts it has not seen; labelled negatives serve for nothing. With the logistic loss the output is the
probability of label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.tables import by_size, in_small_batches

#: Bounds of the sample that the model is fitted on.
POSITIVES, UNLABELLED = 12_000, 24_000
THRESHOLD = 0.3
#: The prior that the first model of the scores is fitted with.
FIRST_PRIOR = 0.5
FOLDS = 5
HIDDEN, STEPS, BATCH, RATE, DECAY = 32, 1500, 512, 3e-3, 1e-4
BATCH_BYTES = 1 << 20

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = [set(range(0x61, 0x7B)), set(range(0x41, 0x5B)), set(range(0x30, 0x3A)), {0x20}, {0x09, 0x0A, 0x0D}, set(range(0xC0, 0x100)), set(range(0x20)) - {0x09, 0x0A, 0x0D}, *({c} for c in _PUNCTUATION)]
_BY_CLASS = np.array([[c in k for k in _CLASSES] for c in range(256)], np.float64)


def features(texts: list[bytes | None]) -> np.ndarray:
    """Figures of whole texts: shares of byte classes, repetition of words and lines, lengths."""
    counts = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), 11))
    for i, text in enumerate(texts):
        text = text or b""
        counts[i] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words, lines = text.split(), [x for x in text.split(b"\n") if x]
        n, unique, nl = max(1, len(words)), set(words), max(1, len(lines))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
        rest[i] = (
            math.log1p(len(text)),
            math.log1p(len(words)),
            math.log1p(len(lines)),
            len(unique) / n,
            sum(map(eq, words, words[1:])) / n,
            len(set(lines)) / nl,
            sum(map(bytes.isalnum, words)) / n,
            sum(x[-1:] in b".!?:;\"" for x in lines) / nl,
            lengths.mean(),
            lengths.std(),
            math.log1p(len(unique)),
        )
    share = counts @ _BY_CLASS / np.maximum(1, counts.sum(1, keepdims=True))
    return np.hstack([np.log(share + 1e-3), share[:, :6], rest])


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        z = np.maximum(0, np.clip((x - self.mean) / self.scale, -8, 8) @ w + b) @ v + c
        return 1 / (1 + np.exp(-np.clip(z[:, 0], -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 1) -> Model:
    """Stochastic gradient descent (Adam) on the non-negative risk; where a batch's negative risk falls below 0, its gradient is undone."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    d = p.shape[1]
    params = [rng.normal(0, math.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, 1)), np.array([math.log(prior / (1 - prior))])]
    first, second = [np.zeros_like(w) for w in params], [np.zeros_like(w) for w in params]
    averaged = [np.zeros_like(w) for w in params]
    steps = kept = 0
    batches = max(1, len(u) // BATCH)
    epochs = -(-STEPS // batches)
    for epoch in range(epochs):
        orders = rng.permutation(len(p)), rng.permutation(len(u))
        for i in range(batches):
            steps += 1
            xp, xu = (x[o[i * len(o) // batches : (i + 1) * len(o) // batches]] for x, o in zip((p, u), orders, strict=True))
            if not len(xp) or not len(xu):
                continue
            x = np.vstack([xp, xu])
            h = np.maximum(0, x @ params[0] + params[1])
            s = 1 / (1 + np.exp(-np.clip((h @ params[2] + params[3])[:, 0], -30, 30)))
            sp, su = s[: len(xp)], s[len(xp) :]
            negative = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
            g_plus = np.concatenate([prior * (sp - 1) / len(xp), np.zeros(len(xu))])
            g_minus = np.concatenate([-prior * sp / len(xp), su / len(xu)])
            g = (g_plus + g_minus if negative >= 0 else -g_minus)[:, None]
            gh = g @ params[2].T * (h > 0)
            grads = [x.T @ gh + DECAY * params[0], gh.sum(0), h.T @ g + DECAY * params[2], g.sum(0)]
            rate = RATE * (1 - epoch / epochs) + RATE / 50
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
            if epoch >= epochs * 3 // 4:
                kept += 1
                averaged = [a + (w - a) / kept for a, w in zip(averaged, params, strict=True)]
    return Model(mean, scale, averaged if kept else params)


def prior_from_scores(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled scores: where the ratio of those beyond a threshold, of the unlabelled to the
    positives, has its least upper confidence bound, negatives beyond it are fewest."""
    p, u = np.sort(positive), np.sort(unlabelled)
    at = p[: max(1, int(0.9 * len(p)))]
    beyond_p, beyond_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    ratio = beyond_u / beyond_p
    bound = ratio + (math.sqrt(math.log(40) / (2 * len(u))) + ratio * math.sqrt(math.log(40) / (2 * len(p)))) / beyond_p
    return float(ratio[np.argmin(bound)])


def learn(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A model with a cautious prior: what scores show, less two standard errors.

    The scores are those of a model that learnt from the other half of the rows, first with FIRST_PRIOR, then with the
    prior so found. A prior that is too high lets negatives pass at no risk, one that is a little too low only narrows
    the margin.
    """
    if min(len(positive), len(unlabelled)) < 20:
        return fit(positive, unlabelled, FIRST_PRIOR)
    prior = FIRST_PRIOR
    for _ in range(2):
        half = fit(positive[::2], unlabelled[::2], min(0.99, max(0.01, prior)))
        prior = prior_from_scores(half.score(positive[1::2]), half.score(unlabelled[1::2]))
    prior -= 2 * math.sqrt(max(0.0, prior * (1 - prior)) / len(unlabelled[1::2]))
    return fit(positive, unlabelled, min(0.99, max(0.01, prior)))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0; true also for a null id, which is never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(True))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "text", BATCH_BYTES):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(features(batch.column("text").to_pylist()).tolist(), pa.list_(pa.float64()))], ["doc_id", "positive", "x"])


def train(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """A model from the texts of at most `positives` trusted rows and `unlabelled` others, each chosen by least hash of
    the id; None without trusted positives or unlabelled rows."""
    in_small_batches(docs)
    usable = labels.where(~held_out(F.col("doc_id")) & (F.col("quality") == 1))
    trusted = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(positives)
    others = docs.select("doc_id").where(~held_out(F.col("doc_id"))).distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(unlabelled)
    chosen = trusted.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text")
    # one row for each chosen id, however many rows repeat it
    rows = texts.mapInArrow(_features_of, "doc_id long, positive boolean, x array<double>").groupBy("doc_id", "positive").agg(F.min("x").alias("x")).toArrow()
    if not rows.num_rows:
        return None
    x, positive = np.array(rows.column("x").combine_chunks().flatten().to_numpy()).reshape(rows.num_rows, -1), np.array(rows.column("positive").to_pylist(), bool)
    if not positive.any() or positive.all():
        return None
    order = np.lexsort(x.T)  # the same sums whatever order the rows came in
    x, positive = x[order], positive[order]
    return learn(x[positive], x[~positive])


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted.

    A null text is scored as an empty one, a text of any length by figures of all of it. Without a model, because no
    trusted positive may be learnt from, every score is 0.5. Repeated rows are scored alike; where a document has
    several labels, one of quality 1 makes it a trusted positive. Rows without an id are held out. Other columns,
    whatever their names, are not read; an empty table gives an empty result.
    """
    model = model or train(docs.select("doc_id", "text"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            scores = model.score(features(texts)) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches the threshold."""
    model = train(docs.select("doc_id", "text"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", BATCH_BYTES):
            texts = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
            scores = model.score(features(texts)) if model else np.full(len(texts), 0.5)
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
