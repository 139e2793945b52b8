"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.durable import durable
from riskloom.llm.common import fresh

BUCKETS = 1 << 15       # rows of the embedding table; the last one more is the padding
DIMENSION = 12
WIDTHS = (1, 2, 3)
FILTERS = 8             # filters of each width
PREFIXES = (4, 5)       # a word's vector is the sum of those of the word and of these leading characters
MARKS = ".,;:!?\"'()[]{}<>*_-#%&"
PAD = max(WIDTHS) - 1
STEPS, BATCH, RATE = 600, 48, 0.1
SAMPLE_DOCS = 6000      # the training sample: at most this many documents, half of each label,
SAMPLE_BYTES = 48 << 20     # at most this much text in all
SAMPLE_TEXT = 1 << 16       # and no text longer than this; scoring has no such bounds
FLUSH = 1 << 16         # words convolved at a time
CACHE = 1 << 17         # words whose projections a Python worker remembers


def buckets(word: str) -> list[int]:
    """The embedding rows of a lower-case word."""
    bare = word.strip(MARKS) or word
    return [crc32(x.encode()) % BUCKETS for x in (bare, *(f"{n}:{bare[:n]}" for n in PREFIXES))]


@dataclass
class ToxicityModel:
    """Weights, the calibration of the logit, and the thresholds of rejection by language."""

    embeddings: np.ndarray                      # (BUCKETS + 1, DIMENSION), zero for what training never saw
    filters: list[np.ndarray]                   # for each width (width, DIMENSION, FILTERS)
    biases: np.ndarray                          # (widths * FILTERS,)
    output: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def projection(self) -> np.ndarray:
        """All filters side by side: an embedding times this gives a word's share in every window position."""
        return np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled + self.biases, 0)
        return 1 / (1 + np.exp(-np.clip(self.scale * (hidden @ self.output + self.bias) + self.shift, -60, 60)))


def _convolve(shares: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Filter responses of every window, by width; ``shares`` has the projected words."""
    out, at = [], 0
    for width in WIDTHS:
        total = shares[words, at:at + FILTERS]
        for j in range(1, width):
            at += FILTERS
            total[:len(words) - j] += shares[words[j:], at:at + FILTERS]
        at += FILTERS
        out.append(total)
    return out


def _laid_out(docs: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after the other with padding around each, and where each one's windows start."""
    gap = np.full(PAD, pad, dtype=np.int64)
    flat = np.concatenate([x for d in docs for x in (gap, d)] + [gap])
    sizes = np.array([len(d) + PAD for d in docs])
    return flat, np.concatenate([[0], np.cumsum(sizes)[:-1]])


class Scorer:
    """Scores texts; keeps the projections of the words seen last, a bounded number."""

    def __init__(self, model: ToxicityModel):
        self.model, self.project = model, model.projection().astype(np.float32)
        self._empty()

    def _empty(self) -> None:
        self.rows = {"": 0}                     # no word is empty: row 0 is the padding
        self.shares = np.zeros((1024, self.project.shape[1]), dtype=np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        ids = list(map(self.rows.get, words))
        if None in ids:
            new = list(dict.fromkeys(w for w, i in zip(words, ids) if i is None))
            made = self.model.embeddings[np.array([buckets(w) for w in new])].sum(axis=1) @ self.project
            start = len(self.rows)
            while start + len(new) > len(self.shares):
                self.shares = np.concatenate([self.shares, np.zeros_like(self.shares)])
            self.shares[start:start + len(new)] = made
            self.rows.update(zip(new, range(start, start + len(new))))
            ids = list(map(self.rows.get, words))
        return np.array(ids, dtype=np.int64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
        pieces: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> None:
            if pieces:
                flat, starts = _laid_out(pieces, 0)
                most = np.concatenate([np.maximum.reduceat(x, starts, axis=0) for x in _convolve(self.shares, flat)], axis=1)
                np.maximum.at(pooled, owners, most)
                pieces.clear()
                owners.clear()

        held = 0
        for k, text in enumerate(texts):
            words = (text or "").lower().split()
            if len(self.rows) + min(len(words), FLUSH) > CACHE:
                flush()
                self._empty()
                held = 0
            for start in range(0, max(1, len(words)), FLUSH):       # pieces of a long text share a window's width
                pieces.append(self._ids(words[max(0, start - PAD):start + FLUSH]))
                owners.append(k)
                held += len(pieces[-1]) + PAD
                if held >= FLUSH:
                    flush()
                    held = 0
                    if len(self.rows) > CACHE:
                        self._empty()
        flush()
        return self.model.score(pooled)


def fit(texts: list[str], labels: list[int], langs: list[str | None], prior: float, seed: int = 1) -> ToxicityModel:
    """Train on a sample that fits in memory; ``prior`` is the share of label 1 among all labelled rows.

    Four of five texts train the weights, in batches with as many of either label; the rest calibrates
    the score to the prior and chooses, for each language, the threshold with the
    best F1 at that prior (the overall one where a language has fewer than five texts of a label).  With only
    one label, or none, every score is that label's prior.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.lower().split()], dtype=np.int64) for t in texts]
    rows = np.array([buckets(w) for w in vocabulary] + [[BUCKETS] * (1 + len(PREFIXES))], dtype=np.int64)
    truth = np.array(labels, dtype=np.int64)
    embed = rng.normal(0, 0.1, (BUCKETS + 1, DIMENSION)).astype(np.float32)
    embed[BUCKETS] = 0
    total = len(WIDTHS) * FILTERS
    model = ToxicityModel(embed, [rng.normal(0, (w * DIMENSION) ** -0.5, (w, DIMENSION, FILTERS)).astype(np.float32) for w in WIDTHS],
                          np.zeros(total, np.float32), rng.normal(0, total ** -0.5, total).astype(np.float32))
    order = rng.permutation(len(docs))
    train, held = order[len(order) // 5:], order[:len(order) // 5]
    sides = [train[truth[train] == y] for y in (0, 1)]
    if not all(map(len, sides)):
        prior = min(max(prior, 0.01), 0.99)
        return ToxicityModel(np.zeros_like(embed), model.filters, model.biases, model.output * 0, scale=0.0, shift=float(np.log(prior / (1 - prior))))
    _descend(model, docs, rows, sides, rng)
    seen = np.zeros(BUCKETS + 1, dtype=bool)
    seen[rows[np.unique(np.concatenate([docs[i] for i in train]))]] = True
    model.embeddings[~seen] = 0
    held = held if len(set(truth[held])) == 2 else order
    _calibrate(model, [texts[i] for i in held], truth[held], [langs[i] for i in held], prior)
    return model


def _descend(model, docs, rows, sides, rng) -> None:
    """Adagrad on the logistic loss; through the maximum, only the winning windows are changed."""
    embed = model.embeddings
    square = {"embed": np.full(embed.shape, 1e-8, np.float32), "biases": np.full(model.biases.shape, 1e-8), "output": np.full(model.output.shape, 1e-8), "bias": 1e-8}
    squares = [np.full(f.shape, 1e-8, np.float32) for f in model.filters]
    pad = len(rows) - 1
    for _ in range(STEPS):
        picked = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        y = np.repeat([0.0, 1.0], BATCH // 2)
        flat, starts = _laid_out([docs[i] for i in picked], pad)
        own, flat_own = np.unique(flat, return_inverse=True)
        vectors = embed[rows[own]].sum(axis=1)
        responses = _convolve(vectors @ model.projection(), flat_own)
        ends = np.concatenate([starts[1:], [len(flat)]])
        best = [np.stack([x[s:e].argmax(axis=0) + s for s, e in zip(starts, ends)]) for x in responses]
        pooled = np.concatenate([np.take_along_axis(x, b, axis=0) for x, b in zip(responses, best)], axis=1)
        hidden = np.maximum(pooled + model.biases, 0)
        logit = hidden @ model.output + model.bias
        slope = (1 / (1 + np.exp(-logit)) - y) / BATCH
        back = slope[:, None] * model.output * (hidden > 0)
        grad = np.zeros_like(embed)
        for k, width in enumerate(WIDTHS):
            part = back[:, k * FILTERS:(k + 1) * FILTERS]
            change = np.zeros_like(model.filters[k])
            for j in range(width):
                words = flat_own[np.minimum(best[k] + j, len(flat) - 1)]
                change[j] = np.einsum("nfd,nf->df", vectors[words], part)
                share = (part[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIMENSION)
                for column in rows[own[words]].reshape(-1, rows.shape[1]).T:
                    np.add.at(grad, column, share)
            squares[k] += change ** 2
            model.filters[k] -= RATE * change / np.sqrt(squares[k])
        grad[BUCKETS] = 0
        touched = np.nonzero(np.abs(grad).sum(axis=1))[0]
        square["embed"][touched] += grad[touched] ** 2
        embed[touched] -= RATE * grad[touched] / np.sqrt(square["embed"][touched])
        for name, change in (("biases", back.sum(axis=0)), ("output", hidden.T @ slope), ("bias", slope.sum())):
            square[name] = square[name] + change ** 2
            setattr(model, name, getattr(model, name) - RATE * change / np.sqrt(square[name]))


def _calibrate(model, texts, truth, langs, prior) -> None:
    """Fit scale and shift of the logit by weighted, smoothed logistic regression, then the thresholds.

    No threshold lies at or below the score of a text without words: what says nothing is kept, however few labels there are.
    """
    raw = Scorer(model).scores(texts)
    logit = np.log(np.clip(raw, 1e-12, None) / np.clip(1 - raw, 1e-12, None))
    ones, zeros = max(1, truth.sum()), max(1, (1 - truth).sum())
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    weight = np.where(truth == 1, prior / ones, (1 - prior) / zeros)
    target = np.where(truth == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    design, found = np.stack([logit, np.ones_like(logit)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ found, -30, 30)))
        slope = design.T @ (weight * (p - target))
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        found -= step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    if found[0] > 0:
        model.scale, model.shift = float(found[0]), float(found[1])
    score = model_scores(model, texts)
    least = float(model_scores(model, [""])[0]) + 1e-9
    model.threshold = max(least, _threshold(score, truth, weight))
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        if min(truth[own].sum(), (1 - truth[own]).sum()) >= 5:
            model.thresholds[lang] = max(least, _threshold(score[own], truth[own], weight[own]))


def _threshold(score: np.ndarray, truth: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The middle of the gap below the cut with the best F1, rows counting by ``weight``."""
    weight = np.ones(len(score)) if weight is None else weight
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum((weight * truth)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (weight * truth).sum())
    last = np.concatenate([np.diff(score[order]) != 0, [True]])       # a cut does not part equal scores
    k = int(np.argmax(np.where(last, f1, -1)))
    below = score[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((score[order[k]] + below) / 2)


def model_scores(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    return Scorer(model).scores(texts)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          target: str = "toxic", rows: Column | None = None, sample: int = SAMPLE_DOCS) -> ToxicityModel:
    """A model from a bounded sample of the labelled documents, drawn by hash, half of each label.

    ``rows`` says which rows of ``labels`` may be used.  Rows without id or label are left out; of
    contradicting labels the larger counts.  Only the sample's ids, then its texts, reach the driver.
    """
    usable = labels.filter(rows) if rows is not None else labels
    known = durable(usable.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{target}`").cast("int").alias("toxic"))
                    .filter("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "labelled")
    counts = dict(known.groupBy("toxic").count().collect())
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    half = sample // 2
    drawn = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(half) for y in (0, 1)]
    picked = durable(drawn[0].union(drawn[1]), "sample")
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    found = own.filter(F.octet_length("text") <= SAMPLE_TEXT).join(picked, "id")
    sizes = durable(found.withColumn("size", F.octet_length("text")), "sample-texts")
    # at most two documents for each id on average: repeated rows can't make the sample grow
    chosen = sizes.dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").select("id", "size").collect()
    ends = np.cumsum([r["size"] for r in chosen]) if chosen else np.zeros(0)
    ids = [r["id"] for r, end in zip(chosen, ends) if end <= SAMPLE_BYTES]
    got = sizes.dropDuplicates(["id"]).filter(F.col("id").isin(ids)).select("id", "text", "lang", "toxic").collect() if ids else []
    got.sort(key=lambda r: (crc32(str(r["id"]).encode()), r["id"]))
    return fit([r["text"] for r in got], [r["toxic"] for r in got], [r["lang"] for r in got], prior)


def score_column(spark, model: ToxicityModel, text: str = "text") -> Column:
    """The score of a whole text, 0 to 1; null scores like an empty text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.Series(np.concatenate([scorer.scores(list(batch[i:i + 256])) for i in range(0, len(batch), 256)] or [np.zeros(0)]).astype(float))

    return scored(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def threshold_column(model: ToxicityModel, lang: str = "lang") -> Column:
    """The threshold of the row's language; the overall one for null and unknown languages."""
    pairs = [F.lit(x) for item in sorted(model.thresholds.items()) for x in item]
    by_lang = F.create_map(*pairs)[F.col(f"`{lang}`").cast("string")] if pairs else F.lit(None).cast("double")
    return F.coalesce(by_lang, F.lit(model.threshold))


def clean(docs: DataFrame, model: ToxicityModel, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose score stays below the threshold of their language, all columns as they are.

    Null and empty texts score like a text without known words.  Repeated rows are
    judged alike; an empty table stays empty; a table without the column ``lang`` uses the overall threshold.
    """
    score, = fresh(docs, "score")
    limit = threshold_column(model, lang) if lang in docs.columns else F.lit(model.threshold)
    return docs.withColumn(score, score_column(docs.sparkSession, model, text)).filter(F.col(score) < limit).drop(score)
