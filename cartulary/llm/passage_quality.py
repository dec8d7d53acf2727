"""Document quality by attention over passages (multiple-instance learning).

A text is cut evenly into passages of at most ``PASSAGE`` bytes, all of it. Each passage is encoded as its shares of hashed byte
trigrams, projected to a few dimensions by fixed random signs, beside its shares of byte classes and how much it
repeats: distinct trigrams, their concentration, and words that follow themselves. From document labels
alone are learned gated attention weights over a document's passages and a logistic classifier of the passages'
weighted mean.

Training: labelled rows whose crc32(doc_id) modulo 5 is not 0; those with the smallest hashes, at most ``MOST_ROWS``
of them (the only bound; scoring covers all passages of all texts).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.byte_grams import buckets, buffer, slices
from cartulary.llm.shared import crc_mod, table, with_columns

MOST_ROWS = 4000
#: So many passages of a document at most, for the same.
MOST_PASSAGES = 256
PASSAGE = 1024
BUCKETS = 2048
PROJECTED = 48
HIDDEN = 16
THRESHOLD = 0.3
#: Bytes of text encoded at once; arrays take some fifty times as much.
AT_ONCE = 1 << 20

#: Byte classes: small letters, capitals, digits, blanks, line ends, stops, other ASCII marks, beyond ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, 9]], _CLASS[[10, 13]] = 3, 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
N_CLASSES = 8
WIDTH = PROJECTED + N_CLASSES + 5


def passages(starts: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of all passages of texts that lie end to end, and which text each belongs to.

    A text has as few passages of at most ``size`` bytes as can hold it, of even lengths; an empty text has one."""
    lengths = np.diff(starts)
    each = np.maximum(-(-lengths // size), 1)
    text = np.repeat(np.arange(len(lengths)), each)
    within = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    return np.append(starts[text] + within * lengths[text] // each[text], starts[-1]), text


def echoes(raw: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each passage, the share of its words that equal the word before them in the text (as bags of letters)."""
    letter = ~np.isin(_CLASS[raw], (3, 4))
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = starts[:-1][np.diff(starts) > 0]
    first[inner] = letter[inner]
    at = np.flatnonzero(first)
    n = len(bounds) - 1
    if not len(at):
        return np.zeros(n)
    fold = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.int64) * letter
    word = np.add.reduceat(fold * fold * 31 + fold * 7, at) * 1024 + np.add.reduceat(letter.astype(np.int64), at)
    same = np.zeros(len(at), bool)
    same[1:] = word[1:] == word[:-1]
    same[np.searchsorted(at, inner[np.searchsorted(at, inner) < len(at)])] = False
    passage = np.searchsorted(bounds, at, side="right") - 1
    return np.bincount(passage[same], minlength=n)[:n] / np.maximum(np.bincount(passage, minlength=n)[:n], 1)


def encode(raw: np.ndarray, starts: np.ndarray, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A row of WIDTH numbers for each passage, and its text."""
    signs = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (BUCKETS, PROJECTED)) / np.sqrt(np.float32(PROJECTED))
    bounds, text = passages(starts)
    codes, classes = buckets(raw, starts, BUCKETS, fold=False), _CLASS[raw]
    out = np.zeros((len(text), WIDTH), np.float32)
    for i in range(0, len(text), chunk):
        j = min(i + chunk, len(text))
        a, b = bounds[i], bounds[j]
        lengths = np.diff(bounds[i : j + 1])
        row = np.repeat(np.arange(j - i), lengths)
        count = lambda c, n: np.bincount(row * n + c[a:b], minlength=(j - i) * n).reshape(-1, n).astype(np.float32)  # noqa: B023, E731
        n = np.maximum(lengths, 1).astype(np.float32)[:, None]
        grams = count(codes, BUCKETS)
        few = np.log1p(n[:, 0]) + 1e-6
        out[i:j, :PROJECTED] = grams / n @ signs
        out[i:j, PROJECTED : PROJECTED + N_CLASSES] = count(classes, N_CLASSES) / n
        out[i:j, -5] = np.minimum(n[:, 0] / PASSAGE, 1)
        out[i:j, -4] = np.log1p((grams > 0).sum(1)) / few
        out[i:j, -3] = np.log1p((grams * grams).sum(1)) / few
        out[i:j, -2] = np.log1p(grams.max(1)) / few
    # A passage's stretch is found by its start; empty texts share theirs with the next and have no words.
    out[:, -1] = echoes(raw, starts, bounds)
    return out, text


@dataclass
class Attention:
    """The learned numbers: how passages are scaled, the two gates, the attention weights and the classifier."""

    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float

    def forward(self, e: np.ndarray, first: np.ndarray, text: np.ndarray) -> dict[str, np.ndarray]:
        """first: the first passage of each text."""
        t, g = np.tanh(e @ self.v), 1 / (1 + np.exp(-(e @ self.u)))
        s = (t * g) @ self.w
        a = np.exp(s - np.maximum.reduceat(s, first)[text])
        a = a / np.add.reduceat(a, first)[text]
        z = np.add.reduceat(a[:, None] * e, first)
        return {"t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ self.c + self.b, -30, 30)))}

    def score(self, encoded: np.ndarray, text: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.diff(text, prepend=-1))
        return self.forward((encoded - self.mean) / self.scale, first, text)["p"]


def fit(encoded: np.ndarray, text: np.ndarray, labels: np.ndarray, epochs: int = 400, rate: float = 0.02, decay: float = 1e-3) -> Attention:
    """Full-batch Adam on the mean cross-entropy; ``labels`` by text."""
    rng = np.random.default_rng(2)
    mean, scale = encoded.mean(0), encoded.std(0) + 1e-4
    e = ((encoded - mean) / scale).astype(np.float64)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    new = lambda *shape: rng.normal(0, 0.1, shape)
    m = Attention(mean, scale, new(WIDTH, HIDDEN), new(WIDTH, HIDDEN), new(HIDDEN), np.zeros(WIDTH), 0.0)
    names = ("v", "u", "w", "c", "b")
    one, two = ({k: 0.0 for k in names} for _ in range(2))
    for step in range(1, epochs + 1):
        f = m.forward(e, first, text)
        t, g, a = f["t"], f["g"], f["a"]
        d = (f["p"] - labels) / len(labels)
        da = d[text] * (e @ m.c)
        ds = a * (da - np.add.reduceat(a * da, first)[text])
        dh = ds[:, None] * m.w
        grad = {
            "v": e.T @ (dh * g * (1 - t * t)) + decay * m.v,
            "u": e.T @ (dh * t * g * (1 - g)) + decay * m.u,
            "w": (t * g).T @ ds + decay * m.w,
            "c": f["z"].T @ d + decay * m.c,
            "b": d.sum(),
        }
        for k in names:
            one[k] = 0.9 * one[k] + 0.1 * grad[k]
            two[k] = 0.999 * two[k] + 0.001 * grad[k] ** 2
            move = rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
            setattr(m, k, getattr(m, k) - move)
    return m


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Attention | float:
    """Fits on documents (doc_id, text) and labels (doc_id, quality), both without the rows held out.

    A document with several labels takes their mean. Without both labels there is nothing to learn: the result is the
    only label's value, or 0.5 without any. The driver gets the encodings of at most ``MOST_PASSAGES`` passages of at most
    ``most_rows`` documents: ``WIDTH`` numbers each.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("_label"))
    chosen = marked.withColumn("_place", F.xxhash64("doc_id", F.lit("quality"))).orderBy("_place", "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("_place", "_label", "text")  # most_rows at most

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text", AT_ONCE)):
            raw, starts = buffer(batch.column("text"))
            e, text = encode(raw, starts)
            ends = np.searchsorted(text, np.arange(len(starts)))
            out = [spread(e[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield with_columns(batch, ["_place", "_label"], {"passages": out}, {"passages": pa.binary()})

    found = rows.mapInArrow(run, "_place long, _label double, passages binary").orderBy("_place", F.xxhash64("passages")).limit(most_rows).collect()
    y = np.array([r["_label"] for r in found])
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.5
    bags = [np.frombuffer(r["passages"], np.float32).reshape(-1, WIDTH) for r in found]
    return fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), y)


def score(docs: DataFrame, model: Attention | float, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted; a null text is scored as an empty one. Columns so named are replaced, others stay.

    Each row is scored by its text alone, all of it whatever its length: equal texts have equal scores, repeated rows
    stay as they are, and a score that equals the threshold is predicted as 1. An empty table gives no rows.
    """
    kept = docs.drop("score", "predicted")
    names = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text", AT_ONCE)):
            m = shared.value
            raw, starts = buffer(batch.column("text"))
            p = np.full(len(starts) - 1, m) if isinstance(m, float) else m.score(*encode(raw, starts))
            p = p.astype(np.float64)
            yield with_columns(batch, names, {"score": p, "predicted": (p >= threshold).astype(np.int32)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "score double, predicted int"])
    return kept.mapInArrow(run, schema)


def spread(encoded: np.ndarray, most: int | None = None) -> np.ndarray:
    """A document's passages, or where there are more than ``most`` so many of them at even distances, the first and the
    last among them: what a model is fitted on. What it scores is always the whole text."""
    most = most or MOST_PASSAGES
    return encoded if len(encoded) <= most else encoded[np.linspace(0, len(encoded) - 1, most).astype(np.int64)]


def trained(docs: DataFrame, labels: DataFrame) -> Attention | float:
    """Fits on the rows that are not held out."""
    return train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))


def op9_passage_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = score(docs.withColumn("held_out", held_out), trained(docs, labels))
    return scored.select("doc_id", "held_out", "score", "predicted")
