"""Language identification in two levels.

Linear support vector machines over shares of hashed byte trigrams: first between language families, one against one,
then one against one between the languages of the family that won. All machines are one table of weights by bucket, so
a text is scored by sums of table rows over its bytes.

Training: rows whose crc32(doc_id) modulo 4 is not 2, with a language and a letter in their text; of each language
those with the smallest hashes of doc_id and text, about ``rows_per_language`` of them, and about ``MOST_ROWS`` of all
languages together (the only bounds; scoring covers all texts whole). A repeated row is drawn once.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.byte_grams import buffer, stretches, sums
from cartulary.llm.shared import crc_mod, table, with_columns

BUCKETS = 8192
ROWS_PER_LANGUAGE = 600
MOST_ROWS = 8000

#: Language families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
}


def family(lang: str) -> str:
    return next((f for f, ls in FAMILIES.items() if lang in ls), f"only {lang}")


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by dual coordinate descent; the last one is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    rng, w, alpha = np.random.default_rng(seed), np.zeros(x.shape[1]), np.zeros(len(x))
    cost = c / np.array([np.mean(y == v) * 2 for v in y])  # classes weigh alike
    diagonal = np.einsum("ij,ij->i", x, x).astype(np.float64) + 1 / (2 * cost)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * cost[i])
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Hierarchy:
    """families: name -> languages. A machine is positive for the first of its pair; ``weights`` has a column each,
    its last row the biases."""

    families: dict[str, list[str]]
    family_pairs: list[tuple[str, str]]
    language_pairs: list[tuple[str, str]]
    weights: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The languages, and how sure: the product of the logistic margins of the winner over its closest rivals."""
        names, n_f = sorted(self.families), len(self.family_pairs)
        langs, sure = [], np.ones(len(margins))
        best, p = _vote(margins[:, :n_f], self.family_pairs, names)
        sure *= p
        chosen = np.empty(len(margins), object)
        for name in names:
            rows = np.flatnonzero(best == names.index(name))
            own = self.families[name]
            cols = [n_f + i for i, pair in enumerate(self.language_pairs) if pair[0] in own]
            inner, p = _vote(margins[rows][:, cols], [self.language_pairs[i - n_f] for i in cols], own)
            sure[rows] *= p
            chosen[rows] = [own[i] for i in inner]
        langs = chosen.tolist()
        return langs, sure


def _vote(margins: np.ndarray, pairs: list[tuple[str, str]], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One against one: most duels won, then the largest sum of margins; and the logistic of its closest duel."""
    won, total = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
    closest = np.full((len(margins), len(names)), np.inf)
    for k, (a, b) in enumerate(pairs):
        for name, m in ((a, margins[:, k]), (b, -margins[:, k])):
            i = names.index(name)
            won[:, i] += m > 0
            total[:, i] += np.tanh(m)
            closest[:, i] = np.minimum(closest[:, i], m)
    best = np.argmax(won + 1e-3 * total, axis=1) if len(margins) else np.empty(0, int)
    m = closest[np.arange(len(best)), best]
    return best, np.where(np.isinf(m), 1.0, 1 / (1 + np.exp(-np.clip(4 * m, -30, 30))))


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, n_buckets: int = BUCKETS) -> Hierarchy | None:
    """Fits on ``docs`` (doc_id, text, lang); None where no row has both a language and a letter, or none is drawn.

    The driver gets the trigrams of each sampled row and its share of each, so a bounded number of rows of a bounded
    size. The rows are put in order, so the same table gives the same machines.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    wanted = min(rows_per_language, max(MOST_ROWS // len(counts), 1))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, wanted / n))])
    place = F.xxhash64("doc_id", "text", F.lit("language"))
    drawn = (place / F.lit(2.0**64) + 0.5) <= share[F.col("lang")]

    def shares(batches):
        for batch in batches:
            raw, starts = buffer(batch.column("text"))
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for codes, own, first in stretches(raw, starts, n_buckets):
                for i in range(len(own) - 1):
                    found[first + i].append(np.bincount(codes[own[i] : own[i + 1]], minlength=n_buckets))
            out = {"at": [], "share": []}
            for i, parts in enumerate(found):
                total = sum(parts, np.zeros(n_buckets, np.int64))
                used = np.flatnonzero(total)
                out["at"].append(used.astype("<u2").tobytes())
                out["share"].append((total[used] / max(int(starts[i + 1] - starts[i]), 1)).astype("<f4").tobytes())
            yield with_columns(batch, ["lang", "place"], out, {"at": pa.binary(), "share": pa.binary()})

    texts = rows.where(drawn).select("lang", place.alias("place"), "text").dropDuplicates(["lang", "place"])
    sample = texts.mapInArrow(shares, "lang string, place long, at binary, share binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["lang"], r["place"]))
    x = np.zeros((len(sample), n_buckets), np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["share"], "<f4")
    norm = max(float(np.linalg.norm(x, axis=1).mean()), 1e-9)
    x /= np.float32(norm)
    langs = np.array([r["lang"] for r in sample])
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family(lang), []).append(lang)
    of = np.array([family(v) for v in langs])
    pairs, family_pairs = [], list(combinations(sorted(families), 2))
    language_pairs = [p for f in sorted(families) for p in combinations(families[f], 2)]
    for labels, wanted in ((of, family_pairs), (langs, language_pairs)):
        for a, b in wanted:
            use = (labels == a) | (labels == b)
            pairs.append(svm(x[use], np.where(labels[use] == a, 1.0, -1.0)))
    weights = np.stack(pairs, 1) if pairs else np.zeros((n_buckets + 1, 0))
    weights[:-1] /= norm
    return Hierarchy(families, family_pairs, language_pairs, weights)


def predict(docs: DataFrame, found: Hierarchy | None, n_buckets: int = BUCKETS) -> DataFrame:
    """Adds lang_pred and score to doc_id and held_out.

    A null text, one without a letter, or any text where nothing could be learned, is ``und`` with score 0. Ties between
    languages go to the first by name. Repeated rows and doc_ids, null ones too, are scored row by row; other columns
    are not carried. A text is read in stretches of 4 MB, so its length does not matter. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ready = docs.select("doc_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    if found is None:
        return ready.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(found)  # buckets x machines, whatever the corpus

    def score(batches):
        h = shared.value
        columns = np.ascontiguousarray(h.weights[:-1].T, np.float32)
        for batch in batches:
            raw, starts = buffer(batch.column("text"))
            margins = np.zeros((batch.num_rows, h.weights.shape[1]))
            for codes, own, first in stretches(raw, starts, n_buckets):
                for k, w in enumerate(columns):
                    margins[first : first + len(own) - 1, k] += sums(w[codes], own)
            margins = margins / np.maximum(np.diff(starts), 1)[:, None] + h.weights[-1]
            langs, sure = h.predict(margins)
            letter = batch.column("_letter").to_numpy(zero_copy_only=False)
            langs = [lang if ok else "und" for lang, ok in zip(langs, letter, strict=True)]
            yield with_columns(batch, ["doc_id", "held_out"], {"lang_pred": langs, "score": np.where(letter, sure, 0.0)}, {"lang_pred": pa.string()})

    return ready.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)))
    return predict(docs, train(docs.where(~F.col("held_out"))))
