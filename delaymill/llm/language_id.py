"""Operator 3: language identification with a blended-spectrum string kernel."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymill.llm.support import held_out, texts, unit_hash
from delaymill.session import spool

ORDERS = (1, 2, 3)  # up to three code points of 21 bits: grams are compared exactly, and lengths never mix
LANDMARKS = 96  # texts that span the Nystroem space, over all languages
PER_LANGUAGE = 400  # expected training texts of each language
RIDGE = 1e-2
UNDETERMINED = "und"

_POINTS = [chr(i) for i in range(0x10000)]
LETTER = np.array([c.isalpha() for c in _POINTS])
LOWER = np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in _POINTS], np.int64)


def grams(text: str) -> np.ndarray:
    """Sorted distinct n-grams of the lower-cased letters of a text; runs of anything else are one space.

    Code points beyond the basic plane count as letters if Python says so.
    """
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    basic = points < 0x10000
    low = np.where(basic, points, 0)
    letter, lower = LETTER[low], LOWER[low]
    for i in np.flatnonzero(~basic):
        c = chr(points[i])
        letter[i], lower[i] = c.isalpha(), ord(c.lower()[0]) if c.isalpha() else 32
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    line = np.concatenate(([32], lower[keep], [32])) if letter[-1] else np.concatenate(([32], lower[keep]))
    codes, found = line, [np.unique(line[line != 32])]
    for n in ORDERS[1:]:
        codes = (codes[:-1] << 21) | line[n - 1 :]
        found.append(np.unique(codes))
    return np.unique(np.concatenate(found))


@dataclass
class Landmarks:
    """Presence of grams in the landmark texts, and their self kernels."""

    vocabulary: np.ndarray
    presence: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, found: list[np.ndarray]) -> Landmarks:
        vocabulary = np.unique(np.concatenate(found))
        presence = np.zeros((len(vocabulary), len(found)), np.float32)
        for j, g in enumerate(found):
            presence[np.searchsorted(vocabulary, g), j] = 1
        return cls(vocabulary, presence, np.sqrt([len(g) for g in found]))

    def kernel(self, found: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel of texts against the landmarks: shared grams over the root of both sizes."""
        rows = np.zeros((len(found), len(self.vocabulary)), np.float32)
        for i, g in enumerate(found):
            at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
            rows[i, at[self.vocabulary[at] == g]] = 1
        sizes = np.sqrt([max(1, len(g)) for g in found])
        return (rows @ self.presence) / sizes[:, None] / self.norms[None, :]


@dataclass
class LanguageModel:
    landmarks: Landmarks
    weights: np.ndarray
    languages: list[str]

    def predict(self, found: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        margins = self.landmarks.kernel(found) @ self.weights
        best = margins.argmax(axis=1)
        scores = np.clip((margins[np.arange(len(found)), best] + 1) / 2, 0, 1)
        return [self.languages[i] for i in best], scores


def _sample(rows: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` ids of each language, chosen by their hash, with one text each (the least of those that share the id)."""
    sizes = rows.groupBy("lang").count()
    shares = sizes.select(F.col("lang").alias("_lang"), (F.lit(float(per_language)) / F.col("count")).alias("_share"))
    ids = rows.select("doc_id", "lang").join(shares, F.col("lang") == F.col("_lang"))
    ids = ids.filter(unit_hash(F.col("doc_id")) < F.col("_share")).select(F.col("doc_id").alias("_id")).distinct()
    # stored, so that the planner knows how few they are and leaves the texts where they lie
    chosen = rows.join(spool(ids, "sampled"), F.col("doc_id") == F.col("_id"), "left_semi")
    return chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def train(rows: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> LanguageModel | None:
    """A model from the columns doc_id, lang and text of ``rows``; None if no row has a language and a letter.

    Learns from an expected ``per_language`` rows of each language (a bounded sample, chosen by a hash of the
    id); grams are computed in tasks. The driver gets the grams of the landmarks, and the landmark kernel of each sampled row.
    """

    def spectra(batches):
        for batch in batches:
            found = [grams(t) for t in texts(batch.column(2))]
            keep = [i for i, g in enumerate(found) if len(g)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    pa.array([batch.column(1)[i].as_py() for i in keep], pa.string()),
                    pa.array([found[i] for i in keep], pa.list_(pa.int64())),
                ],
                ["doc_id", "lang", "grams"],
            )

    known = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sampled = _sample(known, per_language).mapInArrow(
        spectra, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, grams array<long>"
    )
    stored = spool(sampled, "spectra")
    languages = sorted(r.lang for r in stored.select("lang").distinct().collect())
    if not languages:
        return None
    each = max(2, landmarks // len(languages))
    chosen = _landmark_rows(stored, languages, each)
    marks = Landmarks.of([np.array(r.grams, np.int64) for r in chosen])

    def mapped(batches):
        for batch in batches:
            found = [np.array(g, np.int64) for g in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(marks.kernel(found).astype(float)), pa.list_(pa.float64()))],
                ["lang", "kernel"],
            )

    rows_k = stored.select("lang", "grams").mapInArrow(mapped, "lang string, kernel array<double>").collect()
    kernel = np.array([r.kernel for r in rows_k])
    target = np.where(np.array([[r.lang == x for x in languages] for r in rows_k]), 1.0, -1.0)
    return LanguageModel(marks, _ridge(marks, kernel, target), languages)


def _landmark_rows(stored: DataFrame, languages: list[str], each: int) -> list:
    """``each`` rows per language, from the training sample alone."""
    order = unit_hash(F.col("doc_id"), F.lit("landmark"))
    parts = [stored.filter(F.col("lang") == x).orderBy(order, "doc_id").limit(each) for x in languages]
    return [r for part in parts for r in part.collect()]


def _ridge(marks: Landmarks, kernel: np.ndarray, target: np.ndarray) -> np.ndarray:
    """One-versus-rest ridge regression in the Nystroem space, folded back to weights of the landmark kernel."""
    among = (marks.presence.T @ marks.presence) / marks.norms[:, None] / marks.norms[None, :]
    values, vectors = np.linalg.eigh(among.astype(float))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ root
    share = (target > 0).mean(axis=0)  # the mean of +1 and -1 targets weighs languages alike
    weight = (target > 0) @ (1 / np.maximum(share, 1e-9))
    left = phi.T @ (phi * weight[:, None]) + RIDGE * weight.sum() / len(weight) * np.eye(phi.shape[1])
    return root @ np.linalg.solve(left, phi.T @ (target * weight[:, None]))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (columns doc_id, text), from whole texts.

    ``und`` with score 0 for null texts, texts without letters, or without a model. Repeated rows and null ids
    give one row each. Batches of texts are scored by one matrix product.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [grams(t) for t in texts(part.column(1))]
                if model is None:
                    names, scores = [UNDETERMINED] * len(found), np.zeros(len(found))
                else:
                    names, scores = model.predict(found)
                some = np.array([len(g) > 0 for g in found], bool)
                names = [n if s else UNDETERMINED for n, s in zip(names, some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(np.where(some, scores, 0.0), pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> DataFrame:
    """Learn from rows that are not held out, predict all rows; adds ``held_out``."""
    model = train(docs.filter(~held_out()), per_language, landmarks)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
