"""Operator 7: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 made from its code point.  An n-gram's vector
binds (multiplies) the letter vectors, each permuted (rotated) by its place; a text's vector
bundles (adds) those of all its n-grams; a language's prototype bundles those of its
training texts.  The prediction is the language whose prototype has the greatest cosine with
the text's vector, both taken relative to the mean of all prototypes.

Bundling is linear, so training only counts n-grams by language with partial aggregation, and
bundles the counts afterwards.  The model is one vector per language.

Edge cases: NULL text or text without a letter gives ``und`` and score 0; so does everything if
no labelled row is left to learn from; rows without lang are predicted, not learned from; a NULL doc_id counts as
an empty string in the split; repeated rows are predicted separately; an empty table gives an
empty result; ties go to the language that comes first by code point.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import id_text, ids_back, table
from pathwise.llm.registry import register

DIMS = 1024
SEED = 7
N = 3
PIECE = 1 << 20
CHUNK = 128
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """By code point: the lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, dtype=np.uint64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's letter trigrams; runs of other characters count as one gap."""
    table_ = _lower_letters()
    grams, counts, tail = [], [], np.zeros(1, dtype=np.uint64)
    text = f"{text or ''} "
    for at in range(0, len(text), PIECE):
        points = table_[np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "replace"), dtype="<u4")]
        seq = np.concatenate([tail, points])
        fresh = np.ones(len(seq), dtype=bool)
        fresh[1:] = (seq[1:] != 0) | (seq[:-1] != 0)
        fresh[:len(tail)] = True
        seq = seq[fresh]
        if len(seq) >= N:
            codes = (seq[:-2] << np.uint64(42)) | (seq[1:-1] << np.uint64(21)) | seq[2:]
            codes = np.sort(codes)
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            grams.append(codes[first])
            counts.append(np.diff(np.append(first, len(codes))))
        tail = seq[-2:]
    if not grams:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return _summed(np.concatenate(grams), np.concatenate(counts)) if len(grams) > 1 else (grams[0], counts[0])


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    uniq, at = np.unique(codes, return_inverse=True)
    return uniq, np.bincount(at, weights=counts, minlength=len(uniq)).astype(np.int64)


@lru_cache(maxsize=100_000)
def _letter(point: int) -> np.ndarray:
    return np.random.default_rng((SEED, point)).integers(0, 2, DIMS, dtype=np.int8) * 2 - 1


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """One bound vector per n-gram code."""
    out = None
    for place in range(N):
        letters, at = np.unique((codes >> np.uint64(21 * (N - 1 - place))) & np.uint64(0x1FFFFF), return_inverse=True)
        vectors = np.stack([np.roll(_letter(int(c)), N - 1 - place) for c in letters])[at]
        out = vectors if out is None else out * vectors
    return out


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (one row each) from ``text, lang``."""

    def count(frames):
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                found = [gram_counts(t) for t in texts]
                codes, counts = _summed(np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found]))
                yield pd.DataFrame({"lang": lang, "gram": codes.astype(np.int64), "n": counts})

    def bundle(frames):
        for frame in frames:
            for at in range(0, len(frame), 8192):
                part = frame.iloc[at:at + 8192]
                vectors = gram_vectors(part["gram"].to_numpy().astype(np.uint64)).astype(np.int64)
                for lang, rows_ in part.reset_index(drop=True).groupby("lang"):
                    total = rows_["n"].to_numpy() @ vectors[rows_.index.to_numpy()]
                    yield pd.DataFrame({"lang": lang, "dim": np.arange(DIMS), "x": total})

    grams = (rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
             .select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sums = grams.mapInPandas(bundle, "lang string, dim int, x long").groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    got = sums.toPandas()  # languages x DIMS numbers: the model
    langs = sorted(got["lang"].unique())
    protos = np.zeros((len(langs), DIMS))
    for i, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        protos[i, own["dim"].to_numpy()] = own["x"].to_numpy()
    size = np.linalg.norm(protos, axis=1, keepdims=True)
    return langs, protos / np.where(size > 0, size, 1)


def predict(rows: DataFrame, langs: list[str], protos: np.ndarray) -> DataFrame:
    """``rows`` must hold ``doc_id, held_out, text``; text is replaced by ``lang_pred, score``."""
    mean = protos.mean(axis=0) if len(langs) > 1 else np.zeros(DIMS)
    apart = protos - mean
    apart = (apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def run(frames):
        for frame in frames:
            pred, score = [], []
            for at in range(0, len(frame), CHUNK):
                p, s = guess(frame["text"].iloc[at:at + CHUNK].tolist())
                pred += p
                score += s
            yield pd.DataFrame({"doc_id": frame["doc_id"].values, "held_out": frame["held_out"].values,
                                "lang_pred": pred, "score": score})

    def guess(texts):
        found = [gram_counts(t) for t in texts]
        lettered = [bool(len(c)) and bool((c != 0).any()) for c, _ in found]
        codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        if not len(codes) or not langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        row = np.repeat(np.arange(len(texts)), [len(c) for c, _ in found])
        vectors = np.zeros((len(texts), DIMS), dtype=np.float32)
        weight = np.concatenate([n for _, n in found]).astype(np.float32)
        for at in range(0, len(codes), 8192):  # bounded memory for texts of many different n-grams
            inside = (place >= at) & (place < at + 8192)
            part = np.zeros((len(texts), min(8192, len(codes) - at)), dtype=np.float32)
            part[row[inside], place[inside] - at] = weight[inside]
            vectors += part @ gram_vectors(codes[at:at + 8192]).astype(np.float32)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        vectors -= mean.astype(np.float32)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        cosines = vectors @ apart.T
        best = cosines.argmax(axis=1)
        return ([langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)],
                [float(min(1.0, max(0.0, (1 + cosines[i, b]) / 2))) if ok else 0.0
                 for i, (b, ok) in enumerate(zip(best, lettered))])

    return ids_back(rows.select(id_text("doc_id"), "held_out", "text").mapInPandas(
        run, "doc_id string, held_out boolean, lang_pred string, score double"), "doc_id")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang",
                       (F.crc32(key.cast("binary")) % 4 == 2).alias("held_out"))
    langs, protos = fit(rows.filter(~F.col("held_out")))
    return predict(rows, langs, protos)


@register("op7_language_id")
def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Operator 7 over all documents."""
    return identify(table(spark, sf_dir, "documents"))
