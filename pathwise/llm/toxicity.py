"""Operator 9: toxicity by a classifier chain.

The categories are predicted one after the other by logistic models.  A later model sees, besides
the text's own features, the probabilities of all earlier categories.  For training those
probabilities are out-of-fold predictions, so a later model learns from the errors that the earlier ones make on
unseen rows; for scoring they come from the models fitted on all rows.

Features are the presence of words and word stems that tell a category apart (chosen by a chi-square test against its
labels) and a few ratios of the text.  The classifier is fitted on a bounded sample of labelled documents: at most ``SAMPLE``,
shared out evenly over the classes (the combinations of labels; a class takes all its rows where it has fewer than its
share), those of least hash in each.  A row stands for all rows of its class by a weight, so probabilities and thresholds
hold for the labels as they are, however rare a category is.  Everything else covers all documents.  Words are counted and chosen
on the executors; the driver receives the chosen words' hashes (at most ``WORDS`` for each category and fold) and one bit
per sampled row and chosen word.

Edge cases: NULL text is an empty text; labels that are NULL leave that category's training; several labels of a
document count by their greatest; labels without a document do no harm, and of several documents of one id the text of least hash
is learnt from; a category without both kinds of labels is predicted at its base rate (0 if unlabelled);
an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.llm.common import table, written
from pathwise.llm.registry import register

SAMPLE = 16_000
WORDS = 192
FOLDS = 3
MIN_CHI2 = 30.0
#: Words also count by their first bytes, so that endings unseen in training are known by their stem.
STEM = 4
MIN_ROWS = 2
RIDGE = 0.1
#: Categories in chain order: name -> (label column, the label's value that counts as positive).
CHAIN = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}

LOWER_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
SYMBOLS = b"#*$%&|<>"


def words(text: str | None) -> list[bytes]:
    """Words of letters, lower-cased by ASCII; everything else separates."""
    return (text or "").encode().translate(LOWER_WORDS).split()


def ratios(text: str | None, found: list[bytes]) -> list[float]:
    """Length, symbol, repetition and word-length ratios of a text."""
    raw = (text or "").encode()
    n = max(1, len(found))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return [np.log1p(len(found)), symbols / max(1, len(raw)), 1 - len(set(found)) / n, sum(map(len, found)) / n / 10,
            raw.count(b"!") / n]


def text_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and stems of all texts one after the other, the row of each, and a row of ratios per text."""
    found = [words(t) for t in texts]
    stats = np.asarray([ratios(t, w) for t, w in zip(texts, found)], dtype=float).reshape(len(texts), 5)
    flat = np.empty(sum(map(len, found)), dtype=object)
    flat[:] = [w for ws in found for w in ws]
    rows = np.repeat(np.arange(len(texts)), [len(w) for w in found])
    if not len(flat):
        return np.zeros(0, dtype=np.uint64), rows, stats
    stems = np.empty(len(flat), dtype=object)
    stems[:] = [b"^" + w[:STEM] for w in flat]
    hashes = np.concatenate([hash_array(flat, categorize=False), hash_array(stems, categorize=False)])
    order = np.argsort(rows := np.concatenate([rows, rows]), kind="stable")
    return hashes[order], rows[order], stats


@dataclass
class Model:
    """One link of the chain."""

    vocabulary: np.ndarray  # sorted word hashes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # ratios, earlier categories, words, intercept
    threshold: float = 0.5

    def design(self, hashes, rows, stats, earlier) -> np.ndarray:
        dense = (np.column_stack([stats, logit(earlier)]) - self.mean) / self.scale
        return np.column_stack([dense, presence(hashes, rows, len(stats), self.vocabulary), np.ones(len(stats))])

    def predict(self, hashes, rows, stats, earlier) -> np.ndarray:
        return sigmoid(self.design(hashes, rows, stats, earlier) @ self.weights)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def presence(hashes, rows, n: int, vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros((n, len(vocabulary)))
    if len(vocabulary) and len(hashes):
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        hit = vocabulary[at] == hashes
        out[rows[hit], at[hit]] = 1.0
    return out


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of a fixed grid with the best weighted F1, the middle one of equals."""
    grid = sigmoid(np.arange(-16, 9) / 2)  # even steps of the logit: rare categories need low cuts
    f1 = np.asarray([2 * (weight * y)[p >= t].sum() / max(1e-9, weight[p >= t].sum() + (weight * y).sum()) for t in grid])
    ties = grid[f1 >= f1.max() - 1e-12]
    return float(ties[len(ties) // 2]) if y.sum() else 0.5


def fit_link(present, stats, earlier, y, weight, vocabulary) -> Model:
    """Ridge-penalised logistic regression by Newton steps; ``present`` has a column per word of ``vocabulary``."""
    dense = np.column_stack([stats, logit(earlier)])
    scale = dense.std(axis=0) if len(dense) else np.zeros(dense.shape[1])
    mean = dense.mean(axis=0) if len(dense) else np.zeros(dense.shape[1])
    model = Model(vocabulary, mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(dense.shape[1] + len(vocabulary) + 1))
    positive, all_ = (weight * y).sum(), weight.sum()
    base = (positive + 0.5) / (all_ + 1) if 0 < y.sum() < len(y) else float(y.mean()) if len(y) else 0.0
    model.weights[-1] = float(logit(np.asarray([base]))[0])
    if not 0 < y.sum() < len(y):
        return model
    x = np.column_stack([(dense - model.mean) / model.scale, present, np.ones(len(y))])
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 0
    for _ in range(16):
        p = sigmoid(x @ model.weights)
        gradient = x.T @ (weight * (y - p)) - penalty * model.weights
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        model.weights = model.weights + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-3:
            break
    return model


def fit_chain(present, stats, labels, fold, weight, vocabulary, chosen) -> list[Model]:
    """One model per column of ``labels`` (NaN: not labelled), in order.

    ``present`` has a 0/1 column for each hash of ``vocabulary`` (sorted); ``chosen[category, fold]`` are the words of
    the model that leaves ``fold`` out (-1: none).  A category's threshold is the best one for its out-of-fold predictions.
    """
    models, earlier = [], np.zeros((len(stats), 0))
    for j in range(labels.shape[1]):
        y = labels[:, j]
        known = ~np.isnan(y)

        def link(keep, left_out):
            words_ = np.sort(chosen.get((j, left_out), np.zeros(0, dtype=np.uint64)))
            at = np.searchsorted(vocabulary, words_)
            return fit_link(present[np.ix_(keep, at)], stats[keep], earlier[keep], y[keep], weight[keep], words_), at

        held = np.zeros(len(stats))
        for f in range(FOLDS):
            test = fold == f
            model, at = link(known & ~test, f)
            dense = (np.column_stack([stats[test], logit(earlier[test])]) - model.mean) / model.scale
            held[test] = sigmoid(np.column_stack([dense, present[np.ix_(test, at)], np.ones(test.sum())]) @ model.weights)
        models.append(link(known, -1)[0])
        models[-1].threshold = best_threshold(held[known], y[known], weight[known])
        earlier = np.column_stack([earlier, held])
    return models


def shares(counts: dict, sample: int) -> dict:
    """How many rows each class gives: all up to an even share, what small classes leave goes to the others."""
    left, out = sample, {}
    for i, (name, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], str(c[0])))):
        out[name] = min(n, left // (len(counts) - i))
        left -= out[name]
    return out


def sampled_labels(docs: DataFrame, labels: DataFrame, chain: dict, sample: int) -> DataFrame:
    """``id, fold, weight, y, text``: at most ``sample`` labelled documents; written."""
    columns = [F.max(F.when(F.col(c).isNotNull(), (F.col(c) == v).cast("double"))).alias(f"y_{name}")
               for name, (c, v) in chain.items()]
    names = [f"y_{c}" for c in chain]
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(*columns)
    there = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct()
    kind = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names])
    known = written(known.join(there, "id", "left_semi").select("id", *names, kind.alias("kind"), F.xxhash64("id").alias("hash")),
                    "toxicity-labels")
    counts = {r["kind"]: r["count"] for r in known.groupBy("kind").count().collect()}  # at most three values a category
    parts = [known.filter(F.col("kind") == k).orderBy("hash", "id").limit(n).withColumn("weight", F.lit(counts[k] / n))
             for k, n in shares(counts, sample).items() if n]
    if not parts:
        parts = [known.limit(0).withColumn("weight", F.lit(1.0))]
    picked = parts[0]
    for part in parts[1:]:
        picked = picked.unionByName(part)
    # at most `sample` rows are broadcast
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(picked), "id")
    text = F.coalesce("text", F.lit(""))
    return written(rows.groupBy("id", "weight", *names).agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias("text"))
                   .select("id", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), "weight",
                           F.array(*names).alias("y"), "text"), "toxicity-sample")


def chosen_words(features: DataFrame, categories: int, limit: int = WORDS) -> dict:
    """``(category, fold left out) -> word hashes``: those whose presence tells the category apart best.

    Counted for all words of ``features(fold, y, words)`` on the executors.
    """
    pairs = [(j, f) for j in range(categories) for f in range(FOLDS)]
    known = lambda j, f: F.when((F.col("fold") == f) & F.col("y")[j].isNotNull(), 1).otherwise(0)
    hit = lambda j, f: F.when((F.col("fold") == f) & (F.col("y")[j] == 1), 1).otherwise(0)
    sums = [F.sum(g(j, f)).alias(f"{c}_{j}_{f}") for j, f in pairs for c, g in (("n", known), ("p", hit))]
    totals = features.agg(*sums).first()
    per_word = features.select("fold", "y", F.explode("words").alias("word")).groupBy("word").agg(*sums)

    def model(j, left_out):
        folds = [f for f in range(FOLDS) if f != left_out]
        n, positive = (sum(totals[f"{c}_{j}_{f}"] or 0 for f in folds) for c in "np")
        df, both = (sum((F.col(f"{c}_{j}_{f}") for f in folds), F.lit(0)) for c in "np")
        expected = df * (positive / max(n, 1))
        spread = expected * (1 - positive / max(n, 1)) * (1 - df / max(n, 1))
        chi2 = F.when(spread > 0, (both - expected) * (both - expected) / spread)
        return F.when((df >= MIN_ROWS) & (chi2 >= MIN_CHI2), F.struct(F.lit(j).alias("j"), F.lit(left_out).alias("f"), chi2.alias("chi2")))

    each = [model(j, f) for j in range(categories) for f in (-1, *range(FOLDS))]
    fine = written(per_word.select("word", F.explode(F.array_compact(F.array(*each))).alias("m")).select("word", "m.*"), "toxicity-words")
    best = Window.partitionBy("j", "f").orderBy(F.desc("chi2"), "word")
    out: dict = {}
    for r in fine.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).collect():
        out.setdefault((r["j"], r["f"]), []).append(r["word"])
    return {k: np.asarray(v, dtype=np.int64).view(np.uint64) for k, v in out.items()}


def fit(docs: DataFrame, labels: DataFrame, chain: dict = CHAIN, sample: int = SAMPLE) -> list[Model]:
    """The chain, fitted on at most ``sample`` labelled documents."""

    def read(frames):
        for frame in frames:
            for part in (frame.iloc[a:a + 512] for a in range(0, len(frame), 512)):
                hashes, at, stats = text_features(part["text"].tolist())
                bounds = np.searchsorted(at, np.arange(len(part) + 1))
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "fold": part["fold"].to_numpy(), "weight": part["weight"].to_numpy(),
                    "y": part["y"].to_numpy(), "stats": list(stats),
                    "words": [np.unique(hashes[a:b]).astype(np.int64) for a, b in zip(bounds, bounds[1:])]})

    got = sampled_labels(docs, labels, chain, sample).mapInPandas(
        read, "id long, fold int, weight double, y array<double>, stats array<double>, words array<long>")
    got = written(got, "toxicity-features")
    chosen = chosen_words(got, len(chain))
    vocabulary = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *chosen.values()]))
    signed = vocabulary.view(np.int64)

    def mark(frames):
        order = np.argsort(signed, kind="stable")
        for frame in frames:
            bits = []
            for words_ in frame["words"]:
                row = np.zeros(len(signed), dtype=np.uint8)
                row[order] = np.isin(signed[order], np.asarray(words_, dtype=np.int64))
                bits.append(np.packbits(row).tobytes())
            yield frame.drop(columns="words").assign(bits=bits)

    rows = (got.mapInPandas(mark, "id long, fold int, weight double, y array<double>, stats array<double>, bits binary")
            .orderBy("id").toPandas())
    if not len(rows):
        return [Model(np.zeros(0, np.uint64), np.zeros(5 + j), np.ones(5 + j), np.append(np.zeros(5 + j), -30.0))
                for j in range(len(chain))]
    present = np.unpackbits(np.frombuffer(b"".join(rows["bits"]), dtype=np.uint8).reshape(len(rows), -1), axis=1)[:, :len(vocabulary)]
    y = np.stack([np.asarray([np.nan if v is None else v for v in r], dtype=float) for r in rows["y"]])
    return fit_chain(present, np.stack(rows["stats"].to_numpy()), y, rows["fold"].to_numpy(), rows["weight"].to_numpy(), vocabulary, chosen)


def chain_probabilities(models: list[Model], texts: list[str | None]) -> np.ndarray:
    """One column of probabilities per category, in chain order."""
    hashes, at, stats = text_features(texts)
    earlier = np.zeros((len(texts), 0))
    for model in models:
        earlier = np.column_stack([earlier, model.predict(hashes, at, stats, earlier)])
    return earlier


def probabilities(text, models: list[Model]):
    """Column: an array of the categories' probabilities."""

    def run(texts: pd.Series) -> pd.Series:
        parts = [chain_probabilities(models, texts.iloc[a:a + 256].tolist()) for a in range(0, len(texts), 256)]
        return pd.Series(list(np.concatenate(parts)) if parts else [])

    return F.pandas_udf(run, "array<double>")(text)


def score(docs: DataFrame, models: list[Model], chain: dict = CHAIN) -> DataFrame:
    """``doc_id``, a ``p_<category>`` each, ``toxic`` and ``kept`` for every document."""
    rows = docs.select("doc_id", probabilities(F.col("text"), models).alias("p"))
    names = list(chain)
    at = names.index("toxic")
    toxic = F.col("p")[at] >= models[at].threshold
    return rows.select("doc_id", *[F.col("p")[j].alias(f"p_{c}") for j, c in enumerate(names)], toxic.alias("toxic"),
                       (~toxic).alias("kept"))


def keep_clean(docs: DataFrame, models: list[Model], chain: dict = CHAIN) -> DataFrame:
    """The documents, all columns, without those predicted toxic."""
    at = list(chain).index("toxic")
    return docs.filter(probabilities(F.col("text"), models)[at] < models[at].threshold)


@register("op9_toxicity_chain")
def op9_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
