"""Toxicity: a chain of sparse linear classifiers over words and word beginnings.

The categories are predicted in order. The model of a later category also sees the probabilities of the earlier ones;
in training those are out-of-fold, made by models that did not see the row. The labels table has two categories: low
quality (quality = 0), then toxic. The chain takes any others in the same way (``Category``).

The classifier is fitted on a bounded sample: the TRAIN_DOCS labelled documents whose hashed doc_id is smallest. It is
fitted in one task; its weights (FEATURES at most) go to every scoring task.

Defined cases: a null or empty text has no features and gets the chain's base rates; labels that are null or belong to
no document are left out, several labels of a document count as its highest; with no labels of both kinds a category's
probability is its smoothed base rate, and 0 with no labels at all; rows with a null doc_id are scored like any other;
of rows that repeat a doc_id the smallest text is fitted on. ``keep_clean`` leaves all columns as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 6_000
FOLDS = 3
FEATURES = 8_192
MIN_DOCS = 3
#: Chi-square (one degree of freedom) at which a word counts as evidence: chance passes one in 100,000.
MIN_CHI2 = 19.5
PREFIXES = (4, 5, 6)
STEPS = 150
L1 = 5e-5
REJECT_AT = 0.3

_WORD = re.compile(r"\w+|[^\w\s]+")


@dataclass
class Category:
    name: str
    label: Column


def default_categories() -> list[Category]:
    return [Category("low_quality", (F.col("quality") == 0).cast("int")), Category("toxic", (F.col("toxic") == 1).cast("int"))]


def words_of(text: str | None) -> set[str]:
    """The distinct words and runs of marks of a text, lower-cased."""
    lower = (text or "").lower()
    return set(_WORD.findall(lower)) if len(lower) < 1_000_000 else {m.group() for m in _WORD.finditer(lower)}


def features_of(words: set[str]) -> set[str]:
    """The words, and the beginnings that longer words share (``abcd~``)."""
    found = set(words)
    for n in PREFIXES:
        found.update(w[:n] + "~" for w in words if len(w) >= n)
    return found


@dataclass
class Chain:
    """weights[k] maps a feature to its weight in category k's model; carried[k] weighs the earlier probabilities."""

    names: list[str]
    weights: list[dict[str, float]] = field(default_factory=list)
    carried: list[list[float]] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)

    def scores(self, text: str | None) -> list[float]:
        found, out = features_of(words_of(text)), []
        for weights, carried, bias in zip(self.weights, self.carried, self.bias):
            z = bias + sum(weights[f] for f in weights.keys() & found) + sum(c * p for c, p in zip(carried, out))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def _fit_linear(rows: np.ndarray, cols: np.ndarray, n_cols: int, extra: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with an L1 penalty on the sparse part: accelerated proximal gradient steps."""
    n = len(y)
    base = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)) if n else -30.0
    w, e, b = np.zeros(n_cols), np.zeros(extra.shape[1]), float(base)
    if n == 0 or y.min() == y.max():
        return w, e, b
    per_row = np.bincount(rows, minlength=n)
    rate = 4.0 * n / (per_row.sum() + n * (1 + extra.shape[1])) * 8
    wp, ep, bp, t = w, e, b, 1.0
    for _ in range(STEPS):
        z = np.bincount(rows, weights=wp[cols], minlength=n) + extra @ ep + bp
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        w2 = wp - rate * np.bincount(cols, weights=error[rows], minlength=n_cols)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * L1, 0)
        e2, b2 = ep - rate * (extra.T @ error), bp - rate * error.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wp, ep, bp = w2 + (t - 1) / t2 * (w2 - w), e2 + (t - 1) / t2 * (e2 - e), b2 + (t - 1) / t2 * (b2 - b)
        w, e, b, t = w2, e2, float(b2), t2
    return w, e, b


def fit_chain(texts: list[str | None], labels: np.ndarray, names: list[str], folds: np.ndarray) -> Chain:
    """``labels`` has a column of 0 and 1 for each category; ``folds`` numbers the fold of each text."""
    numbers: dict[str, int] = {}
    found = [np.array([numbers.setdefault(f, len(numbers)) for f in features_of(words_of(t))], dtype=np.int32) for t in texts]
    all_rows = np.repeat(np.arange(len(texts)), [len(ids) for ids in found])
    all_ids = np.concatenate([np.empty(0, dtype=np.int32), *found])
    names_of = list(numbers)
    del found, numbers
    n, chain = len(texts), Chain(names)
    counts = np.bincount(all_ids, minlength=len(names_of))
    earlier = np.zeros((n, 0))
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        p = y.mean() if n else 0.0
        kept: list[tuple[float, str, int]] = []
        if 0 < p < 1:
            able = np.flatnonzero((counts >= MIN_DOCS) & (counts < n))
            c, a = counts[able], np.bincount(all_ids, weights=y[all_rows], minlength=len(names_of))[able]
            chi2 = (a - c * p) ** 2 * n / (c * (n - c) * p * (1 - p))
            kept = [(-x, names_of[i], i) for x, i in zip(chi2[chi2 >= MIN_CHI2].tolist(), able[chi2 >= MIN_CHI2].tolist())]
        chosen = {f: i for i, (_, f, _) in enumerate(sorted(kept)[:FEATURES])}
        column = np.full(len(names_of), -1)
        column[[i for _, _, i in sorted(kept)[:FEATURES]]] = np.arange(len(chosen))
        cols = column[all_ids] if len(names_of) else np.empty(0, dtype=np.int64)
        rows, cols = all_rows[cols >= 0], cols[cols >= 0]
        w, e, b = _fit_linear(rows, cols, len(chosen), earlier, y)
        chain.weights.append({f: float(w[i]) for f, i in chosen.items() if w[i]})
        chain.carried.append(e.tolist())
        chain.bias.append(b)
        if k + 1 < len(names):
            out_of_fold = np.zeros(n)
            for fold in range(FOLDS):
                held = folds == fold
                place, inside = np.cumsum(~held) - 1, ~held[rows] if len(rows) else np.zeros(0, dtype=bool)
                fw, fe, fb = _fit_linear(place[rows[inside]], cols[inside], len(chosen), earlier[~held], y[~held])
                z = np.bincount(rows, weights=fw[cols], minlength=n) + earlier @ fe + fb
                out_of_fold[held] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[held]
            earlier = np.column_stack([earlier, out_of_fold])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: list[Category] | None = None, train_docs: int = TRAIN_DOCS) -> Chain:
    categories = categories or default_categories()
    names = [c.name for c in categories]
    marked = labels.select(F.col("doc_id").alias("_id"), *(c.label.alias(f"_y{k}") for k, c in enumerate(categories))).dropna()
    per_doc = marked.groupBy("_id").agg(*(F.max(f"_y{k}").alias(f"_y{k}") for k in range(len(names))))
    known = docs.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    chosen = per_doc.join(known, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(train_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, dict] = {}
        for r in (r for b in batches for r in b.to_pylist()):
            held = rows.setdefault(r["doc_id"], r)
            if (r["text"] or "") < (held["text"] or ""):
                rows[r["doc_id"]] = r
        ordered = [rows[i] for i in sorted(rows)]
        y = np.array([[r[f"_y{k}"] for k in range(len(names))] for r in ordered]).reshape(len(ordered), len(names))
        folds = np.array([(r["doc_id"] * 0x9E3779B1 >> 7) % FOLDS for r in ordered], dtype=np.int64)
        chain = fit_chain([r["text"] for r in ordered], y, names, folds)
        for k in range(len(names)):
            columns = {"k": pa.array([k], pa.int32()), "bias": pa.array([chain.bias[k]]), "carried": pa.array([chain.carried[k]], pa.list_(pa.float64()))}
            columns |= {"feature": pa.array([list(chain.weights[k])], pa.list_(pa.string())), "weight": pa.array([list(chain.weights[k].values())], pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(columns)

    made = sample.repartition(1).mapInArrow(fit, "k int, bias double, carried array<double>, feature array<string>, weight array<double>").collect()
    chain = Chain(names)
    for row in sorted(made, key=lambda r: r["k"]):
        chain.weights.append(dict(zip(row["feature"], row["weight"])))
        chain.carried.append(list(row["carried"]))
        chain.bias.append(row["bias"])
    if not made:
        chain.weights, chain.carried, chain.bias = [{} for _ in names], [[] for _ in names], [-30.0 for _ in names]
    return chain


def score(docs: DataFrame, chain: Chain, prefix: str = "p_") -> DataFrame:
    """``docs`` with a column p_<category> for each category, in place of columns so named."""
    added = [f"{prefix}{n}" for n in chain.names]
    rest = [c for c in docs.columns if c not in added]
    schema = docs.select(*rest, *(F.lit(0.0).alias(a) for a in added)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = np.array([chain.scores(t) for t in part.column("text").to_pylist()]).reshape(-1, len(added))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(made[:, k]) for k in range(len(added)))], names=[*rest, *added])

    return docs.select(*rest).mapInArrow(run, schema)


def toxicity_query(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= reject_at).alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """``docs`` without the rows that the chain finds toxic."""
    prefix = "_" * (1 + max((len(c) for c in docs.columns), default=0))  # longer than any column's name
    return score(docs, train(docs, labels), prefix).where(F.col(f"{prefix}toxic") < reject_at).select(*docs.columns)
