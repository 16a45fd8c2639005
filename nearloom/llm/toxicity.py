"""Toxicity by a chain of linear classifiers over words and word beginnings.

Categories are predicted one after another.  The model of a category sees the
text's features and the probabilities of all earlier categories; in training
those are out-of-fold predictions, so that a later model learns how far to
trust them on texts that the earlier ones have not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearloom.llm.runtime import ship, slices, stored

#: Labelled documents that the chain is fitted on, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 8_000
#: Features are hashed to so many values; a category's model considers the strongest of them, if in enough texts and
#: so many standard errors from independence that chance hardly makes them.
SPACE, CONSIDERED, LEAST_TEXTS, LEAST_Z = 1 << 22, 400, 4, 4.0
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5)
FOLDS, ROUNDS, RIDGE = 3, 25, 0.1
#: A category is flagged above what but one in a thousand negatives reach out of fold, within these probabilities.
FALSE_RATE, LOWEST, HIGHEST = 0.001, 0.1, 0.5
#: Words whose features a Python worker keeps from batch to batch.
KEPT = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    out = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % SPACE]
    return out + [zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "surrogatepass")) % SPACE for n in BEGINNINGS if len(word) >= n]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


class Link(NamedTuple):
    """One category's model: weights of features and of earlier categories' log-odds."""

    category: str
    features: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    bias: float
    threshold: float = 0.5


class Rows(NamedTuple):
    """A sparse binary matrix by rows."""

    columns: np.ndarray
    starts: np.ndarray  # of each row, and the end

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> "Rows":
        sizes = np.diff(self.starts)[rows]
        at = np.concatenate([[0], np.cumsum(sizes)])
        index = np.repeat(self.starts[:-1][rows] - at[:-1], sizes) + np.arange(at[-1])
        return Rows(self.columns[index], at)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.columns])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def only(self, features: np.ndarray) -> "Rows":
        """The columns in the sorted ``features``, renumbered."""
        at = np.searchsorted(features, self.columns)
        at[at == len(features)] = 0
        keep = features[at] == self.columns if len(features) else np.zeros(len(self.columns), bool)
        kept = np.concatenate([[0], np.cumsum(keep)])
        return Rows(at[keep].astype(np.int32), kept[self.starts])

    def dense(self, width: int) -> np.ndarray:
        out = np.zeros((len(self), width), np.float32)
        out[np.repeat(np.arange(len(self)), np.diff(self.starts)), self.columns] = 1
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _newton(x: np.ndarray, dense: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by Newton's method; ``x`` is at most TRAIN_ROWS by CONSIDERED numbers.

    Both classes weigh the same in all, so that one rare word is enough for a rare class.
    """
    n, width = x.shape
    a = np.concatenate([x, dense, np.ones((n, 1))], axis=1).astype(np.float32)
    ones = max(float(y.sum()), 0.5)
    weigh = np.where(y > 0, n / (2 * ones), n / (2 * max(n - ones, 0.5)))
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(a @ w.astype(np.float32))
        g = a.T @ (weigh * (p - y)).astype(np.float32) + penalty * w
        curved = (a * np.sqrt(weigh * np.maximum(p * (1 - p), 1e-6)).astype(np.float32)[:, None])
        step = np.linalg.solve((curved.T @ curved).astype(float) + np.diag(penalty), g)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-3:
            break
    return w[:width], w[width:-1], float(w[-1])


def _fit_link(category: str, x: Rows, strong: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Link:
    """Weigh the features ``strong``, which were screened one by one, together."""
    w, chained, bias = _newton(x.only(strong).dense(len(strong)), earlier, y, RIDGE, ROUNDS)
    return Link(category, strong, w, chained, bias)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _apply(link: Link, x: Rows, earlier: np.ndarray) -> np.ndarray:
    return _sigmoid(x.only(link.features).dot(link.weights) + earlier @ link.chained + link.bias)


def fit_chain(x: Rows, labels: dict[str, np.ndarray], fold: np.ndarray, strong: dict[tuple[str, int], np.ndarray], folds: int = FOLDS) -> list[Link]:
    """The chain over ``labels`` (arrays of 0 and 1), in their order.

    ``fold`` has the fold of each row; ``strong`` the sorted features of each
    category without the rows of a fold, and of all rows under fold -1.
    """
    chain: list[Link] = []
    earlier = np.zeros((len(x), 0))
    none = np.zeros(0, np.int32)
    for category, y in labels.items():
        unseen = np.full(len(x), y.mean() if len(y) else 0.5)
        for f in range(folds):
            own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(own) and len(rest):
                link = _fit_link(category, x.take(rest), strong.get((category, f), none), earlier[rest], y[rest])
                unseen[own] = _apply(link, x.take(own), earlier[own])
        bar = np.quantile(unseen[y == 0], 1 - FALSE_RATE, method="higher") if (y == 0).any() else HIGHEST
        chain.append(_fit_link(category, x, strong.get((category, -1), none), earlier, y)._replace(threshold=float(np.clip(bar, LOWEST, HIGHEST))))
        earlier = np.concatenate([earlier, _logit(unseen)[:, None]], axis=1)
    return chain


def screened(rows: DataFrame, categories: Sequence[str], folds: int = FOLDS, considered: int = CONSIDERED) -> DataFrame:
    """``(category, fold, feature)``: the features that tell most about a category in the rows outside a fold, and in all (fold -1).

    ``rows`` are ``(y0, y1, ..., fold, f)``.  A feature counts by its standard
    errors from independence; ties go to the smaller one.  Counts are
    aggregated where the rows are; only the best are kept.
    """
    ys = [f"y{i}" for i in range(len(categories))]
    parts = [-1, *range(folds)]
    outside = lambda f: F.lit(True) if f < 0 else F.col("fold") != f
    sums = {f"n{f}": F.count_if(outside(f)) for f in parts} | {f"{y}_{f}": F.sum(F.when(outside(f), F.col(y)).otherwise(0)) for y in ys for f in parts}
    named = [v.alias(k) for k, v in sums.items()]
    whole = rows.agg(*named).first().asDict()
    texts = rows.select(*ys, "fold", F.explode("f").alias("feature")).groupBy("feature").agg(*named).where(F.col("n-1") >= LEAST_TEXTS)

    def z(i: int, f: int) -> Column:
        rate = (whole[f"y{i}_{f}"] or 0) / max(whole[f"n{f}"] or 0, 1)
        n = F.col(f"n{f}")
        return F.when(n >= LEAST_TEXTS, F.abs((F.col(f"y{i}_{f}") - n * rate) / F.sqrt(F.greatest(n * (rate * (1 - rate)), F.lit(1e-9))))).otherwise(0.0)

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(f).alias("fold"), z(i, f).alias("z")) for i, c in enumerate(categories) for f in parts]))
    found = texts.select("feature", each.alias("at")).select("at.*", "feature").where(F.col("z") >= LEAST_Z)
    best = Window.partitionBy("category", "fold").orderBy(F.desc("z"), "feature")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= considered).select("category", "fold", "feature")


def as_rows(features: Sequence[Sequence[int]]) -> Rows:
    arrays = [np.unique(np.asarray(f, np.int32)) for f in features]
    return Rows(np.concatenate([np.zeros(0, np.int32), *arrays]), np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int64))


def predict(chain: Sequence[Link], x: Rows) -> np.ndarray:
    """Probabilities, a column per category."""
    out, earlier = [], np.zeros((len(x), 0))
    for link in chain:
        out.append(_apply(link, x, earlier))
        earlier = np.concatenate([earlier, _logit(out[-1])[:, None]], axis=1)
    return np.stack(out, axis=1) if out else np.zeros((len(x), 0))


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> list[Link]:
    """Fit the chain on at most ``most`` labelled documents.

    Labels with a null id or category are left out; of repeated ids the
    largest labels and the smallest text count; documents without text train
    as empty ones.  Without any labelled document every probability is one
    half and nothing is flagged.  Features are screened by a distributed
    count, so the driver takes in those that are used alone: at most
    CONSIDERED per category and fold.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*[F.max(F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    # `most` rows of a few numbers each: a bound by parameter, so small enough to broadcast.
    chosen = spark.createDataFrame(known.orderBy(F.xxhash64("_id"), "_id").limit(most).toPandas(), known.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [sorted({f for w in words_of(t) for f in word_features(w)}) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.int32()))], [*b.schema.names[:-1], "f"])

    ys = [f"y{i}" for i in range(len(categories))]
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "_id").groupBy("_id", *ys).agg(F.min("t").alias("t"))
    fold = F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int")
    rows = stored(texts.select("_id", *ys, fold.alias("fold"), "t").mapInArrow(run, f"_id {dict(known.dtypes)['_id']}, {', '.join(f'{y} int' for y in ys)}, fold int, f array<int>"), "features")
    best: dict[tuple[str, int], list[int]] = {}
    for category, part, feature in screened(rows, categories).collect():
        best.setdefault((category, part), []).append(feature)
    used = sorted({f for v in best.values() for f in v})
    keep = F.array_intersect("f", F.split(F.lit(",".join(map(str, used))), ",").cast("array<int>")) if used else F.array().cast("array<int>")
    found = rows.select("_id", *ys, "fold", keep.alias("f")).orderBy("_id").toArrow().combine_chunks()
    if not found.num_rows:
        none = np.zeros(0)
        return [Link(c, none.astype(np.int32), none, np.zeros(i), 0.0) for i, c in enumerate(categories)]
    x = as_rows(found.column("f").to_pylist())
    strong = {k: np.array(sorted(v), np.int32) for k, v in best.items()}
    return fit_chain(x, {c: found.column(y).to_numpy() for c, y in zip(categories, ys, strict=True)}, found.column("fold").to_numpy(), strong)


def classify(docs: DataFrame, chain: Sequence[Link], threshold: float | None = None, text_col: str = "text", flag: str = "toxic") -> DataFrame:
    """``docs`` with ``p_<category>`` (double) for each category of the chain and ``is_<flag>`` (boolean).

    ``is_<flag>`` says whether the probability of category ``flag`` exceeds
    ``threshold``, by default the one that its link learned out of fold.  Whole texts are read; null and empty ones have no
    features.  All rows and other columns are kept; clashing columns of those
    names are replaced.
    """
    ship(docs.sparkSession)
    at = [link.category for link in chain].index(flag)
    bar = chain[at].threshold if threshold is None else threshold
    new = [*[f"p_{link.category}" for link in chain], f"is_{flag}"]
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(*kept).withColumns({c: F.lit(0.0) for c in new[:-1]} | {new[-1]: F.lit(True)}).schema
    used = np.unique(np.concatenate([link.features for link in chain]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        wanted = set(used.tolist())
        for b in slices(batches):
            if len(known) > KEPT:
                known.clear()
            rows = []
            for text in b.column(b.num_columns - 1).to_pylist():
                found: set[int] = set()
                for w in words_of(text):
                    own = known.get(w)
                    if own is None:
                        own = known[w] = [f for f in word_features(w) if f in wanted]
                    if own:
                        found.update(own)
                rows.append(list(found))
            p = predict(chain, as_rows(rows))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(p[:, i]) for i in range(len(chain))), pa.array(p[:, at] > bar)], [*kept, *new])

    return docs.select(*kept, F.col(text_col).cast("string").alias("_text_to_judge")).mapInArrow(run, schema)
