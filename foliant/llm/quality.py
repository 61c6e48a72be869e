"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Training runs round after round through the features in
turn; in its turn a feature gets a tree of depth two on the residuals, and the tree's leaf values
are added, shrunk, to that feature's lookup table. Pairs of features that still explain residuals
get small two-dimensional tables in the same way. A score is the logistic function of the sum of
one table entry for each feature and pair, so scoring a batch is a few array look-ups.

The model is fitted on the driver from a sample of labelled rows, bounded by ``max_labelled`` (the
rows with the smallest hash of their id); scoring reads every text once and shuffles none.
Features come from the text alone.

Null texts count as empty; empty texts get a score like any other. Labels that are null or belong
to no row are left out; of several labels for one id the largest counts. Repeated rows get equal
scores. Rows with a null id are scored and never held out. Without labels of both kinds the model
scores every text with the share of label 1 (a half without labels). A very long text is counted whole,
in one piece. An empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._shared import require, slices, table

#: Most labelled rows that the driver fits on.
MAX_LABELLED = 20_000
BINS = 48
PAIR_BINS = 8
ROUNDS = 150
PAIRS = 6
PAIR_ROUNDS = 60
RATE = 0.1

FEATURES = (
    "log_chars", "upper", "digit", "punct", "symbol", "space", "newline", "non_ascii", "mean_word", "long_words",
    "distinct_words", "words_per_line", "pipe", "bang", "word_end_symbol", "distinct_lines", "short_words", "stops",
)

_UPPER, _DIGIT, _PUNCT, _SPACE, _HIGH = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = True
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_HIGH[128:] = True
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_SYMBOL = ~(_ALPHA | _DIGIT | _PUNCT | _SPACE)


def features(text: str | None) -> np.ndarray:
    """The numbers a score may depend on, all of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    b = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    lines = raw.split(b"\n")
    ends = np.fromiter((x[-1] for x in words), dtype=np.uint8, count=len(words))
    distinct = len(set(words))
    letters = max(int(b[_ALPHA].sum()), 1)
    return np.array([
        np.log1p(len(raw)), b[_UPPER].sum() / letters, b[_DIGIT].sum() / n, b[_PUNCT].sum() / n, b[_SYMBOL].sum() / n,
        b[_SPACE].sum() / n, b[10] / n, b[_HIGH].sum() / n, lengths.sum() / w, (lengths > 12).sum() / w,
        distinct / w, w / max(len(lines), 1), b[124] / w, b[33] / w, _SYMBOL[ends].sum() / w,
        len(set(lines)) / max(len(lines), 1), (lengths < 3).sum() / w, (ends == 46).sum() / w,
    ])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by cell of the best tree that cuts one feature and then, on either side, the other."""
    best, out = -1.0, np.zeros_like(g)
    for a, b, turned in ((g, h, False), (g.T, h.T, True)):
        for mid in range(1, a.shape[0]):
            sides = [(rows, a[rows].sum(axis=0), b[rows].sum(axis=0)) for rows in (slice(0, mid), slice(mid, None))]
            cuts = [_best_split(gs, hs, 0, len(gs)) for _, gs, hs in sides]
            gain = sum(c[0] + gs.sum() ** 2 / (hs.sum() + 1) for c, (_, gs, hs) in zip(cuts, sides))
            if gain > best:
                best, values = gain, np.zeros_like(a)
                for (_, at), (rows, gs, hs) in zip(cuts, sides):
                    for cols in (slice(0, at), slice(at, None)):
                        values[rows, cols] = gs[cols].sum() / (hs[cols].sum() + 1)
                out = values.T if turned else values
    return out


@dataclass
class AdditiveModel:
    """Cut points and lookup tables; ``raw`` adds one entry per table."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (cut, values) in enumerate(zip(self.cuts, self.tables)):
            z += values[np.searchsorted(cut, x[:, j], side="right")]
        for i, j, values in self.pairs:
            z += values[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _best_split(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """(gain, bin to the right of the cut) of the best cut of bins lo..hi."""
    if hi - lo < 2:
        return 0.0, lo
    cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
    left = cg[:-1] ** 2 / (ch[:-1] + 1)
    right = (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1)
    gain = left + right - cg[-1] ** 2 / (ch[-1] + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a depth-two tree on one feature's histogram."""
    out = np.zeros(len(g))
    _, mid = _best_split(g, h, 0, len(g))
    for lo, hi in ((0, mid), (mid, len(g))):
        gain, at = _best_split(g, h, lo, hi)
        for a, b in ((lo, at), (at, hi)) if gain > 0 else ((lo, hi),):
            if b > a:
                out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of log-loss: every round gives each feature one shallow tree."""
    n = len(y)
    if not n or y.min() == y.max():
        share = 0.5 if not n else float(np.clip(y.mean(), 0.01, 0.99))
        return AdditiveModel(float(np.log(share / (1 - share))))
    share = y.mean()
    m = AdditiveModel(float(np.log(share / (1 - share))))
    m.cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    m.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(m.cuts)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(m.pair_cuts)]
    z = np.full(n, m.intercept)

    def residuals():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(binned):
            r, h = residuals()
            size = len(m.tables[j])
            step = RATE * _tree(np.bincount(b, r, size), np.bincount(b, h, size))
            m.tables[j] += step
            z += step[b]
    r, h = residuals()
    ranked = []
    for i in range(x.shape[1]):
        for j in range(i):
            size = len(m.pair_cuts[i]) + 1, len(m.pair_cuts[j]) + 1
            cell = coarse[i] * size[1] + coarse[j]
            g, w = np.bincount(cell, r, size[0] * size[1]), np.bincount(cell, h, size[0] * size[1])
            ranked.append((float((g**2 / (w + 1)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(ranked, reverse=True)[:PAIRS]]
    tables = {p: np.zeros((len(m.pair_cuts[p[0]]) + 1, len(m.pair_cuts[p[1]]) + 1)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for (i, j), values in tables.items():
            r, h = residuals()
            cell = coarse[i] * values.shape[1] + coarse[j]
            g, w = (np.bincount(cell, v, values.size).reshape(values.shape) for v in (r, h))
            step = RATE * _pair_tree(g, w)
            values += step
            z += step.ravel()[cell]
    m.pairs = [(i, j, v) for (i, j), v in tables.items()]
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [features(t).tolist() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on at most ``max_labelled`` labelled rows that are not held out."""
    sample = (
        require(labels, "doc_id", "quality")
        .where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("l_id"))
        .agg(F.max("quality").alias("y"))
        .orderBy(F.xxhash64("l_id"), "l_id")
        .limit(max_labelled)
    )
    texts = require(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The sample has at most max_labelled rows of two numbers.
    rows = (
        texts.join(F.broadcast(sample), F.col("id") == F.col("l_id"))
        .select("text", F.col("y").cast("double").alias("y"))
        .mapInArrow(_featurise, "x array<double>, y double")
        .orderBy(F.hash("x"), "x", "y")
        .limit(max_labelled)
        .toArrow()
    )
    if not rows.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(rows.column("x").to_pylist())
    return fit(x, rows.column("y").to_numpy())


def _scores(batch: pa.RecordBatch, model: AdditiveModel, text_col: str) -> np.ndarray:
    rows = [features(t) for t in batch.column(text_col).to_pylist()]
    return model.score(np.array(rows).reshape(len(rows), len(FEATURES)))


def score_quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per input row, scored where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(_scores(batch, model, text_col))], [id_col, "score"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return require(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_quality(docs: DataFrame, model: AdditiveModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(_scores(batch, model, text_col) >= least))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
