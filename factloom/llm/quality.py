"""Quality classifier: a generalised additive model with pairwise interactions.

Features are ratios and counts of one whole text (bytes, words, lines); labels, language, source and
ids never enter. Fitting runs on the driver on at most ``MAX_FIT`` labelled rows (about; chosen by a
hash of the id): each round goes once round all features and grows for each a tree of depth 2 on the
feature's histogram of gradients (Newton steps of the logistic loss, small learning rate), which is
added to that feature's lookup table. The strongest pairs of features, ranked by the best four-way
split of the residuals, are then boosted the same way on coarse grids. The model is the sum of the
lookup tables; a batch is scored by binning each column and adding table entries.

Labels are learnt only from rows whose crc32 of the id as text, modulo 4, is not 2.

Defined cases: null text counts as empty and is scored; several labels of one id are averaged; null
ids and null labels are not learnt from; without labelled rows of both kinds the score is the share
of good labels (1 if there is none), so nothing is rejected for want of labels; repeated rows score
alike; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

MAX_FIT = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 48, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_LEAF = 150, 60, 0.1, 5.0

FEATURES = (
    "log_words", "word_length", "upper", "digit", "stops", "exclaim", "bars", "symbols", "non_ascii", "lines_per_word",
    "distinct_words", "top_word", "bare_words", "repeated_lines", "line_length", "space", "odd_ends", "capital_words",
    "sentence_words", "brackets", "short_words", "byte_entropy", "links", "run",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_CLASSES = np.stack([_class(c) for c in (_UPPER, _DIGIT, b".,;:?", b"!", b"|", b"#$%&*@~^_+=", bytes(range(128, 256)), b" \t\n\r\v\f", b"<>{}[]()\\/", _LOWER)])
_ENDS = frozenset(b"#$%&*@~^_+=|!")


def features(text: bytes | None) -> list[float]:
    text = text or b""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n = max(1, len(text))
    upper, digit, stop, exclaim, bars, symbols, high, space, brackets, lower = (_CLASSES @ counts).tolist()
    words = text.split()
    w = max(1, len(words))
    kinds: dict[bytes, int] = {}
    for x in words:
        kinds[x] = kinds.get(x, 0) + 1
    share = counts[counts > 0] / n
    lines = [x for x in text.split(b"\n") if x]
    seen: set[bytes] = set()
    again = 0
    for x in lines:
        if x in seen:
            again += len(x)
        seen.add(x)
    ends = [x[-1] for x in words]
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / w, upper / max(1, upper + lower + high / 2), digit / n, stop / w, exclaim / w, bars / w, symbols / w, high / n, len(lines) / w,
        len(kinds) / w, max(kinds.values(), default=0) / w, sum(1 for x in kinds if not x.isalpha()) / max(1, len(kinds)), again / n, float(np.log1p(n / max(1, len(lines)))), space / n, sum(e in _ENDS for e in ends) / w, sum(65 <= x[0] <= 90 for x in words) / w,
        min(200.0, len(words) / max(1, int(counts[46]))), brackets / n, sum(len(x) < 4 for x in words) / w, float(-(share * np.log2(share)).sum()), (text.count(b"http") + text.count(b"www.") + int(counts[64])) / w, max(map(len, words), default=0) ** 0.5,
    ]


@dataclass
class Additive:
    """Intercept, one lookup table for each feature, and one grid for each chosen pair."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, ea, eb, grid in self.pairs:
            total += grid[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-total))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h > 0, g * g / (h + 1.0), 0.0)


def _best_cut(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """The best cut of bins lo..hi-1: (gain, first bin of the right side)."""
    if hi - lo < 2:
        return 0.0, -1
    gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    gr, hr = g[lo:hi].sum() - gl, h[lo:hi].sum() - hl
    gain = np.where((hl * 4 >= LEAST_LEAF / 4) & (hr * 4 >= LEAST_LEAF / 4), _gain(gl, hl) + _gain(gr, hr) - _gain(gl + gr, hl + hr), 0.0)
    k = int(gain.argmax())
    return float(gain[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of depth 2."""
    leaves = [(0, len(g))]
    for _ in range(2):
        grown = []
        for lo, hi in leaves:
            gain, c = _best_cut(g, h, lo, hi)
            grown += [(lo, c), (c, hi)] if gain > 1e-9 else [(lo, hi)]
        leaves = grown
    out = np.zeros(len(g))
    for lo, hi in leaves:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best four-way split of a grid: one cut of the rows, then one of the columns on each side."""
    best, out = 0.0, np.zeros_like(g)
    whole = float(_gain(g.sum(), h.sum()))
    for c in range(1, len(g)):
        gain, value = -whole, np.zeros_like(g)
        for rows in (slice(0, c), slice(c, len(g))):
            gs, hs = g[rows].sum(axis=0), h[rows].sum(axis=0)
            extra, k = _best_cut(gs, hs, 0, len(gs))
            gain += float(_gain(gs.sum(), hs.sum())) + extra
            for cols in [slice(0, k), slice(k, len(gs))] if extra > 0 else [slice(0, len(gs))]:
                value[rows, cols] = gs[cols].sum() / (hs[cols].sum() + 1.0)
        if gain > best:
            best, out = gain, value
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1 - 1e-9
        return Additive(float(np.log(share / (1 - share))), [np.array([])] * x.shape[1], [np.zeros(1)] * x.shape[1])
    model = Additive(float(np.log(y.mean() / (1 - y.mean()))))
    total = np.full(len(y), model.intercept)
    model.edges = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[j], g, len(table)), np.bincount(bins[j], h, len(table)))
            table += step
            total += step[bins[j]]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    g, h = slopes()
    grid = lambda a, b, v: np.bincount(cells[a] * (len(coarse[b]) + 1) + cells[b], v, (len(coarse[a]) + 1) * (len(coarse[b]) + 1)).reshape(len(coarse[a]) + 1, -1)
    ranked = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])), reverse=True)[:PAIRS]
    model.pairs = [(a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for gain, a, b in ranked if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, _, _, table in model.pairs:
            g, h = slopes()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))[1]
            table += step
            total += step[cells[a], cells[b]]
    for table, b in zip(model.tables, bins, strict=True):  # centred tables; the intercept takes the means
        mean = float(table[b].mean())
        table -= mean
        model.intercept += mean
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _matrix(part: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in part]).reshape(-1, len(FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_fit: int = MAX_FIT) -> Additive:
    """The model from the labelled rows of ``docs``; about ``max_fit`` of them at most, whatever the input's size."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(list(_matrix(part)))

    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    share = min(1.0, max_fit / max(1, known.count()))
    scale = 1 << 30
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(share * scale)).select(F.col("doc_id").alias("_lid"), "y")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_lid"))
    got = rows.select("_id", "y", measured(F.col("_text").cast("binary")).alias("x")).groupBy("_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toPandas().sort_values("_id")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, (got["y"].to_numpy(dtype=float) >= 0.5).astype(float))


def score_quality(docs: DataFrame, model: Additive, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every row."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(model.score(_matrix(part)))

    return docs.withColumn(out, scored(F.col(text).cast("binary")))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = fit_quality(docs, labels, doc_id, text)
    scored = score_quality(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), model, "_text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    scored = score_quality(docs, fit_quality(docs, labels, doc_id, text), text, "_fl_score")
    return scored.filter(F.col("_fl_score") >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
