"""Quality rules: boosted trees over document statistics, scored from flat numpy node arrays.

The statistics of every document come from its whole text. A gradient-boosted ensemble is fitted on
at most ``max_labelled`` labelled documents (chosen by hash, so the choice does not follow the order
of the rows) and sent to the tasks as five small arrays. Chosen features are monotone: more symbols,
repeated lines, repeated words or capitals can only lower a score.

Defined cases: a null or empty text has zero words, so it fails the base rules. A null doc_id is
scored like any other. Repeated rows are scored each on its own. Without labels of both classes
there is no model and the base rules alone decide. Other columns, whatever their names, pass through
``filter_documents`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_arrow
from .text import U, Words, chunks, grams, mix

WINDOW = 8
#: Feature name and sign of its effect on the score (0: free).
FEATURES = (
    ("log_words", 0), ("mean_word_chars", 0), ("symbol_share", -1), ("duplicate_line_share", -1), ("repeated_word_share", -1),
    ("capital_share", -1), ("digit_share", 0), ("letterless_word_share", -1), ("distinct_word_share", 0), ("short_word_share", 0),
    ("words_per_line", 0), ("stop_mark_share", 0), ("non_ascii_share", 0), ("top_word_share", 0),
)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SYMBOLS = _table(b"#*$%&|<>")
CAPITALS, DIGITS, MARKS = _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b".,;:?")
LETTERS = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive positions."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and features of each document of a buffer."""
    docs, w = len(offsets) - 1, Words(data, offsets)
    own = w.owner()
    n_words = np.diff(w.bounds)
    lead = (data & 0xC0) != 0x80
    word_chars = _sums(w.inside & lead, offsets)
    n_symbols = _sums(SYMBOLS[data], offsets)

    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_doc = np.repeat(np.arange(docs), np.diff(np.searchsorted(breaks, offsets)) + 1)
    stops = np.sort(np.concatenate([offsets[1:], breaks]))
    full = np.searchsorted(w.start, stops) > np.searchsorted(w.start, starts)
    lines = mix(w.spans(starts[full], stops[full]) + line_doc[full].astype(U) * U(0xD6E8FEB86659FD93))
    order = np.argsort(lines, kind="stable")
    again = order[1:][lines[order][1:] == lines[order][:-1]]
    n_dup_lines = np.bincount(line_doc[full][again], minlength=docs)

    covered = np.zeros(len(w.hash) + 1, dtype=np.int32)
    g = grams(w.hash, WINDOW)
    at = np.flatnonzero(own[: len(g)] == own[WINDOW - 1 :]) if len(g) else np.zeros(0, np.int64)
    hit = at[_repeated(mix(g[at] + own[at].astype(U) * U(0xD6E8FEB86659FD93)))]
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + WINDOW, -1)
    n_repeat = _sums(np.cumsum(covered[:-1]) > 0, w.bounds)

    keyed = np.sort(mix(w.hash + own.astype(U) * U(0xA0761D6478BD642F)) >> U(24) | own.astype(U) << U(40))
    new = np.ones(len(keyed), dtype=bool)
    new[1:] = keyed[1:] != keyed[:-1]
    first = np.flatnonzero(new)
    run_doc = (keyed[first] >> U(40)).astype(np.int64)
    distinct = np.bincount(run_doc, minlength=docs)
    top = np.zeros(docs, dtype=np.int64)
    np.maximum.at(top, run_doc, np.diff(np.append(first, len(keyed))))

    bytes_in = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(LETTERS[data], out=bytes_in[1:])
    letterless = _sums(bytes_in[w.end] == bytes_in[w.start], w.bounds)
    short = _sums(w.end - w.start <= 3, w.bounds)
    letters, size, words = np.maximum(1, np.diff(bytes_in[offsets])), np.maximum(1, np.diff(offsets)), np.maximum(1, n_words)
    features = [
        np.log1p(n_words), word_chars / words, n_symbols / np.maximum(1, word_chars), n_dup_lines / np.maximum(1, np.bincount(line_doc[full], minlength=docs)), n_repeat / words,
        _sums(CAPITALS[data], offsets) / letters, _sums(DIGITS[data], offsets) / size, letterless / words, distinct / words, short / words,
        n_words / (np.diff(np.searchsorted(breaks, offsets)) + 1), _sums(MARKS[data], offsets) / words, _sums(data > 127, offsets) / size, top / words,
    ]
    failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "base_failed": failed, "features": np.column_stack(features)}


class Trees:
    """Flat node arrays of an ensemble. A leaf points at itself; the root of tree t is ``roots[t]``."""

    def __init__(self, feature, threshold, left, right, value, roots, depth):
        self.feature, self.threshold, self.left, self.right = np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32)
        self.value, self.roots, self.depth = np.array(value), np.array(roots, np.int32), depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row: all trees step down one level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.value[node].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over binned features, with monotone signs."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(value)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(v)
        return k

    base = float(np.log(y.mean() / (1 - y.mean())))
    roots.append(leaf(base))
    total = np.full(len(y), base)

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        best, here = (1e-6, None), g[rows].sum() ** 2 / (h[rows].sum() + ridge)
        node = leaf(rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high)))
        if level == depth or len(rows) < 2:
            total[rows] += value[node]
            return node
        for k, c in enumerate(cuts):
            if not len(c):
                continue
            gl, hl = (np.cumsum(np.bincount(code[rows, k], s[rows], minlength=len(c) + 1))[:-1] for s in (g, h))
            gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - here
            gain[(hl < least) | (hr < least) | (signs[k] * (vr - vl) < 0)] = -1
            if (j := int(gain.argmax())) >= 0 and gain[j] > best[0]:
                best = (float(gain[j]), (k, j, float(vl[j]), float(vr[j])))
        if best[1] is None:
            total[rows] += value[node]
            return node
        k, j, vl, vr = best[1]
        middle, below = (vl + vr) / 2, code[rows, k] <= j
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[k]]
        a, b = (grow(r, level + 1, *m, g, h) for r, m in zip((rows[below], rows[~below]), bounds, strict=True))
        feature[node], threshold[node], left[node], right[node] = k, float(cuts[k][j]), a, b
        return node

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, np.maximum(p * (1 - p), 1e-9)))
    return Trees(feature, threshold, left, right, value, roots, depth)


def fit_labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Fit on the statistics of at most ``max_labelled`` labelled documents, which bounds what reaches the driver.

    A label counts once for each id; an id with labels that disagree counts as the higher. Of documents that
    share an id one counts, that of the least text hash. The sample is the least hashes of ids among the
    documents that are there: it is taken after the join, so an id that is repeated takes one place.
    """
    bounded_arrow(docs.sparkSession)
    judged = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    place = F.struct(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    # Only ids and hashes are sorted and cut off; texts come to the sample, which is small enough to go to them.
    there = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(place).alias("__one"))
    sample = there.join(judged, "__id").orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), place.alias("__one"))
    rows = texts.join(F.broadcast(sample), ["__id", "__one"]).select("__id", "__y", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            x = statistics(data, offsets)["features"]
            yield pa.RecordBatch.from_arrays([batch.column("__id").cast(pa.int64()), batch.column("__y").cast(pa.int32()), pa.FixedSizeListArray.from_arrays(x.ravel(), len(FEATURES)).cast(pa.list_(pa.float64()))], ["id", "y", "x"])

    # Rows that are equal to the last byte are one as well.
    measured = rows.mapInArrow(measure, "id long, y int, x array<double>").groupBy("id").agg(F.first("y").alias("y"), F.first("x").alias("x"))
    found = measured.orderBy(F.xxhash64("id"), "id").toPandas()
    y = found["y"].to_numpy(dtype=float) if len(found) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return None
    return fit(np.stack(found["x"].to_list()), (y > 0).astype(float), [s for _, s in FEATURES])


def _verdicts(data: np.ndarray, offsets: np.ndarray, trees: Trees | None, least: float) -> dict[str, np.ndarray]:
    s = statistics(data, offsets)
    score = 1 / (1 + np.exp(-trees.score(s["features"]))) if trees is not None else np.ones(len(offsets) - 1)
    return s | {"score": score, "kept": ~s["base_failed"] & (score >= least)}


def score_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: its counts, the base verdict, the model's probability and the verdict."""
    trees = fit_labelled(docs, labels, id_col=id_col, text_col=text_col, **options)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            s = _verdicts(data, offsets, trees, least)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(s[k].astype(np.int64)) for k in names), pa.array(s["base_failed"]), pa.array(s["kept"]), pa.array(s["score"])],
                ["doc_id", *names, "base_failed", "kept", "score"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, SCHEMA)


def filter_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    trees = fit_labelled(docs, labels, id_col=id_col, text_col=text_col, **options)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, text_col):
            yield batch.filter(pa.array(_verdicts(data, offsets, trees, least)["kept"]))

    return docs.mapInArrow(sift, docs.schema)
