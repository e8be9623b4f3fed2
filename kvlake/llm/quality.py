"""Quality rules: isolation forest on rule statistics.

Each text gets a row of statistics.  Fixed rules fail some documents outright;
an isolation forest, grown on a bounded sample of labelled rows, gives the rest
an anomaly score from the path lengths over random splits, and the threshold of
that score is calibrated on labelled rows.

Defined results: a null or empty text has no words, so it fails the rules;
repeated rows are scored one by one, and a score equal to the threshold is kept; an
empty table gives an empty result; without labels there is no threshold and only the
fixed rules reject; an id labelled more than once counts with its lowest label.  Extra
columns are kept by ``filter_documents``; names beginning with ``_kv_`` are
reserved.  A text is held whole by the task that reads it, at some 60 bytes for each of
its words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import Tokens, as_bytes, bytes_per_doc, per_doc, slices, span_hashes, windows
from .store import small_batches

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
FIT_ROWS = 20_000  # most labelled rows that the forest and its threshold are fitted on
TREES, SUBSAMPLE = 100, 256
GOOD_LOSS = 0.002  # share of labelled good rows that the threshold may reject

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_types")


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """Rule statistics of each text of an Arrow string column.

    ``n_repeat_words`` counts words inside a 5-word window that the text holds
    twice or more, the first place included; ``n_dup_lines`` counts lines with a
    word that equal an earlier line.  Equality is that of 64-bit hashes.
    """
    data, off = as_bytes(column)
    out = {c: np.zeros(len(off) - 1, np.int64) for c in COUNTS}
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    for a, b in slices(off):
        o = off[a : b + 1] - off[a]
        d = data[off[a] : off[b]]
        t = Tokens(d, o, "space")
        h = t.hashes(False)
        out["n_words"][a:b] = t.counts()
        # bytes of words, less those that continue a character; no white space does
        out["word_chars"][a:b] = per_doc(t, t.end - t.start) - bytes_per_doc(o, (d & 0xC0) == 0x80)
        out["n_symbols"][a:b] = bytes_per_doc(o, symbol[d])
        out["n_upper"][a:b] = bytes_per_doc(o, (d >= 65) & (d <= 90))
        out["n_digits"][a:b] = bytes_per_doc(o, (d >= 48) & (d <= 57))
        out["n_types"][a:b] = _distinct(t.doc, h, b - a)
        at, wh = windows(t, h, WINDOW)
        seen = _repeated(t.doc[at], wh)
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, at[seen], 1)
        np.subtract.at(edge, at[seen] + WINDOW, 1)
        out["n_repeat_words"][a:b] = per_doc(t, np.cumsum(edge)[:-1] > 0)
        lines = Tokens(d, o, "line")
        with_word = np.searchsorted(t.start, lines.end) > np.searchsorted(t.start, lines.start)
        lh = span_hashes(d, lines.start, lines.end, False)[with_word]
        doc = lines.doc[with_word]
        n = np.bincount(doc, minlength=b - a)
        out["n_lines"][a:b] = n
        out["n_dup_lines"][a:b] = n - _distinct(doc, lh, b - a)
    return out


def _keyed(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each text."""
    key = _keyed(doc, h)
    order = np.argsort(key)
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return np.bincount(d[new], minlength=n)


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash occurs twice or more in its text."""
    key = _keyed(doc, h)
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(k), bool)
    out[order] = same
    return out


def _scanner(text_col: str, names: list[str], sent=None, kept: bool = False):
    """Columns ``names`` with the statistics, and with the verdict if a model is ``sent``;
    of ``kept`` documents alone, without either, if that is asked for."""

    def run(batches):
        for batch in batches:
            stats = text_stats(batch.column(batch.schema.get_field_index(text_col)))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            if sent is None:
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(stats[c]) for c in COUNTS)], names=[*names, *(f"_kv_{c}" for c in COUNTS)])
                continue
            n = stats["n_words"]
            failed = (n < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
            if sent.value is None or not len(n):
                score, odd = np.zeros(len(n)), np.zeros(len(n), bool)
            else:
                forest, most = sent.value
                score = path_scores(forest, features(pd.DataFrame(stats)))
                odd = score > most
            keep = ~failed & ~odd
            if kept:
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))
                continue
            verdict = {"failed": failed, "kept": keep, "score": score}
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, (stats | verdict).values())], names=[*names, *(f"_kv_{c}" for c in stats | verdict)])

    return run


STATS = [T.StructField(f"_kv_{c}", T.LongType()) for c in COUNTS]
VERDICT = [T.StructField("_kv_failed", T.BooleanType()), T.StructField("_kv_kept", T.BooleanType()), T.StructField("_kv_score", T.DoubleType())]


def with_stats(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and one ``_kv_`` column for each statistic."""
    small_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    need = df.select(*dict.fromkeys([*keep, text_col]))
    return need.mapInArrow(_scanner(text_col, list(keep)), T.StructType([*(df.schema[c] for c in keep), *STATS]))


def features(s: pd.DataFrame) -> np.ndarray:
    """Length-free ratios of the statistics; columns as in COUNTS."""
    n = np.maximum(s["n_words"].to_numpy(float), 1)
    c = np.maximum(s["word_chars"].to_numpy(float), 1)
    lines = np.maximum(s["n_lines"].to_numpy(float), 1)
    return np.column_stack([
        c / n,
        s["n_symbols"] / c,
        s["n_dup_lines"] / lines,
        s["n_repeat_words"] / n,
        s["n_upper"] / c,
        s["n_digits"] / c,
        s["n_types"] / np.sqrt(n),
        n / lines,
    ])


class IsolationForest:
    """Random split trees in flat arrays; ``score`` is 2 ** (-mean path / c)."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 42):
        rng = np.random.default_rng(seed)
        size = min(subsample, len(x))
        self.norm = _mean_path(size)
        depth = max(1, int(np.ceil(np.log2(max(2, size)))))
        self.trees = [self._grow(x[rng.choice(len(x), size, replace=False)], depth, rng) for _ in range(trees)]

    @staticmethod
    def _grow(x, depth, rng):
        feature, cut, left, right, value = [], [], [], [], []

        def node(rows, level):
            k = len(feature)
            for lst, v in ((feature, -1), (cut, 0.0), (left, k), (right, k), (value, level + _mean_path(len(rows)))):
                lst.append(v)
            lo, hi = rows.min(0), rows.max(0)
            can = np.flatnonzero(hi > lo)
            if level < depth and len(rows) > 1 and len(can):
                f = int(rng.choice(can))
                c = float(rng.uniform(lo[f], hi[f]))
                feature[k], cut[k] = f, c
                side = rows[:, f] <= c
                left[k] = node(rows[side], level + 1) if side.any() else k
                right[k] = node(rows[~side], level + 1) if (~side).any() else k
            return k

        node(x, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value), depth

    @property
    def plain(self) -> tuple:
        """The forest as numbers and arrays alone, its trees one after the other; what is
        broadcast.  A leaf leads to itself."""
        at = np.cumsum([0] + [len(t[0]) for t in self.trees])
        feature, cut, left, right, value = (np.concatenate([t[k] + (at[n] if k in (2, 3) else 0) for n, t in enumerate(self.trees)]) for k in range(5))
        leaf = feature < 0
        return max(self.norm, 1e-9), max(t[5] for t in self.trees), at[:-1], np.where(leaf, 0, feature), np.where(leaf, np.inf, cut), np.where(leaf, np.arange(len(leaf)), left), right, value

    def score(self, x: np.ndarray) -> np.ndarray:
        return path_scores(self.plain, x)


def path_scores(forest: tuple, x: np.ndarray) -> np.ndarray:
    """All rows go down all trees together, a level at a time."""
    norm, depth, roots, feature, cut, left, right, value = forest
    row = (np.arange(len(x)) * x.shape[1])[:, None]
    at, cells = np.repeat(roots[None, :], len(x), axis=0), np.ascontiguousarray(x).ravel()
    for _ in range(depth):
        at = np.where(cells[row + feature[at]] <= cut[at], left[at], right[at])
    return 2.0 ** (-value[at].mean(axis=1) / norm)


def _mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def base_failed(prefix: str = ""):
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, seed: int = 42) -> tuple[IsolationForest, float] | None:
    """Forest and threshold from at most ``fit_rows`` labelled rows.

    The sample is the documents of the ``fit_rows`` labelled ids with the smallest hash,
    so it does not depend on partitioning; it is broadcast to the documents, so only its
    texts are looked at.  Those that fail the fixed rules are left out.  The forest grows
    on the rows labelled good.  The threshold is the one that separates the two
    labels best among those that lose no more than ``GOOD_LOSS`` of the good
    rows.  None if no good row is labelled.
    """
    lab = labels.where("quality is not null").select(F.col(id_col).try_cast(docs.schema[id_col].dataType).alias("_kv_id"), "quality").where("_kv_id is not null")
    lab = lab.groupBy("_kv_id").agg(F.min("quality").alias("_kv_label"))
    share = min(1.0, 1.5 * fit_rows / max(1, lab.count()))  # so that tasks send few rows beyond the sample
    place = F.xxhash64(F.col("_kv_id"), F.lit(seed))
    sample = lab.where(place.cast("double") <= (2 * share - 1) * 2.0**63).orderBy(place, "_kv_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("_kv_id"), F.col(text_col).alias("_kv_text")).join(F.broadcast(sample), "_kv_id")
    rows = with_stats(rows, "_kv_text", ["_kv_id", "_kv_label"]).where(~base_failed("_kv_"))
    counts = [f"_kv_{c}" for c in COUNTS]
    rows = rows.orderBy(place, "_kv_id", *counts).limit(fit_rows)  # ids may be repeated
    rows = rows.select("_kv_label", *(F.col(c).alias(c[4:]) for c in counts)).toPandas()
    good = (rows["_kv_label"] == 1).to_numpy() if len(rows) else np.zeros(0, bool)
    if not good.any():
        return None
    x = features(rows)
    forest = IsolationForest(x[good], seed=seed)
    s = forest.score(x)
    top = np.sort(s[good])[::-1]
    least = float(top[int(GOOD_LOSS * len(top))])  # losing the rows above it is allowed
    bad = np.sort(s[~good])
    cuts = np.unique(s[s >= least])
    gain = [(len(bad) - np.searchsorted(bad, c, "right")) / max(1, len(bad)) - (s[good] > c).mean() for c in cuts]
    return forest, float(cuts[int(np.argmax(gain))])


def judged(docs: DataFrame, model: tuple[IsolationForest, float] | None, text_col: str, keep: list[str], kept: bool = False) -> DataFrame:
    """The columns ``keep`` with statistics and verdict, or with ``kept`` those of the
    documents that pass, alone.  What is broadcast is 100 trees of at most 511 nodes,
    whatever the input."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model and (model[0].plain, model[1]))
    fields = [docs.schema[c] for c in keep]
    need = docs.select(*dict.fromkeys([*keep, text_col]))
    return need.mapInArrow(_scanner(text_col, list(keep), sent, kept), T.StructType(fields if kept else [*fields, *STATS, *VERDICT]))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per document: id, statistics, score and verdict."""
    out = judged(docs, fit(docs, labels, id_col, text_col, seed=seed), text_col, [id_col])
    return out.select(
        id_col,
        *(F.col(f"_kv_{c}").alias(c) for c in COUNTS[:5]),
        F.col("_kv_failed").alias("base_failed"),
        F.col("_kv_kept").alias("kept"),
        F.col("_kv_score").alias("anomaly_score"),
        *(F.col(f"_kv_{c}").alias(c) for c in COUNTS[5:]),
    )


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return judged(docs, fit(docs, labels, id_col, text_col, seed=seed), text_col, list(docs.columns), kept=True)
