"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed in Arrow batches on the executors. Training takes a bounded sample (at most `max_train_rows` labelled rows,
chosen by a hash of their id; a documented parameter), whose statistics, not texts, are collected; trees grow
level by level on quantile-binned features with Newton leaf values. The forest is flattened into arrays (feature,
threshold, left child, leaf value) of a perfect binary layout, so a batch is scored by `depth` rounds of numpy gathers
over all trees. Only the text is an input of a score.

Defined results: null and empty texts have statistics of zero and get a score like any other; rows with a null id are
scored and never used for training; null labels are no labels; of repeated labels of one id the larger counts;
of rows that repeat an id all train, within the bound; without labels, or with one class only, the score is the share of
label 1 (0.5 without labels); an empty table gives an empty result; other columns are ignored, or carried along as `keep`, which
may not hold the name of the score's own column (`score_col`, a ValueError).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hashed_share, quoted, refuse_clash, text_batches, trimmed

NAMES = ["log_bytes", "log_words", "word_length", "unique_words", "top_word", "repeats", "upper", "digits", "punctuation", "spaces", "newlines", "bars", "high_bytes", "unique_lines", "line_length", "loud", "symbol_runs", "single_letters", "angle", "top_byte"]
_PUNCT, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL[[*b"!#$%&*@^~=+_"]] = True


def statistics(text: str | None) -> list[float]:
    """The document statistics, over the whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    codes = np.frombuffer(raw, np.uint8)
    hist = np.bincount(codes, minlength=256)
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    symbol = _SYMBOL[codes]
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum()))
    return [
        np.log1p(n), np.log1p(len(words)), (n - int(hist[32] + hist[10])) / w, len(counts) / w, max(counts.values(), default=0) / w, repeats / w,
        hist[65:91].sum() / letters, hist[48:58].sum() / n, hist[_PUNCT].sum() / n, hist[32] / n, hist[10] / n, hist[124] / n, hist[128:].sum() / n,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), hist[33] / n, int((symbol[1:] & symbol[:-1]).sum()) / n, sum(len(k) * v == v for k, v in counts.items()) / w, (hist[60] + hist[62]) / n, hist.max() / n,
    ]


class Forest:
    """Trees of one depth as flat arrays: node i of a tree has children 2i+1 and 2i+2."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature = np.zeros((0, 2**depth - 1), np.int32)
        self.threshold = np.zeros((0, 2**depth - 1))
        self.leaf = np.zeros((0, 2**depth))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        raw = np.full(len(x), self.base)
        if len(self.leaf):
            tree = np.arange(len(self.leaf))[None, :]
            for lo in range(0, len(x), 2048):
                part = x[lo : lo + 2048]
                row, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.leaf)), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
                raw[lo : lo + 2048] += self.leaf[tree, node - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-raw))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 10) -> Forest:
    """Newton boosting of the logistic loss on binned features."""
    mean = float(y.mean()) if len(y) else 0.5
    if not 0 < mean < 1 or not len(y):
        out = Forest(np.log((mean + 1e-3) / (1 - mean + 1e-3)), depth)
        return out
    out = Forest(np.log(mean / (1 - mean)), depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    raw = np.full(len(y), out.base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best, cut = np.full(width, 1e-6), np.full((width, 2), -1)
            for j, e in enumerate(edges):
                m = len(e) + 1
                if m < 2:
                    continue
                at = node * m + binned[:, j]
                hg, hh, hn = (np.bincount(at, v, width * m).reshape(width, m).cumsum(1) for v in (g, h, np.ones(len(y))))
                tg, th, tn = hg[:, -1:], hh[:, -1:], hn[:, -1:]
                gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
                gain[(hn < least) | (tn - hn < least)] = -1
                k = gain[:, :-1].argmax(1)
                got = gain[np.arange(width), k]
                better = got > best
                best[better], cut[better] = got[better], np.stack([np.full(width, j), k], 1)[better]
            for i in np.flatnonzero(cut[:, 0] >= 0):
                feature[first + i], threshold[first + i] = cut[i, 0], edges[cut[i, 0]][cut[i, 1]]
            node = 2 * node + (x[np.arange(len(y)), feature[first + node]] > threshold[first + node])
        value = rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + l2)
        raw += value[node]
        features.append(feature), thresholds.append(threshold), leaves.append(value)
    out.feature, out.threshold, out.leaf = np.array(features), np.array(thresholds), np.array(leaves)
    return out


def with_held_out(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds held_out: crc32 of the id as text, modulo 3, is 1."""
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_rows: int = 20000, **options) -> Forest:
    """A forest from at most `max_train_rows` labelled rows that are not held out."""
    text_batches(docs.sparkSession)
    known = with_held_out(labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y")), id_col).filter("not held_out")
    chosen = hashed_share(known, [id_col], max_train_rows).select(id_col, "_y")

    def run(batches):
        for b in batches:
            x = pa.array([statistics(t) for t in b.column("_t").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("_y"), b.column("_h"), x], ["y", "h", "x"])

    # at most max_train_rows ids are broadcast; where ids repeat in docs, a share of their rows keeps the bound
    text = F.col(text_col).alias("_t")
    joined = docs.select(F.col(id_col).alias("_i"), text).join(F.broadcast(chosen.withColumnRenamed(id_col, "_i")), "_i").select("_y", F.xxhash64("_i", "_t").alias("_h"), "_t")
    sample = hashed_share(joined, ["_h"], max_train_rows)
    got = sample.mapInArrow(trimmed(run), "y int, h long, x array<double>").toPandas().sort_values(["h", "y"], kind="stable")
    if got.empty:
        return fit_forest(np.zeros((0, len(NAMES))), np.zeros(0), **options)
    return fit_forest(np.array(got["x"].tolist()), got["y"].to_numpy(float), **options)


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """The columns `keep` (default: the id), and the score; every whole text is read."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(forest)  # a few kB whatever the corpus
    keep = keep or [id_col]
    kept = docs.select(*[quoted(c) for c in keep])
    refuse_clash(kept, [score_col])
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("row"), F.col(quoted(text_col)).alias("text"))  # one column, whatever names there are

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            s = held.value.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["row", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(trimmed(run), schema).select("row.*", F.col("score").alias(score_col))


def op10_quality(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return with_held_out(scored).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
