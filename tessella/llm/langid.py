"""Language identification by a byte convolutional network trained in numpy.

One-hot bytes go through filters of widths 2, 3 and 4, rectified and pooled by their maximum over a fixed-length window; a softmax
layer reads the pooled values. A text is the mean of its windows' logits, weighted by their bytes.

Training reads a bounded sample of labelled rows: `per_language` documents of each language, those whose ids hash lowest, and `spots`
windows of each. Prediction reads every byte of every text, and so does the limit of certainty of every labelled text it is given. Nulls: a null text, or one without a letter, is `und` with score 0; rows
with a null language or text aren't learned from. Without anything to learn from every text is `und`. Repeated rows give a row each;
an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

UNKNOWN = "und"
#: What can be told of each text.
TOLD = {"lang_pred": "string", "score": "double", "certainty": "double"}
WIDTHS = (2, 3, 4)


@dataclass
class Network:
    """languages; tables[w][o]: (256, filters) weights of width WIDTHS[w] at offset o; bias, dense, last as named by their use."""

    languages: list[str]
    tables: list[list[np.ndarray]]
    bias: np.ndarray
    dense: np.ndarray
    last: np.ndarray
    window: int

    def pairs(self) -> tuple:
        """Sums of two neighbouring offsets' weights by byte pair: each filter then takes one or two look-ups a place."""
        both = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        t = self.tables
        return both(*t[0]), (both(t[1][0], t[1][1]), t[1][2]), (both(t[2][0], t[2][1]), both(t[2][2], t[2][3]))

    def pooled(self, x: np.ndarray, pairs: tuple) -> np.ndarray:
        """(windows, features) of (windows, length) bytes; a byte of 0 pads."""
        two = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        a, (b, c), (d, e) = pairs
        third = b[two[:, :-1]]
        third += c[x[:, 2:]]
        fourth = d[two[:, :-2]]
        fourth += e[two[:, 2:]]
        top = np.concatenate([a[two].max(axis=1), third.max(axis=1), fourth.max(axis=1)], axis=1)
        return np.maximum(top + self.bias, 0)

    def logits(self, x: np.ndarray, pairs: tuple, step: int = 64) -> np.ndarray:
        out = [self.pooled(x[i : i + step], pairs) @ self.dense + self.last for i in range(0, len(x), step)]
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, one after another, the last of each padded with 0; the number of windows of each text."""
    n = np.array([-(-len(t) // length) for t in texts], np.int64)
    padded = b"".join(t + b"\0" * (-len(t) % length) for t in texts)
    return np.frombuffer(padded, np.uint8).reshape(-1, length), n


def trained(rows: list[tuple[bytes, str]], window: int, filters: int = 8, epochs: int = 12, seed: int = 7) -> Network | None:
    """Adam on cross-entropy; the gradient of a pooled maximum goes to the place that holds it."""
    languages = sorted({lang for _, lang in rows})
    if not rows:
        return None
    rng, f, classes = np.random.default_rng(seed), filters, len(languages)
    x, _ = windows([t[:window].ljust(window, b"\0") for t, _ in rows], window)
    y = np.array([languages.index(lang) for _, lang in rows])
    net = Network(languages, [[rng.normal(0, 0.3, (256, f)).astype(np.float32) for _ in range(w)] for w in WIDTHS], np.zeros(f * len(WIDTHS), np.float32), rng.normal(0, 0.2, (f * len(WIDTHS), classes)).astype(np.float32), np.zeros(classes, np.float32), window)
    flat = [t for ts in net.tables for t in ts] + [net.bias, net.dense, net.last]
    mean, square, step = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            xb, yb = x[at], y[at]
            tops, places = [], []
            for w, ts in zip(WIDTHS, net.tables, strict=True):
                conv = sum(ts[o][xb[:, o : window - w + 1 + o]] for o in range(w))
                place = conv.argmax(axis=1)
                places.append(place)
                tops.append(np.take_along_axis(conv, place[:, None, :], 1)[:, 0])
            pre = np.concatenate(tops, axis=1) + net.bias
            hidden = np.maximum(pre, 0)
            out = hidden @ net.dense + net.last
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            back = (p @ net.dense.T) * (pre > 0)
            grads = []
            for k, (w, ts) in enumerate(zip(WIDTHS, net.tables, strict=True)):
                own = back[:, k * f : (k + 1) * f]
                for o in range(w):
                    g = np.zeros_like(ts[o])
                    np.add.at(g, (np.take_along_axis(xb, places[k] + o, 1), np.arange(f)[None, :]), own)
                    grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, m, v in zip(flat, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(q.dtype)
    return net


def sampled(labelled: DataFrame, per_language: int, spots: int, window: int) -> list[tuple[bytes, str]]:
    """At most per_language * spots windows of each language: of the documents whose ids hash lowest, those at evenly spread places."""
    salts = 64
    rank = F.row_number().over(Window.partitionBy("lang", F.pmod(F.col("h"), F.lit(salts))).orderBy("h", "pieces"))
    n = F.length("text")
    spot = lambda i: F.substring("text", (F.greatest(n - window, F.lit(0)) * (i / max(1, spots - 1))).cast("int") + 1, F.lit(window))
    cut = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("lang", F.xxhash64("doc_id").alias("h"), F.array_distinct(F.array(*map(spot, range(spots)))).alias("pieces"))
    few = cut.withColumn("rank", rank).where(F.col("rank") <= max(1, per_language // salts))
    rows = few.select("lang", "h", F.explode("pieces").alias("t")).orderBy("h", "t").collect()
    return [(r.t.encode(), r.lang) for r in rows]


def least_certainty(labelled: DataFrame, net: Network, share: float = 0.001, least_rows: int = 20) -> float:
    """The certainty below which a text is in none of the languages, from all whole windows of all labelled texts given, which should not be learned from.

    It is counted from 1 / languages, the least there is, to 1. The limit lies a tenth below that which all but `share` of the windows reach,
    an exact order statistic: windows are counted by certainty, then by range of it, and the driver sees the ranges and the values of one of
    them. It is 0, so that nothing is rejected, where nothing can be told: one language only, or too few windows.
    """
    floor = 1 / len(net.languages)
    if floor == 1:
        return 0.0
    known = labelled.where(F.col("lang").isin(net.languages) & (F.octet_length("text") >= net.window) & F.col("text").rlike("\\p{L}")).select("text")
    seen = known.mapInArrow(_certainties(net), "value float, n long").groupBy("value").agg(F.sum("n").alias("n"))
    counts = written(seen.withColumn("span", F.floor(F.col("value") * 65536)), "certainties")
    spans = counts.groupBy("span").agg(F.sum("n").alias("n")).orderBy("span").collect()
    total = sum(r.n for r in spans)
    if total < least_rows:
        return 0.0
    before, rank = 0, int(share * (total - 1))
    for r in spans:
        if before + r.n > rank:
            break
        before += r.n
    values = counts.where(F.col("span") == r.span).orderBy("value").collect()
    at = np.searchsorted(np.cumsum([v.n for v in values]), rank - before, "right")
    return float(floor + 0.9 * max(values[at].value - floor, 0.0))


def _certainties(net: Network):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for batch in slices(batches, "text", 1 << 20):
            data = [t.encode() for t in batch.column("text").to_pylist()]
            x, _ = windows([t[: len(t) // net.window * net.window] for t in data], net.window)
            values, n = np.unique(softmax(net.logits(x, pairs)).max(axis=1).astype(np.float32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["value", "n"])

    return run


def predicted(documents: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row."""
    return tagged(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), net).select("doc_id", "lang_pred", "score")


def tagged(documents: DataFrame, net: Network | None) -> DataFrame:
    """The same rows and columns with lang_pred and score after them."""
    return _told(documents, net, ("lang_pred", "score"))


def assessed(documents: DataFrame, net: Network | None) -> DataFrame:
    """tagged(), with certainty after score: how sure the windows of a text are of their languages, each of its own.

    It is the mean of their best probabilities by bytes, 0 where nothing can be told. A text of two learned languages has a low score, that
    of the language that the whole of it is likeliest in, but is certain.
    """
    return _told(documents, net, ("lang_pred", "score", "certainty"))


def _told(documents: DataFrame, net: Network | None, told: tuple[str, ...]) -> DataFrame:
    names = [c for c in documents.columns if c not in told]
    schema = documents.select(*names).schema
    for name in told:
        schema = schema.add(name, TOLD[name])
    return documents.select(*names).mapInArrow(_predictor(net, told), schema)


def _predictor(net: Network | None, told: tuple[str, ...]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs() if net else None
        for batch in slices(batches, "text", 1 << 20):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            lang, score, certainty = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if net and any(map(str.isalpha, t))]
            if known:
                data = [texts[i].encode() for i in known]
                x, n = windows(data, net.window)
                size, first, length = (x != 0).sum(axis=1, keepdims=True), np.cumsum(n) - n, np.array([len(d) for d in data])
                own = net.logits(x, pairs)
                p = softmax(np.add.reduceat(own * size, first) / length[:, None])
                sure = np.add.reduceat(softmax(own).max(axis=1) * size[:, 0], first) / length
                for i, best, s, c in zip(known, p.argmax(axis=1), p.max(axis=1), sure, strict=True):
                    lang[i], score[i], certainty[i] = net.languages[best], min(1.0, float(s)), min(1.0, float(c))
            found = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "certainty": pa.array(certainty)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(found[c] for c in told)], [*batch.schema.names, *told])

    return run
