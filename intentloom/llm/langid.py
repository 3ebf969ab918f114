"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.llm import common

#: Length of a window in bytes; shorter texts are padded with zero bytes.
WINDOW = 256
#: Filter widths in bytes, and filters of each width.
WIDTHS, FILTERS = (2, 3, 4), 8
#: Fewest training steps.
STEPS = 250
_LETTER = re.compile(r"[^\W\d_]")


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a whole text (n, WINDOW), end to end, and the bytes of text in each."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    used = np.full(n, WINDOW)
    used[-1] = len(raw) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), used


@dataclass
class ByteNet:
    """Filters per width as byte tables (width, 256, FILTERS), their biases, and the softmax layer."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def prepare(self) -> list[tuple[np.ndarray, ...]]:
        """Tables over byte pairs, so that a filter of 4 bytes takes two look-ups."""
        pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32))
        out = []
        for t in self.tables:
            out.append(tuple(pair(t[k], t[k + 1]) if k + 1 < len(t) else np.ascontiguousarray(t[k].astype(np.float32)) for k in range(0, len(t), 2)))
        return out

    def pooled(self, w: np.ndarray, prepared: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Rectified maxima of all filters over each window."""
        index = w[:, :-1].astype(np.intp) * 256 + w[:, 1:]
        out = []
        for width, parts, bias in zip(WIDTHS, prepared, self.bias, strict=True):
            n = WINDOW - width + 1
            total = None
            for k, table in enumerate(parts):
                at = index[:, 2 * k : 2 * k + n] if len(table) == 65536 else w[:, 2 * k : 2 * k + n]
                got = table.take(at, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            out.append(np.maximum(total.max(1) + bias, 0))
        return np.concatenate(out, 1)

    def log_probabilities(self, w: np.ndarray, prepared: list[tuple[np.ndarray, ...]], chunk: int = 256) -> np.ndarray:
        out = [self.pooled(w[i : i + chunk], prepared) @ self.dense + self.dense_bias for i in range(0, len(w), chunk)]
        z = np.concatenate(out).astype(np.float64)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability per whole text: the softmax of the mean window log-probability,
        windows weighted by their bytes. `und` with 0 for a null text or one without a letter, or if no language was learned."""
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        if some:
            cut = [windows(texts[i]) for i in some]
            of = np.repeat(np.arange(len(some)), [len(c[0]) for c in cut])
            used = np.concatenate([c[1] for c in cut]).astype(np.float64)
            logp = self.log_probabilities(np.concatenate([c[0] for c in cut]), self.prepare_once())
            mean = np.stack([np.bincount(of, used * logp[:, k], len(some)) for k in range(len(self.langs))], 1) / np.bincount(of, used, len(some))[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for j, i in enumerate(some):
                langs[i], score[i] = self.langs[best[j]], p[j, best[j]]
        return langs, score

    def prepare_once(self):
        if not hasattr(self, "_prepared"):
            self._prepared = self.prepare()
        return self._prepared


def train(snippets: list[str], labels: list[str], epochs: int = 5, rate: float = 0.01, batch: int = 64, seed: int = 5) -> ByteNet:
    """Adam on the cross-entropy, for STEPS steps at least; each snippet is one window, half of them cut short so that short texts are learned too."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    k = max(1, len(langs))
    tables = [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS]
    bias = [np.zeros(FILTERS) for _ in WIDTHS]
    dense, dense_bias = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), k)), np.zeros(k)
    net = ByteNet(langs, tables, bias, dense, dense_bias)
    if len(langs) < 1:
        return net
    y = np.array([langs.index(x) for x in labels])
    x = np.zeros((len(snippets), WINDOW), np.uint8)
    for i, s in enumerate(snippets):
        raw = s.encode("utf-8", "surrogatepass")[:WINDOW]
        if rng.random() < 0.5:
            raw = raw[: max(8, int(rng.integers(1, WINDOW)))]
        x[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    params = [*tables, *bias, dense, dense_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(max(epochs, -(-STEPS * batch // len(x)))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            b, t = x[order[at : at + batch]], y[order[at : at + batch]]
            peaks, values = [], []
            for w, table, bi in zip(WIDTHS, tables, bias, strict=True):
                n = WINDOW - w + 1
                z = sum(table[j][b[:, j : j + n]] for j in range(w))
                peaks.append(z.argmax(1))
                values.append(np.take_along_axis(z, peaks[-1][:, None], 1)[:, 0] + bi)
            pre = np.concatenate(values, 1)
            h = np.maximum(pre, 0)
            z = h @ dense + dense_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(t)), t] -= 1
            p /= len(t)
            dh = (p @ dense.T) * (pre > 0)
            g_tables, g_bias = [], []
            for i, w in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                g = np.zeros((w, 256, FILTERS))
                for j in range(w):
                    byte = np.take_along_axis(b, peaks[i] + j, 1)
                    np.add.at(g[j], (byte, np.arange(FILTERS)[None]), d)
                g_tables.append(g)
                g_bias.append(d.sum(0))
            step += 1
            for q, g, mm, vv in zip(params, [*g_tables, *g_bias, h.T @ p + 1e-4 * dense, p.sum(0)], m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                q -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return net


def training_snippets(docs: DataFrame, per_lang: int, hidden: int = 2, modulus: int = 4) -> DataFrame:
    """At most `per_lang` windows of labelled texts per language, each from a pseudo-random place of its text.

    Only text and non-null lang of documents outside the held-out part are used. Of a frequent language only texts of small hash
    compete, some four times as many as are kept, so that what is ranked does not grow with the table; the choice per
    language is spread over 16 slices. Null texts and those without a letter are left out; repeated texts count each; ties of the hash fall to the snippet. An
    empty table gives no rows. Other columns don't matter.
    """
    h = F.xxhash64("text")
    known = docs.where(F.col("lang").isNotNull() & (common.remainder(F.col("doc_id"), modulus) != hidden))
    share = known.groupBy("lang").agg(F.count("*").alias("rows")).select(F.col("lang").alias("of"), (F.lit(4.0 * per_lang + 400) / F.col("rows")).alias("share"))
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - WINDOW // 2)) + 1
    cut = known.join(F.broadcast(share), F.col("lang") == F.col("of")).where(F.pmod(F.shiftright(h, 8), F.lit(1_000_003)) <= F.col("share") * 1_000_003)
    cut = cut.where(F.col("text").rlike(r"\p{L}")).select("lang", h.alias("h"), F.substring("text", place.cast("int"), F.lit(WINDOW)).alias("snippet"))
    slices = Window.partitionBy("lang", F.pmod("h", F.lit(16))).orderBy("h", "snippet")
    return cut.withColumn("n", F.row_number().over(slices)).where(F.col("n") <= per_lang // 16).select("lang", "h", "snippet")


def fit(docs: DataFrame, per_lang: int = 1200) -> ByteNet:
    """A network trained on at most `per_lang` windows of WINDOW characters per language (the bounded sample, see training_snippets).
    The languages are those of the sample; without any, all predictions are `und`."""
    rows = training_snippets(docs, per_lang).toPandas().sort_values(["lang", "h", "snippet"])
    return train(rows["snippet"].tolist(), rows["lang"].tolist())


def _predicted(batches: Iterator[pa.RecordBatch], net: ByteNet, text: str) -> Iterator[pa.RecordBatch]:
    for batch in common.small_batches(batches, text, 2_000_000):
        langs, score = net.predict(batch.column(text).to_pylist())
        yield common.with_columns(batch, lang_pred=pa.array(langs, pa.string()), lang_score=pa.array(score))


def with_language(docs: DataFrame, net: ByteNet, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and lang_score from the text alone, replacing columns of these names.

    Every window of every whole text is read. Null texts and texts without a letter are `und` with
    score 0. Other columns and repeated rows pass through; an empty table stays empty.
    """
    new = T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())
    return common.mapped(docs.drop("lang_pred", "lang_score"), partial(_predicted, net=net), text, *new)


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs.select("doc_id", "text", "lang"))
    return with_language(docs.select("doc_id", "text"), net).select(
        "doc_id", (common.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
