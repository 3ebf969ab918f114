"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.llm import common

#: Byte classes counted per line.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-?", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~", b" \t\r\f\v")
_CLASS_OF = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(CLASSES, 1):
    _CLASS_OF[list(_bytes)] = _k
OWN = len(CLASSES) + 6
#: Shares of good documents' lines that are bad, and of bad documents' lines that are good; bytes of the longest text to train on.
STRAY, LONGEST = (0.05, 0.2), 65_536


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, 3 * OWN + 3), weights (lines,) and lines per text, over all lines that have words.

    A line's own features are shares of byte classes, its length, its words' lengths and repeats;
    to them come those of the line before and after within the text (zeros at its ends), whether there is one, and a
    constant.
    """
    own, weights, counts = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        seen: set[bytes] = set()
        lines, words_in = [], []
        for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
            if words := line.split():
                lines.append(line)
                distinct = len(set(words))
                again = sum(map(operator.eq, words, words[1:]))
                words_in.append((len(words), distinct, again, line in seen, line.rstrip()[-1:] in b".!?"))
                seen.add(line)
        if not lines:
            continue
        counts[i] = len(lines)
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        classes = _CLASS_OF[np.frombuffer(b"".join(lines), np.uint8)]
        shares = [np.add.reduceat(classes == k, starts, dtype=np.int64) / size for k in range(1, len(CLASSES) + 1)]
        n, distinct, again, repeated, ended = np.array(words_in, np.float64).T
        own.append(np.column_stack([*shares, np.log1p(size) / 8, np.minimum(size / n, 40) / 10, distinct / n * np.minimum(1, np.log1p(n) / 5), again / n, repeated, ended]))
        weights.append(size)
    total = int(counts.sum())
    x = np.zeros((total, 3 * OWN + 3))
    if total:
        mine = np.concatenate(own)
        x[:, :OWN] = mine
        first = np.zeros(total, bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        before, after = np.flatnonzero(~first), np.flatnonzero(~first) - 1
        x[before, OWN : 2 * OWN], x[before, 3 * OWN] = mine[before - 1], 1
        x[after, 2 * OWN : 3 * OWN], x[after, 3 * OWN + 1] = mine[after + 1], 1
        x[:, -1] = 1
    return x, np.concatenate(weights).astype(np.float64) if total else np.zeros(0), counts


def forward_backward(emission: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (lines, 2), log partition per sequence and summed pair marginals (2, 2), all sequences at once.

    emission: log potentials (lines, 2), sequences one after the other, `counts` lines each (none empty).
    """
    order = np.argsort(-counts, kind="stable")
    starts, lens = (np.cumsum(counts) - counts)[order], counts[order]
    longest = int(lens[0]) if len(lens) else 0
    alive = np.searchsorted(-lens, -np.arange(longest), "left")  # sequences with more than t lines
    alpha, beta, pairs = emission.copy(), np.zeros_like(emission), np.zeros((2, 2))
    for t in range(1, longest):
        at = starts[: alive[t]] + t
        alpha[at] += np.logaddexp(alpha[at - 1, :1] + transition[0], alpha[at - 1, 1:] + transition[1])
    z = np.logaddexp(*alpha[starts + lens - 1].T)
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        later = beta[at + 1] + emission[at + 1]
        beta[at] = np.logaddexp(transition[:, 0] + later[:, :1], transition[:, 1] + later[:, 1:])
        pairs += np.exp(alpha[at][:, :, None] + transition + later[:, None, :] - z[: len(at), None, None]).sum(0)
    each = np.empty(len(counts))
    each[order] = z
    return np.exp(alpha + beta - np.repeat(each, counts)[:, None]), each, pairs


@dataclass
class LineField:
    """A trained field: feature scaling, weights of label 1 against label 0, transitions, calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line with words, its length in bytes, and lines per text."""
        x, size, counts = line_features(texts)
        if not len(x):
            return np.zeros(0), size, counts
        u = ((x - self.mean) / self.scale) @ self.weights
        marginal, _, _ = forward_backward(np.column_stack([np.zeros_like(u), u]), counts[counts > 0], self.transition)
        return np.clip(marginal[:, 1], 0.0, 1.0), size, counts

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of the lines' P(good) per text; NaN where a text has no words."""
        good, size, counts = self.lines(texts)
        text = np.repeat(np.arange(len(texts)), counts)
        total = np.bincount(text, size, len(texts))
        with np.errstate(invalid="ignore"):
            return np.bincount(text, size * good, len(texts)) / total

    def score(self, texts: list[str | None]) -> np.ndarray:
        raw = self.raw(texts)
        return np.where(np.isnan(raw), self.prior, 1 / (1 + np.exp(-(self.slope * _logit(raw) + self.shift))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p) - np.log1p(-p)


def spliced(texts: list[str | None], labels: list[int], most: int = 24, seed: int = 9) -> tuple[list[str], list[np.ndarray]]:
    """Documents made of runs of lines of a good and of a bad one, by turns, of up to `most` lines each, with the label of every line that has words.

    They show the field what the labels of whole documents don't: neighbours of different kinds, and lines that have to be told by themselves.
    """
    rng = np.random.default_rng(seed)
    lines = [[x for x in (t or "").split("\n") if x.encode("utf-8", "surrogatepass").split()][:most] for t in texts]
    good, bad = ([i for i, y in enumerate(labels) if y == k and lines[i]] for k in (1, 0))
    out, truth = [], []
    for i, j in zip(rng.permutation(good).tolist(), rng.permutation(bad).tolist(), strict=False):
        rest, made, kinds = {1: list(lines[i]), 0: list(lines[j])}, [], []
        k = int(rng.integers(2))
        while rest[0] or rest[1]:
            k = k if rest[k] else 1 - k
            n = int(rng.integers(1, 5))
            made += rest[k][:n]
            kinds += [k] * len(rest[k][:n])
            rest[k] = rest[k][n:]
            k = 1 - k
        out.append("\n".join(made))
        truth.append(np.array(kinds, np.float64))
    return out, truth


def train(texts: list[str | None], labels: list[int], steps: int = 80, rate: float = 0.15, decay: float = 1e-3) -> LineField:
    """Fits the field to labels of documents, then a logistic calibration of the documents' weighted marginals. One class only, or none
    (also where texts are null or empty): a constant prior. Repeated rows count each; a text may be in both classes.

    A line's own label is latent. It is seen through its document's label, which a good line of a bad document belies with
    probability STRAY[1] and a bad line of a good one with STRAY[0]. Adam follows the likelihood of what is seen: per line and pair of lines, the
    marginals given the document's label minus those of the field alone. Spliced documents are trained on alongside.
    """
    y = np.asarray(labels, np.float64)
    real, _, real_counts = line_features(texts)
    some = real_counts > 0
    prior = float((y.sum() + 1) / (len(y) + 2))
    if not len(real) or len(set(y[some])) < 2:
        return LineField(np.zeros(3 * OWN + 3), np.ones(3 * OWN + 3), np.zeros(3 * OWN + 3), np.zeros((2, 2)), 0.0, float(_logit(np.array(prior))), prior)
    mean, scale = real.mean(0), real.std(0)
    mean[-1], scale[-1] = 0, 1
    scale[scale < 1e-9] = 1
    made, kinds = spliced(texts, labels)
    extra, _, extra_counts = line_features(made)
    x = (np.concatenate([real, extra]) - mean) / scale
    seen = np.concatenate([np.repeat(y, real_counts), *kinds])
    n = np.concatenate([real_counts[some], extra_counts])
    told = np.where(seen[:, None] == 1, np.log([STRAY[0], 1 - STRAY[1]]), np.log([1 - STRAY[0], STRAY[1]]))
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        emission = np.column_stack([np.zeros(len(x)), x @ w])
        free, _, free_pairs = forward_backward(emission, n, trans)
        held, _, held_pairs = forward_backward(emission + told, n, trans)
        g = np.concatenate([x.T @ (free[:, 1] - held[:, 1]), (free_pairs - held_pairs).ravel()]) / len(x)
        g += decay * np.concatenate([w, trans.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, trans = w - move[:-4], trans - move[-4:].reshape(2, 2)
    field = LineField(mean, scale, w, trans, prior=prior)
    raw, y = _logit(field.raw(texts)[some]), y[some]
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps of a ridge-regularised logistic fit
        p = 1 / (1 + np.exp(-(a * raw + b)))
        s = p * (1 - p) + 1e-6
        h = np.array([[(s * raw * raw).sum() + 1e-2, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-2]])
        d = np.linalg.solve(h, [((p - y) * raw).sum() + 1e-2 * (a - 1), (p - y).sum()])
        a, b = a - d[0], b - d[1]
    field.slope, field.shift = float(max(a, 0.05)), float(b)
    return field


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, hidden: int, modulus: int = 5) -> DataFrame:
    """At most `rows` labelled documents (text, label) of LONGEST bytes at most outside the held-out part, a fixed pseudo-random choice of
    them: that is the bound in rows and bytes of what the driver reads.

    Labels that are null or contradict each other for an id are left out, and so are null ids; a repeated id counts once per row. Ties
    of the hash fall to id and text. Null and empty texts may be chosen. Without labelled documents there are no rows. Other columns don't matter.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("label"))
    known = known.where("low = label").select("doc_id", "label").where(common.remainder(F.col("doc_id"), modulus) != hidden)
    # Ids are chosen first, so texts are read for the chosen ones only.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    return short.join(F.broadcast(chosen), "doc_id").select("text", "label").orderBy(F.xxhash64("text"), "text", "label").limit(rows)


def _scored(batches: Iterator[pa.RecordBatch], field: LineField, text: str, out: str) -> Iterator[pa.RecordBatch]:
    for batch in common.small_batches(batches, text):
        yield common.with_columns(batch, **{out: pa.array(field.score(batch.column(text).to_pylist()))})


def with_quality(docs: DataFrame, field: LineField, text: str = "text", out: str = "quality_score") -> DataFrame:
    """`docs` with its quality (0 to 1) in column `out`, replacing a column of that name. Texts that are null, empty or
    all white space get the training rows' share of good ones. Other columns and repeated rows pass through; an empty table stays empty."""
    return common.mapped(docs.drop(out), partial(_scored, field=field, out=out), text, T.StructField(out, T.DoubleType()))


def _line_rows(batches: Iterator[pa.RecordBatch], field: LineField, doc_id: str, text: str) -> Iterator[pa.RecordBatch]:
    for batch in common.small_batches(batches, text):
        good, size, counts = field.lines(batch.column(text).to_pylist())
        which = np.repeat(np.arange(batch.num_rows), counts)
        line = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield pa.RecordBatch.from_arrays([batch.column(doc_id).take(pa.array(which)), pa.array(line), pa.array(size.astype(np.int64)), pa.array(good)], names=["id", "line", "bytes", "good"])


def line_marginals(docs: DataFrame, field: LineField, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line that has words: id, line (from 0 among these), bytes, good (the field's P(good))."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("line", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("good", T.DoubleType())])
    return docs.select(doc_id, text).mapInArrow(partial(_line_rows, field=field, doc_id=doc_id, text=text), schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, hidden: int = 0) -> LineField:
    """A field trained on at most `rows` labelled documents (the bounded sample, see training_rows) whose id is not held out.
    Empty tables, or labels of one kind only, give a constant score."""
    sample = training_rows(docs, labels, rows, hidden).toPandas()
    return train(sample["text"].tolist(), sample["label"].tolist())


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = F.col("quality_score")
    return with_quality(docs, field).select(
        "doc_id", (common.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted")
    )
