"""A hidden Markov language model over words, trained by Baum-Welch across partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.llm import common

#: Latent states, word classes besides the end's, words of a training segment, tokens of a batch, tokens per group of counts.
STATES, CLASSES, SEGMENT, BATCH, CELL_TOKENS = 8, 8192, 512, 1_000_000, 4_000_000
_LOW = (1 << 48) - 1


END = CLASSES << 48


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens (each text's words, A-Z lower-cased, then the end) and tokens per text.

    A code has the word's class in its upper 16 bits and 48 bits of hash. A word of up to 5 bytes has the
    class of its hash, a longer one that of its last 4 bytes, so that rare and unseen words share what
    their endings tell.
    """
    words = common.Words(texts)
    h = words.hashes(lower=True)
    short = words.ends - words.starts <= 5
    kind = np.where(short, h, words.hashes(lower=True, tail=4)) % np.uint64(CLASSES)
    sizes = words.sizes + 1
    codes = np.full(int(sizes.sum()), END, np.uint64)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(sizes) - 1] = False
    codes[inside] = kind << np.uint64(48) | h >> np.uint64(16)
    return codes, sizes


# --- counts -------------------------------------------------------------------------------------


def _cell(codes: np.ndarray, cells: int) -> np.ndarray:
    return ((codes & np.uint64(_LOW)) % np.uint64(cells)).astype(np.int64)


def _coded_blocks(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole texts as numbers: the other columns, tokens per text, distinct codes, each token's place among them, and
    the counts of codes in training texts."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in common.small_batches(batches, "text", budget):
        for at in range(0, batch.num_rows, 5000):
            part = batch.slice(at, 5000)
            codes, sizes = coded(part.column("text"))
            train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), sizes)
            ids, known = pd.factorize(codes)
            counts = np.bincount(ids, train, len(known))
            rows = common.packed(part.drop_columns(["text"]))
            arrays = [sizes.astype("<i4"), known, ids.astype("<i4"), counts.astype("<i4")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + n]), pa.array([len(codes)]), pa.array([rows], pa.binary()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]],
                names=["blk", "tokens", "payload", "sizes", "codes", "ids", "counts"],
            )
            n += 1


def _block_counts(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Distinct codes of each block with their counts, dealt to cells."""
    for batch in batches:
        for i, blk in enumerate(batch.column("blk").to_pylist()):
            known, counts = _array(batch, "codes", i, np.uint64), _array(batch, "counts", i, "<i4")
            cell = _cell(known, cells)
            order = np.argsort(cell, kind="stable")
            edges = np.flatnonzero(np.diff(cell[order])) + 1
            parts = [p for p in np.split(order, edges) if len(p)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(cell[p[0]]) for p in parts], pa.int32()), pa.array([blk] * len(parts), pa.int64()),
                 pa.array([known[p].tobytes() for p in parts], pa.binary()), pa.array([counts[p].tobytes() for p in parts], pa.binary())],
                names=["cell", "blk", "codes", "counts"],
            )


def _array(batch: pa.RecordBatch, column: str, row: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), kind)


def _totals(table: pa.Table) -> pa.Table:
    """Of a cell: per block the total count of each of its codes, in order, and what the classes sum to."""
    raw = table.column("codes").to_pylist()
    codes = np.frombuffer(b"".join(raw), np.uint64)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i4")
    at, known = pd.factorize(codes)
    total = np.bincount(at, counts, len(known)).astype("<i8")
    back = np.split(total[at], np.cumsum([len(r) // 8 for r in raw])[:-1])
    kind = (known[total > 0] >> np.uint64(48)).astype(np.int64)
    words, tokens = np.bincount(kind, minlength=CLASSES + 1), np.bincount(kind, total[total > 0], CLASSES + 1)
    some = np.flatnonzero(words)
    n = len(raw)
    none = [None] * n
    return pa.table({
        "blk": pa.array(table.column("blk").to_pylist() + [None] * len(some), pa.int64()),
        "cell": pa.array(table.column("cell").to_pylist() + [None] * len(some), pa.int32()),
        "totals": pa.array([b.tobytes() for b in back] + [None] * len(some), pa.binary()),
        "kind": pa.array(none + some.tolist(), pa.int32()), "words": pa.array(none + words[some].tolist(), pa.int64()),
        "tokens": pa.array(none + tokens[some].astype(np.int64).tolist(), pa.int64()),
    })


# --- the model ----------------------------------------------------------------------------------


@dataclass
class HiddenMarkov:
    """start (K,), transition (K, K), emission (K, CLASSES + 1) of word classes."""

    start: np.ndarray
    transition: np.ndarray
    emission: np.ndarray

    @staticmethod
    def first(kinds: np.ndarray, states: int = STATES, seed: int = 3) -> HiddenMarkov:
        """States that tend to stay, each with the classes' shares perturbed by a seeded noise."""
        rng = np.random.default_rng(seed)
        emission = kinds * np.exp(rng.normal(0, 0.5, (states, len(kinds))))
        transition = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(transition, 0.95)
        return HiddenMarkov(np.full(states, 1 / states), transition, emission / emission.sum(1, keepdims=True))

    def share(self) -> np.ndarray:
        """How often each state is taken in the long run."""
        p = np.full(len(self.start), 1 / len(self.start))
        for _ in range(50):
            p = p @ self.transition
        return p / p.sum()

    def log10_likelihood(self, kinds: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """log10 of each sequence's likelihood by the scaled forward recursion, over its whole length;
        emissions of a class are multiplied by its `weight`."""
        table = self.emission * weight
        order, alive = _layout(sizes)
        kinds = _by_time(kinds, sizes, order, alive)
        move, log = np.ascontiguousarray(self.transition.T), np.zeros(len(sizes))
        alpha, at = np.repeat(self.start[:, None], len(sizes), 1), 0
        for t, n in enumerate(alive.tolist()):
            alpha = (move @ alpha[:, :n] if t else alpha) * table.take(kinds[at : at + n], axis=1)
            scale = alpha.sum(0)
            alpha /= scale
            log[:n] += np.log10(scale)
            at += n
        out = np.empty(len(sizes))
        out[order] = log
        return out


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences by falling length, and how many have more than t tokens."""
    order = np.argsort(-sizes, kind="stable")
    lens = sizes[order]
    return order, np.searchsorted(-lens, -np.arange(int(lens[0]) if len(lens) else 0), "left")


def _by_time(tokens: np.ndarray, sizes: np.ndarray, order: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The first tokens of all sequences, then the second ones, and so on, each in the order of `order`."""
    starts = (np.cumsum(sizes) - sizes)[order]
    return tokens[np.concatenate([starts[:n] + t for t, n in enumerate(alive.tolist())])] if len(alive) else tokens[:0]


def expected_counts(model: HiddenMarkov, kinds: np.ndarray, sizes: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Baum-Welch counts of one batch of sequences: (CLASSES + 1 + K + 1, K), the rows being emissions by class,
    transitions by state left, and starts.

    Sequences that are not `first` of their text begin in any state, by the states' shares in the long run, and add nothing to starts. Arrays hold states by tokens, tokens by time, so that each step works on slices.
    """
    k = len(model.start)
    move = model.transition.astype(np.float32)
    back = np.ascontiguousarray(move.T)
    order, alive = _layout(sizes)
    kinds = _by_time(kinds, sizes, order, alive)
    first = np.ones(len(sizes), bool) if first is None else first[order]
    begun = np.where(first, model.start[:, None], model.share()[:, None]).astype(np.float32)
    ends = np.cumsum(alive)
    emitted = model.emission.astype(np.float32).take(kinds, axis=1)
    alpha = np.empty_like(emitted)
    for t, (n, end) in enumerate(zip(alive.tolist(), ends.tolist(), strict=True)):
        a = back @ alpha[:, begin : begin + n] if t else begun.copy()
        a *= emitted[:, end - n : end]
        a /= a.sum(0)
        begin = end - n
        alpha[:, begin:end] = a
    beta, moves = np.ones((k, alive[0]), np.float32), np.zeros((k, k))  # beta: scaled, at the place each sequence has come to
    for t in range(len(alive) - 1, 0, -1):
        n, end = alive[t], ends[t]
        begin, before = end - n, ends[t - 1] - alive[t - 1]
        later = beta[:, :n] * emitted[:, begin:end]
        a, b = alpha[:, before : before + n], move @ later
        moves += (a / (a * b).sum(0)) @ later.T
        alpha[:, begin:end] *= beta[:, :n]
        beta[:, :n] = b / b.sum(0)
    alpha[:, : alive[0]] *= beta
    alpha /= alpha.sum(0)
    counts = np.zeros((CLASSES + 1 + k + 1, k))
    for s in range(k):
        counts[: CLASSES + 1, s] = np.bincount(kinds, alpha[s], CLASSES + 1)
    counts[CLASSES + 1 : -1] = moves * model.transition
    counts[-1] = alpha[:, : alive[0]][:, first].sum(1)
    return counts


def maximised(counts: np.ndarray, kinds: np.ndarray, prior: float = 20.0) -> HiddenMarkov:
    """The model of aggregated counts; `prior` tokens of each state follow the classes' shares."""
    emission = counts[: CLASSES + 1].T + prior * kinds
    transition = counts[CLASSES + 1 : -1] + 0.1
    start = counts[-1] + 0.1
    return HiddenMarkov(start / start.sum(), transition / transition.sum(1, keepdims=True), emission / emission.sum(1, keepdims=True))


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of the training texts of each block, cut into segments."""
    for batch in batches:
        for i in range(batch.num_rows):
            held = common.unpacked(batch.column("payload")[i].as_buffer()).column("held_out").to_numpy(zero_copy_only=False)
            sizes = _array(batch, "sizes", i, "<i4").astype(np.int64)
            kinds = (_array(batch, "codes", i, np.uint64) >> np.uint64(48)).astype("<u2")[_array(batch, "ids", i, "<i4")]
            kinds, sizes = kinds[np.repeat(~held, sizes)], sizes[~held]
            parts = -(-sizes // SEGMENT)
            cut = np.full(int(parts.sum()), SEGMENT)
            cut[np.cumsum(parts) - 1] = sizes - (parts - 1) * SEGMENT
            cut[np.cumsum(parts) - parts] *= -1  # a text's first segment
            if len(cut):
                yield pa.RecordBatch.from_arrays([pa.array([kinds.tobytes()], pa.binary()), pa.array([cut.astype("<i4").tobytes()], pa.binary())], names=["kinds", "sizes"])


def _expectation(batches: Iterator[pa.RecordBatch], model: HiddenMarkov) -> Iterator[pa.RecordBatch]:
    """Counts of a task's segments: one row per class or state."""
    total, kinds, sizes, held = None, [], [], 0
    k = len(model.start)

    def add():
        nonlocal total, kinds, sizes, held
        size = np.concatenate(sizes).astype(np.int64)
        found = expected_counts(model, np.concatenate(kinds).astype(np.int64), np.abs(size), size < 0)
        total = found if total is None else total + found
        kinds, sizes, held = [], [], 0

    for batch in batches:
        for a, b in zip(batch.column("kinds"), batch.column("sizes"), strict=True):
            kinds.append(np.frombuffer(a.as_buffer(), "<u2"))
            sizes.append(np.frombuffer(b.as_buffer(), "<i4"))
            held += len(kinds[-1])
            if held >= BATCH:
                add()
    if held:
        add()
    if total is not None:
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(total[some, s]) for s in range(k)]], names=["row", *[f"s{s}" for s in range(k)]])


def train(blocks: DataFrame, kinds: np.ndarray, states: int = STATES, rounds: int = 6) -> HiddenMarkov:
    """Baum-Welch over all training texts of `blocks`; kinds: share of each class in training tokens.

    Each round adds up the expected counts of all partitions, one row per class and task; the rows that
    reach the driver are the classes and states of the model, whatever the input's size. Texts
    are segments of SEGMENT words here, of which a text's first one alone tells how texts start; scoring runs over whole texts.
    """
    coded_ = common.stored(blocks.select("payload", "sizes", "codes", "ids").mapInArrow(_training, "kinds binary, sizes binary"), "classes", "zstd")
    model = HiddenMarkov.first(kinds, states)
    columns = [f"s{s}" for s in range(states)]
    for _ in range(rounds):
        found = coded_.mapInArrow(partial(_expectation, model=model), "row int, " + ", ".join(f"{c} double" for c in columns))
        rows = found.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        if not len(rows):
            break
        counts = np.zeros((CLASSES + 1 + states + 1, states))
        counts[rows["row"].to_numpy()] = rows[columns].to_numpy()
        model = maximised(counts, kinds)
    return model


# --- scoring ------------------------------------------------------------------------------------


def _scores(batches: Iterator[pa.RecordBatch], model: HiddenMarkov, weight: np.ndarray, tokens: int, types: int, cells: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Scores of all rows of the blocks, several blocks at a time so that the recursion runs over many texts at once."""
    scale = tokens + 0.5 * (types + 1)
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        sizes = np.concatenate([h[2] for h in held])
        gain = model.log10_likelihood(np.concatenate([h[1] for h in held]), sizes, weight)
        at = 0
        for rows, _, n, known, base in held:
            mine = gain[at : at + len(n)]
            at += len(n)
            rows = rows.select(keep)
            yield common.with_columns(
                rows, n_tokens=pa.array(n), n_known=pa.array(known), train_tokens=pa.array(np.full(len(n), tokens, np.int64)),
                base_score=pa.array(base), score=pa.array(base + mine),
            )
        held.clear()

    for batch in batches:
        for i in range(batch.num_rows):
            rows = common.unpacked(batch.column("payload")[i].as_buffer())
            sizes, distinct, at = _array(batch, "sizes", i, "<i4").astype(np.int64), _array(batch, "codes", i, np.uint64), _array(batch, "ids", i, "<i4")
            order = np.argsort(_cell(distinct, cells), kind="stable")
            count = np.empty(len(distinct))
            parts = sorted(batch.column("totals")[i].as_py(), key=lambda p: p["cell"])
            count[order] = np.frombuffer(b"".join(p["totals"] for p in parts), "<i8")
            text = np.repeat(np.arange(len(sizes)), sizes)
            base = np.bincount(text, np.log10((count + 0.5) / scale)[at], len(sizes))
            known = np.bincount(text, (count > 0)[at], len(sizes)).astype(np.int64)
            held.append((rows, (distinct >> np.uint64(48)).astype(np.int64)[at], sizes, known, base))
            if sum(len(h[1]) for h in held) >= 3 * BATCH:
                yield from flush()
    if held:
        yield from flush()


def scored(docs: DataFrame, held_out: str = "held_out", text: str = "text", states: int = STATES, rounds: int = 6) -> DataFrame:
    """`docs` without its text, with n_tokens, n_known, train_tokens, base_score and score, learned from the rows where `held_out` is false.

    score is log10 P(tokens) under the hidden Markov model whose states emit a class of words and, of that class, a
    word by its smoothed count: P(w | state) = P(class | state) * (c(w) + 0.5) / (class tokens + 0.5 * (class types + 1)),
    one type per class standing for unseen words. With the base's per-word terms taken out, the recursion only
    needs classes: score = base_score + log10 of the forward likelihood with weighted classes.
    Counts of words are taken by hash over all training texts: each block sends its distinct words to groups by hash
    range and gets their totals back, so a frequent word is one entry per block.
    Null texts are empty: their one token is the end. A null in `held_out` counts as true, so that nothing is learned from that row. Repeated rows are scored each. Other
    columns pass through, whatever their names and types, but those named as one of the new columns in any case of letters, which are replaced. Without
    training texts all words are unseen. An empty table stays empty.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in docs.columns if c.lower() not in new and c != text]
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[common.column(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(common.column(held_out), F.lit(True)).alias("held_out"), common.column(text).alias("text"))
    coded_rows = rows.mapInArrow(partial(_coded_blocks, budget=4_000_000), "blk long, tokens long, payload binary, sizes binary, codes binary, ids binary, counts binary")
    blocks = common.bucketed(coded_rows, "blk", "zstd", common.text_bytes(rows, "text"))
    cells = common.partitions_for(blocks.agg(F.sum("tokens")).first()[0] or 0, CELL_TOKENS)
    counted = blocks.select("blk", "codes", "counts").mapInArrow(partial(_block_counts, cells=cells), "cell int, blk long, codes binary, counts binary")
    counted = counted.repartition(cells, "cell").groupBy("cell")
    totals = common.stored(counted.applyInArrow(_totals, "blk long, cell int, totals binary, kind int, words long, tokens long"), "totals", "zstd")
    kinds = totals.where("kind is not null").groupBy("kind").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).toPandas()
    words, tokens = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    words[kinds["kind"].to_numpy()], tokens[kinds["kind"].to_numpy()] = kinds["words"].to_numpy(), kinds["tokens"].to_numpy()
    share = (tokens + 0.5) / (tokens + 0.5).sum()
    model = train(blocks, share, states, rounds)
    n, types = int(tokens.sum()), int(words.sum())
    weight = (n + 0.5 * (types + 1)) / (tokens + 0.5 * (words + 1))
    back = totals.where("blk is not null").groupBy("blk").agg(F.collect_list(F.struct("cell", "totals")).alias("totals"))
    met = blocks.select("blk", "payload", "sizes", "codes", "ids").join(back, "blk").drop("blk")
    kind = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    schema = T.StructType([*[rows.schema[c] for c in names], *[T.StructField(c, kind[c]) for c in new]])
    out = met.mapInArrow(partial(_scores, model=model, weight=weight, tokens=n, types=types, cells=cells, keep=names), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *new)


def op4_hmm(spark, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs.select("doc_id", (common.remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "text"))
