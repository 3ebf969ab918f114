"""Removal of repeated passages with automata of recurring phrases."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.llm import common

#: Words of a phrase, letters of a word, phrases in one automaton, words of the documents that share automata, bytes of text per cell of hashes.
PHRASE, LETTERS, SHARD, SHARED_WORDS, CELL_BYTES = 8, 3, 50_000, 2_000_000, 16_000_000
#: Odd multipliers of the two rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def rolling(codes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of `width` codes: equal runs have equal hashes wherever they stand."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.uint64)
    power, inverse = common.powers(_BASES[which], 1 << max(16, n.bit_length()))
    if which:
        codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(0xA24BAED4963EE407)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * power[:n], dtype=np.uint64)))
    return common.mixed((total[width:] - total[:-width]) * inverse[: n - width + 1])


def spelled(sixes: np.ndarray) -> str:
    """Words of LETTERS numbers as a string. A letter has 6 bits of a word's code and is of the alphabet of its place in the word, as
    the automata look through a node's children one by one; so a phrase stands for 144 bits and starts at whole words only."""
    return (sixes.reshape(-1, LETTERS).astype("<u4") + (0x100 + 64 * np.arange(LETTERS)).astype("<u4")).tobytes().decode("utf-32-le")


class Block:
    """The words of a block's documents in one row, with what is computed from them."""

    def __init__(self, payload: bytes, text: str, width: int):
        self.rows, self.width = common.unpacked(payload), width
        words = common.Words(self.rows.column(text))
        self.sizes, self.ends, self.codes = words.sizes, np.cumsum(words.sizes), words.hashes()

    def inside(self, width: int) -> np.ndarray:
        """Whether the run of `width` words from each place stays in its document."""
        n = len(self.codes) - width + 1
        if n <= 0:
            return np.zeros(0, bool)
        left = np.repeat(self.ends, self.sizes) - np.arange(len(self.codes))
        return left[:n] >= width

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the phrases at all places, whether each place counts (the phrase stays in its document, which holds a window), and whether it is picked.

        Picked are places of a grid: every width - PHRASE + 1 words from a document's start on, so that every window holds a picked phrase.
        """
        h = rolling(self.codes, PHRASE)
        counts = self.inside(PHRASE) & (np.repeat(self.sizes, self.sizes)[: len(h)] >= self.width)
        at = (np.arange(len(self.codes)) - np.repeat(self.ends - self.sizes, self.sizes))[: len(h)]
        return h, counts, counts & (at % (self.width - PHRASE + 1) == 0)

    def sixes(self) -> np.ndarray:
        """The words as LETTERS numbers of 6 bits each."""
        return np.stack([(self.codes >> np.uint64(58 - 6 * k)) & np.uint64(63) for k in range(LETTERS)], 1).astype(np.uint8)

    def letters(self) -> str:
        """The documents as a string for the automata, see spelled."""
        return spelled(self.sixes())

    def candidates(self, places: np.ndarray) -> np.ndarray:
        """Places of windows that hold one of the phrases that stand at `places`."""
        whole, span = self.inside(self.width), self.width - PHRASE + 1
        change = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(change, np.maximum(places - span + 1, 0), 1)
        np.add.at(change, places + 1, -1)
        return np.flatnonzero((np.cumsum(change)[: len(whole)] > 0) & whole)

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Whether each word lies in a window whose hash is among `repeated`."""
        change = np.zeros(len(self.codes) + 1, np.int64)
        if len(repeated):
            h, whole, known = rolling(self.codes, self.width), self.inside(self.width), np.sort(repeated)
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            at = np.flatnonzero(whole & (known[place] == h))
            np.add.at(change, at, 1)
            np.add.at(change, at + self.width, -1)
        return np.cumsum(change)[:-1] > 0


def shards(phrases: np.ndarray) -> Iterator[ahocorasick.Automaton]:
    """Automata of at most SHARD of the confirmed phrases each, as spelled (rows of PHRASE * LETTERS numbers)."""
    for begin in range(0, len(phrases), SHARD):
        automaton, some = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), phrases[begin : begin + SHARD]
        text, size = spelled(some), PHRASE * LETTERS
        for at in range(0, len(text), size):
            automaton.add_word(text[at : at + size])
        automaton.make_automaton()
        yield automaton


def occurrences(blocks: list[Block], phrases: np.ndarray) -> list[np.ndarray]:
    """Places, per block, where a confirmed phrase stands: all documents of the blocks streamed through every shard.

    Documents follow each other in a block's string; finds across an end are dropped.
    """
    found, strings = [[np.zeros(0, np.int64)] for _ in blocks], [b.letters() for b in blocks]
    for automaton in shards(phrases):
        for string, places in zip(strings, found, strict=True):
            places.append(np.fromiter((end for end, _ in automaton.iter(string)), np.int64) // LETTERS - PHRASE + 1)
    out = []
    for block, places in zip(blocks, found, strict=True):
        places = np.unique(np.concatenate(places))
        out.append(places[block.inside(PHRASE)[places]])
    return out


def _posted(blk: int, block: Block, cells: int) -> pa.RecordBatch:
    """A block's phrases, dealt by hash to cells: one row per cell that has some, with the distinct hashes (32 bits; the cell stands for more), which of them
    stand at two places, and the picked ones, as spelled."""
    h, counts, picked = block.phrases()
    hashes, times = np.unique(h[counts], return_counts=True)
    grid, at = np.unique(h[picked], return_index=True)
    at, sixes = np.flatnonzero(picked)[at], block.sixes()
    spelt = sixes[at[:, None] + np.arange(PHRASE)].reshape(len(at), PHRASE * LETTERS)
    cell, grid_cell = (((x >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64) for x in (hashes, grid))
    some, starts = np.unique(cell, return_index=True)
    ends, low, high = np.append(starts, len(cell))[1:], np.searchsorted(grid_cell, some), np.searchsorted(grid_cell, some, "right")
    short, grid = hashes.astype("<u4"), grid.astype("<u4")  # the low 32 bits
    cut = lambda x, begin, end: pa.array([x[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
    twice = pa.array([np.packbits(times[a:b] > 1).tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blk] * len(some), pa.int64()), cut(short, starts, ends), twice, cut(grid, low, high), cut(spelt, low, high)], names=_POSTED_NAMES)


_POSTED = "cell int, blk long, hashes binary, twice binary, picked binary, spelled binary"
_POSTED_NAMES = [f.split()[0] for f in _POSTED.split(", ")]


def _confirmed(table: pa.Table) -> pa.Table:
    """Of a cell's picked phrases those that stand at two places or more of all blocks, as spelled, for each block that has them anywhere."""
    column = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    hashes = column("hashes", "<u4")
    sizes = [len(x) for x in hashes]
    times = 1 + np.concatenate([np.unpackbits(t, count=n) for t, n in zip(column("twice", np.uint8), sizes, strict=True)]).astype(np.int8)
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    starts = np.concatenate(([0], np.flatnonzero(np.diff(every[order])) + 1))
    again = every[order][starts][np.add.reduceat(times[order].astype(np.int64), starts) > 1]
    picked, spelt = np.concatenate(column("picked", "<u4")), np.concatenate(column("spelled", np.uint8)).reshape(-1, PHRASE * LETTERS)
    keep = np.isin(picked, again)
    rows = np.unique(np.column_stack([picked[keep].astype(">u4").view(np.uint8).reshape(-1, 4), spelt[keep]]), axis=0)
    known = rows[:, :4].copy().view(">u4").ravel() if len(rows) else np.zeros(0, np.uint32)
    out = []
    for blk, own in zip(table.column("blk").to_pylist(), hashes, strict=True):
        low, high = np.searchsorted(known, own), np.searchsorted(known, own, "right")
        count = high - low
        if count.any():
            at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out.append((blk, rows[at, 4:].tobytes()))
    return pa.table({"blk": pa.array([r[0] for r in out], pa.int64()), "hashes": pa.array([r[1] for r in out], pa.binary())})


def _dealt(blk: int, hashes: np.ndarray, checks: np.ndarray, cells: int) -> pa.RecordBatch:
    """Distinct hashes of a block, dealt by hash to cells: one row per cell that has some, with how often each occurs (1 or more: 2)."""
    order = np.lexsort((checks, hashes))
    hashes, checks = hashes[order], checks[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
    starts = np.flatnonzero(new)
    twice = np.diff(np.append(starts, len(hashes))) > 1
    hashes, checks = hashes[starts], checks[starts]
    cell = ((hashes >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(cell)) + 1
    parts = list(zip(np.split(hashes, edges), np.split(checks, edges), np.split(twice, edges), strict=True)) if len(cell) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(cell[np.concatenate(([0], edges))] if parts else cell, pa.int32()), pa.array([blk] * len(parts), pa.int64()), pa.array([p[0].tobytes() for p in parts], pa.binary()),
         pa.array([p[1].tobytes() for p in parts], pa.binary()), pa.array([np.packbits(p[2]).tobytes() for p in parts], pa.binary())],
        names=["cell", "blk", "hashes", "checks", "twice"],
    )


_DEALT = "cell int, blk long, hashes binary, checks binary, twice binary"


def _phrase_hashes(batches: Iterator[pa.RecordBatch], text: str, width: int, cells: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blk, payload in zip(batch.column("blk").to_pylist(), batch.column("payload"), strict=True):
            yield _posted(blk, Block(payload.as_buffer(), text, width), cells)


def _window_hashes(batches: Iterator[pa.RecordBatch], text: str, width: int, cells: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, Block, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        blocks = [b for _, b, _ in held]
        places = occurrences(blocks, np.unique(np.concatenate([k for *_, k in held]), axis=0))
        for (blk, block, _), found in zip(held, places, strict=True):
            at = block.candidates(found)
            checks = (rolling(block.codes, width, 1)[at] >> np.uint64(32)).astype("<u4")
            yield _dealt(blk, rolling(block.codes, width)[at], checks, cells)
        held.clear()

    for batch in batches:
        for blk, payload, known in zip(batch.column("blk").to_pylist(), batch.column("payload"), batch.column("known"), strict=True):
            held.append((blk, Block(payload.as_buffer(), text, width), np.frombuffer(b"".join(known.as_py()), np.uint8).reshape(-1, PHRASE * LETTERS)))
            if sum(len(b.codes) for _, b, _ in held) >= SHARED_WORDS:
                yield from flush()
    if held:
        yield from flush()


def _joined(known: pa.Scalar) -> np.ndarray:
    return np.frombuffer(b"".join(known.as_py() or []), np.uint64)


def _recurring(table: pa.Table) -> pa.Table:
    """Of a cell's hashes those that occur twice or more, per block."""
    sizes = np.array([len(x) // 8 for x in table.column("hashes").to_pylist()])
    hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
    checks = np.frombuffer(b"".join(table.column("checks").to_pylist()), "<u4" if sum(map(len, table.column("checks").to_pylist())) == 4 * len(hashes) else np.uint8)
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(table.column("twice").to_pylist(), sizes, strict=True)]).astype(bool)
    order = np.lexsort((checks, hashes))
    same = (hashes[order][1:] == hashes[order][:-1]) & (checks[order][1:] == checks[order][:-1])
    again = np.zeros(len(hashes) + 1, bool)
    again[1:-1] |= same
    again[:-2] |= same
    keep = twice.copy()
    keep[order] |= again[:-1]
    cut = np.cumsum(sizes)[:-1]
    rows = [(b, h[k].tobytes()) for b, h, k in zip(table.column("blk").to_pylist(), np.split(hashes, cut), np.split(keep, cut), strict=True) if k.any()]
    return pa.table({"blk": pa.array([r[0] for r in rows], pa.int64()), "hashes": pa.array([r[1] for r in rows], pa.binary())})


def _back(dealt: DataFrame, cells: int, counted=_recurring) -> DataFrame:
    """What recurs of each block (blk, known), counted in a task per cell."""
    found = dealt.repartition(cells, "cell").groupBy("cell").applyInArrow(counted, "blk long, hashes binary")
    return found.groupBy("blk").agg(F.collect_list("hashes").alias("known"))


def _cleaned(batches: Iterator[pa.RecordBatch], text: str, width: int, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload, known in zip(batch.column("payload"), batch.column("known"), strict=True):
            block = Block(payload.as_buffer(), text, width)
            gone = np.split(block.covered(_joined(known)), block.ends[:-1])
            kept = []
            rows = block.rows
            for t, g in zip(rows.column(text).to_pylist(), gone, strict=True):
                words = common.words_of(t)
                kept.append(b" ".join(compress(words, (~g).tolist()) if g.any() else words))
            removed = np.array([int(g.sum()) for g in gone], np.int64)
            columns = pa.array(block.sizes), pa.array(removed), pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())
            yield common.with_columns(rows, **dict(zip(names, columns, strict=True)))


def without_repeats(docs: DataFrame, text: str = "text", width: int = 35, names: tuple[str, str, str] = ("n_words", "n_removed", "kept_text")) -> DataFrame:
    """`docs` with n_words, n_removed and kept_text, or three other `names`: every word covered by a window of `width` words
    that also starts anywhere else is removed, windows being judged on the input.

    1. Phrases of PHRASE words are picked on a grid, so that every window holds one, and those are confirmed that stand anywhere else, on the grid or not: the hashes of
    the phrases at all places are counted in cells. 2. Confirmed phrases are compiled into
    automata of SHARD phrases at most, and documents are streamed through them to locate every occurrence: all documents of a partition, SHARED_WORDS words at a time, through
    all shards of the phrases that these documents were counted to have (others cannot stand in them). Windows around a find are the only ones that can
    repeat, and their 96-bit hashes are counted in turn. 3. Each block marks the words of its repeated
    windows. Hashes travel as packed arrays, one row per block and range of hashes; an array holds a
    hash once per block, so a passage in a third of all documents adds one entry per block. Of texts only picked phrases travel.
    Null texts have no words; their kept_text is empty. Repeated rows repeat all their windows. Texts under
    `width` words lose nothing; kept words are joined by one space. Other columns pass through, those of
    the three names are replaced. An empty table stays empty.
    """
    if width < PHRASE:
        raise ValueError(f"a window holds {PHRASE} words at least")
    docs = docs.drop(*names)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # column names may have dots
    text = plain.columns[docs.columns.index(text)]
    blocks = common.blocks_of(plain, text)
    cells = common.partitions_for(blocks.agg(F.sum("bytes")).first()[0] or 0, CELL_BYTES)
    options = {"text": text, "width": width}
    phrases = blocks.select("blk", "payload").mapInArrow(partial(_phrase_hashes, cells=cells, **options), _POSTED)
    known = common.stored(_back(phrases, cells, _confirmed), "phrases")
    met = blocks.select("blk", "payload").join(known, "blk")
    windows = met.select("blk", "payload", "known").mapInArrow(partial(_window_hashes, cells=cells, **options), _DEALT)
    repeated = common.stored(_back(windows, cells), "windows")
    met = blocks.select("blk", "payload").join(repeated, "blk", "left")
    fields = [T.StructField(n, kind) for n, kind in zip(names, (T.LongType(), T.LongType(), T.StringType()), strict=True)]
    return met.select("payload", "known").mapInArrow(partial(_cleaned, names=names, **options), T.StructType([*plain.schema.fields, *fields])).toDF(*docs.columns, *names)


def op7_substring(spark, sf_dir: str) -> DataFrame:
    """All documents without the passages of 35 words and more that repeat."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
