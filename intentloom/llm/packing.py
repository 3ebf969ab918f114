"""Packing documents into token sequences by multiway number differencing."""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.llm import common

#: Tokens in a sequence, id that ends a document, longest piece of a document's rest, pieces in a group.
CAPACITY, END_ID, PIECE, GROUP = 4096, 2, 1024, 4096
#: Bytes of part ids that a worker holds; parts beyond are encoded in each batch that has them.
HELD_BYTES = 48_000_000
# What a tokenizer has to do with a text before its merges, for parts to have the ids they have in the text.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LETTER, _POINT, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_LETTER[97:123] = True
_POINT[33:127] = True
_POINT[65:91] = _POINT[97:123] = False
_LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _by_parts(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, drops white space and splits texts as `Parts` does."""
    made = json.loads(tokenizer.to_str())
    split = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    return (
        made["normalizer"] == _NORMALIZER and made["post_processor"] is None and made["model"]["type"] == "BPE" and made["model"]["end_of_word_suffix"] == "</w>"
        and [p.get("type") for p in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": _SPLIT} and split[0]["behavior"] == "Removed" and split[0]["invert"]
        and not split[1]["add_prefix_space"]
    )


class Parts(common.Words):
    """Parts of a text column whose ids, one after the other, are the texts': words, A-Z lower-cased, cut between a
    letter (a-z, U+00C0 to U+00FF) and an ASCII digit or point. Each is told by its hash, its first and last 8 bytes and its length,
    which for parts of up to 16 bytes is the part itself."""

    def __init__(self, column: pa.Array):
        super().__init__(column)
        size = self.ends - self.starts
        padded = np.pad(self.raw, 8)
        eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64))
        self.keys = (self.hashes(), eights[self.starts + 8] & mask, np.where(size < 8, np.uint64(0), eights[self.ends]), size)

    def split(self, begins: np.ndarray, ends: np.ndarray) -> None:
        self.raw = _LOWER[self.raw]
        letter = _LETTER[self.raw]
        letter[1:] |= (self.raw[:-1] == 0xC3) & (self.raw[1:] != 0x97) & (self.raw[1:] != 0xB7)  # all but the signs for times and division
        cut = letter[:-1] & _POINT[self.raw[1:]] & ~begins[1:]
        begins[1:] |= cut
        ends[:-1] |= cut

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        raw = self.raw.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]


class PartIds:
    """Token ids of texts, by way of the ids of their parts. Those of parts met are held in flat arrays in the order of their
    hashes, up to HELD_BYTES."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.by_parts = _by_parts(self.tokenizer)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.keys = (*[np.zeros(0, np.uint64)] * 3, np.zeros(0, np.int64))
        self.at, self.n, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts in one array, with the place and number of those of each part. Latin words of letters alone are one run of the
        tokenizer, whose last token is marked as its end; many such words are encoded as one text and cut at
        these marks. Others go one by one."""
        words, odd, flat = [], [], []
        at, n, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), 0
        for i, p in enumerate(parts):  # isalpha() of bytes knows a-z and A-Z only
            (words if p.isalpha() or (t := p.decode("utf-8", "surrogatepass")).isalpha() and max(t) < "\u0250" else odd).append(i)
        for i in range(0, len(words), 1000):
            these = words[i : i + 1000]
            ids = np.array(self.ids([b" ".join([parts[j] for j in these]).decode()])[0], "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(these) or ends[-1] != len(ids):
                odd += these
                continue
            n[these] = np.diff(ends, prepend=0)
            at[these] = ends - n[these] + size
            flat.append(ids)
            size += len(ids)
        for i in range(0, len(odd), 5000):
            these = odd[i : i + 5000]
            for j, ids in zip(these, self.ids([parts[j].decode("utf-8", "surrogatepass") for j in these]), strict=True):
                at[j], n[j] = size, len(ids)
                flat.append(np.array(ids, "<u4"))
                size += len(ids)
        return np.concatenate(flat) if flat else np.zeros(0, "<u4"), at, n

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text; nulls are empty texts. Texts that may hold a special token, and all if the tokenizer is of another kind, are encoded whole."""
        column = pc.fill_null(column, "")
        whole = pc.match_substring(column, "<|").to_numpy(zero_copy_only=False) if self.by_parts else np.ones(len(column), bool)
        parts = Parts(pc.if_else(pa.array(whole), "", column))
        code, _ = pd.factorize(parts.keys[0])
        first = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        keys = tuple(k[first] for k in parts.keys)
        if not all((k == own[code]).all() for k, own in zip(parts.keys, keys, strict=True)):  # two parts of one hash
            parts, whole, code = Parts(pa.array([""] * len(column))), np.ones(len(column), bool), code[:0]
            first, keys = first[:0], parts.keys
        place, known = self._held(keys)
        new, held = np.flatnonzero(~known), len(self.flat)
        fresh, at, n = self.encode(parts.bytes_of(first[new]))
        offset, tokens = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        offset[known], tokens[known] = self.at[place[known]], self.n[place[known]]
        offset[new], tokens[new] = at + held, n
        flat = np.concatenate([self.flat, fresh])
        self._hold(tuple(k[new] for k in keys), at + held, n, flat)
        tokens, offset = tokens[code], offset[code]
        ends = np.concatenate(([0], np.cumsum(tokens)))
        ids = flat[np.repeat(offset - ends[:-1], tokens) + np.arange(ends[-1])]
        out = np.split(ids, ends[np.cumsum(parts.sizes)[:-1]]) if len(column) else []
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.array(self.ids([column[i].as_py()])[0], "<u4")
        return out

    def _held(self, keys: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Places among the parts held, and whether the part there is the one asked for."""
        if not len(self.at):
            return np.zeros(len(keys[0]), np.int64), np.zeros(len(keys[0]), bool)
        place = np.minimum(np.searchsorted(self.keys[0], keys[0]), len(self.at) - 1)
        return place, np.logical_and.reduce([k[place] == own for k, own in zip(self.keys, keys, strict=True)])

    def _hold(self, keys: tuple, at: np.ndarray, n: np.ndarray, flat: np.ndarray) -> None:
        """Holds as many new parts as the bound allows. `flat` has the ids of those held and then of the new."""
        order = np.argsort(at, kind="stable")
        cost = 48 * (len(self.at) + np.arange(1, len(at) + 1)) + 4 * (at + n)[order]
        order = order[: int(np.searchsorted(cost, HELD_BYTES, "right"))]
        if not len(order):
            return
        self.flat = flat[: int((at + n)[order[-1]])]
        order = order[np.argsort(keys[0][order])]
        where = np.searchsorted(self.keys[0], keys[0][order])
        self.keys = tuple(np.insert(k, where, own[order]) for k, own in zip(self.keys, keys, strict=True))
        self.at, self.n = np.insert(self.at, where, at[order]), np.insert(self.n, where, n[order])


@lru_cache(maxsize=2)
def _part_ids(path: str) -> PartIds:
    return PartIds(path)


def pieces_of(tokens: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences first, its rest cut into even parts of `piece` at most."""
    full = tokens // capacity
    cut = [(i * capacity, capacity) for i in range(full)]
    start, rest = full * capacity, tokens % capacity
    parts = -(-rest // piece)
    for k in range(parts):
        end = full * capacity + rest * (k + 1) // parts
        cut.append((start, end - start))
        start = end
    return cut


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, capacity: int, piece: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    ids_of, end = _part_ids(path), np.array([END_ID], "<u4").tobytes()
    for batch in common.small_batches(batches, "text", 4_000_000):
        row, starts, lengths, crcs, totals, kept = [], [], [], [], [], []
        for i, ids in enumerate(ids_of.of(batch.column("text"))):
            ids = ids.tobytes() + end
            for start, length in pieces_of(len(ids) // 4, capacity, piece):
                part = ids[4 * start : 4 * (start + length)]
                row.append(i)
                starts.append(start)
                lengths.append(length)
                crcs.append(zlib.crc32(part))
                totals.append(len(ids) // 4)
                if keep_ids:
                    kept.append(part)
        columns = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()), "doc_tokens": pa.array(totals, pa.int64())}
        if keep_ids:
            columns["ids"] = pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


def tokenized_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, piece: int = PIECE, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, and ids (binary,
    little-endian unsigned 32-bit) if asked for. A null text is empty: its one piece holds the end id."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [slim.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    return slim.mapInArrow(partial(_tokenized, path=tokenizer, capacity=capacity, piece=piece, keep_ids=keep_ids), T.StructType(fields))


def differencing(lengths: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each item by Karmarkar-Karp multiway differencing.

    Every item starts as a partial partition of its own, empty in all bins but one. The two partitions
    with the largest imbalance (largest minus smallest bin) are merged again and again, the largest bin of
    one with the smallest of the other. Of a partition only its non-empty bins are held, largest first. A bin
    is a chain of items: head, last, and the next of each item.
    """
    n = len(lengths)
    follows = np.full(n, -1)
    tick = count()
    heap = [(-int(x), next(tick), np.array([x]), np.array([i]), np.array([i])) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, a_head, a_last = heapq.heappop(heap)
        _, _, b, b_head, b_last = heapq.heappop(heap)
        overlap = max(0, len(a) + len(b) - bins)
        if overlap:
            # Padded with zeros, the largest of b fall on empty bins of a, and the smallest of a meet the smallest of b,
            # the smaller the larger.
            keep_a, keep_b = len(a) - overlap, len(b) - overlap
            follows[a_last[keep_a:]] = b_head[keep_b:][::-1]
            load = np.concatenate([a[:keep_a], a[keep_a:] + b[keep_b:][::-1], b[:keep_b]])
            head = np.concatenate([a_head, b_head[:keep_b]])
            last = np.concatenate([a_last[:keep_a], b_last[keep_b:][::-1], b_last[:keep_b]])
        else:
            load, head, last = np.concatenate([a, b]), np.concatenate([a_head, b_head]), np.concatenate([a_last, b_last])
        order = np.argsort(-load, kind="stable")
        load = load[order]
        imbalance = int(load[0] - (load[-1] if len(load) == bins else 0))
        heapq.heappush(heap, (-imbalance, next(tick), load, head[order], last[order]))
    where = np.zeros(n, np.int64)
    if heap:
        for k, i in enumerate(heap[0][3].tolist()):
            while i >= 0:
                where[i] = k
                i = follows[i]
    return where


def windows(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each piece: as few near-equal windows as hold all, one more whenever capacity is exceeded."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    bins = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        where = differencing(lengths, bins)
        if np.bincount(where, lengths, bins).max() <= capacity:
            return where
        bins += 1


def _packed(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values(["length", "ids_crc32", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    lengths = group["length"].to_numpy(np.int64)
    whole = int((lengths == capacity).sum())  # these come first and fill a sequence each
    window = np.concatenate([np.arange(whole), whole + windows(lengths[whole:], capacity)])
    order = np.argsort(window, kind="stable")
    sizes = lengths[order]
    ends = np.cumsum(sizes)
    first = np.searchsorted(window[order], window[order], "left")
    offset = np.empty(len(order), np.int64)
    offset[order] = ends - sizes - (ends - sizes)[first]
    return pd.DataFrame({"piece": group["piece"], "sequence_id": (group["grp"].to_numpy(np.int64) << 20) + window, "offset": offset})


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False, in_order: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    Documents are tokenized once; whole sequences are cut off their front and the rest cut into parts of PIECE
    tokens at most. Pieces are dealt evenly to groups of about GROUP by a number given to each piece, so neither a long
    document nor copies fill a group, and only piece sizes reach the grouped step. `in_order` deals them by their place instead: a group is a stretch of
    GROUP to 2 GROUP pieces as they lie in a partition of `docs`, so that the sequences of a mix follow its schedule. Null texts
    are empty documents; repeated rows are packed each. Other columns don't take part. An
    empty table gives no rows.
    """
    cut = tokenized_pieces(docs, tokenizer, doc_id, text, capacity, keep_ids=keep_ids)
    cut = common.stored(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    slim = cut.select("piece", "length", "ids_crc32")
    if in_order:  # a piece's number is its partition's number and its place there
        slim = slim.withColumn("part", F.shiftright("piece", 33))
        parts = slim.groupBy("part").agg(F.greatest(F.lit(1), F.expr(f"count(*) div {GROUP}")).alias("groups"))
        before = F.sum("groups").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("groups")  # a row per task
        place = F.expr(f"(piece & {(1 << 33) - 1}) div {GROUP}")
        slim = slim.join(parts.withColumn("before", before), "part").withColumn("grp", F.col("before") + F.least(place, F.col("groups") - 1)).drop("part", "groups", "before")
    else:
        slim = slim.withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(common.partitions_for(cut.count(), GROUP))))

    def packed(group):
        return _packed(group, capacity)

    placed = slim.groupBy("grp").applyInPandas(packed, "piece long, sequence_id long, offset long")
    return cut.join(placed, "piece").drop("piece")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
