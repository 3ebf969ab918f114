"""Merkle manifest of a table: every row a leaf, every group a subtree; places of leaves are ranks in bitmaps of ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.llm import common

#: Children of a node, levels that one pass reduces, and so the slots of a pass's array.
FAN, DEPTH = 8, 3
SLOTS, FAN_BITS = FAN**DEPTH, FAN.bit_length() - 1
#: Bits of a place among the 64-bit words of a bitmap that one level of the directory resolves.
NODE_BITS = 12
#: The word of null ids, below all words of ids.
NO_ID = -(1 << 58)

_PATH = "array<struct<slot int, siblings array<string>>>"
_ROWS = T.StructType([T.StructField("g", T.StringType()), T.StructField("id", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], T.StructField("verified", T.BooleanType())])


def hashed(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def leaf_of(*values: Column) -> Column:
    """The sha256 (binary) of the values, each `-` if null, else its UTF-8 byte count, `:` and the value, one after the other."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256))


# Places: bitmaps of ids and their directory of counts.


def bitmap_words(leaves: DataFrame) -> DataFrame:
    """(g, w, bits, n): the non-empty 64-bit words of each group's bitmap of ids, and the rows in each.

    Words are merged by OR in every task and again after the shuffle, so that a group with a third of all rows sends at most a word per 64 ids and task. Null
    ids are rows of the word NO_ID without bits.
    """
    bit = F.when(F.col("id").isNull(), F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, cast(id & 63 as int))"))
    return leaves.groupBy("g", word_of().alias("w")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))


def word_of() -> Column:
    return F.coalesce(F.shiftright("id", 6), F.lit(NO_ID))


def before_words(words: DataFrame, low: int, high: int) -> DataFrame:
    """(g, w, before): how many rows of the group lie in smaller words, by a directory of counts over ever larger runs of words.

    No window has more than 2**NODE_BITS rows; there are as many levels as the range of words, `low` to `high`, asks for.
    """
    levels, shift = [words.select("g", F.col("w").alias("k"), "n")], 0
    while (high >> shift) - (low >> shift) >= 1 << NODE_BITS:
        levels.append(common.stored(levels[-1].groupBy("g", F.shiftright("k", NODE_BITS).alias("k")).agg(F.sum("n").alias("n")), "directory"))
        shift += NODE_BITS
    smaller = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = levels.pop().select("g", "k", smaller("g").alias("before"))
    for level in reversed(levels):
        inside = level.withColumn("p", F.shiftright("k", NODE_BITS)).withColumn("inside", smaller("g", "p"))
        found = inside.join(found.select("g", F.col("k").alias("p"), "before"), ["g", "p"]).select("g", "k", (F.col("inside") + F.col("before")).alias("before"))
    return found.withColumnRenamed("k", "w")


def placed(leaves: DataFrame) -> DataFrame:
    """`leaves` (g, id, leaf, claim) with pos, the place in the group by id, and height, the levels of the group's tree.

    A row's place is the count before its word and the rank of its bit there: rows are not sorted. Only words in which ids repeat (or are null) are
    ordered, by id, leaf and claim, equal rows as one; rows that differ in an id of such a word lie in one task, so one id with very many different
    contents is sorted there (Spark spills).
    """
    words = common.stored(bitmap_words(leaves), "words")
    low, high, n, bits = words.agg(F.min("w"), F.max("w"), F.sum("n"), F.sum(F.bit_count("bits"))).first()
    height = F.when(F.col("rows") > 1, F.ceil(F.length(F.bin(F.col("rows") - 1)) / FAN_BITS)).otherwise(0).cast("int")
    trees = words.groupBy("g").agg(F.sum("n").alias("rows")).select("g", height.alias("height"))
    index = common.stored(words.join(before_words(words, low or 0, high or 0), ["g", "w"]).join(trees, "g"), "index")
    keyed, single = leaves.withColumn("w", word_of()), F.col("n") == F.bit_count("bits")
    below = F.expr("bits & ~shiftleft(-1L, cast(id & 63 as int))")
    rows = keyed.join(index.where(single).hint("shuffle_hash"), ["g", "w"])
    rows = rows.select("g", "height", (F.col("before") + F.bit_count(below)).alias("pos"), "id", "leaf", "claim")
    if n == bits:
        return rows
    same = keyed.join(index.where(~single), ["g", "w"]).groupBy("g", "height", "w", "before", "id", "leaf", "claim").agg(F.count("*").alias("n"))
    order = Window.partitionBy("g", "w").orderBy("id", "leaf", "claim").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("n").over(order), F.lit(0))
    return rows.unionByName(same.withColumn("first", first).select("g", "height", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("pos"), "id", "leaf", "claim"))


# Levels: arrays of slots, and the way back.


def levels_of(nodes: list[str], depth: int) -> list[list[str]]:
    """The nodes (hexadecimal) and what `depth` reductions make of them: every FAN consecutive ones become their hash."""
    out = [nodes]
    for _ in range(depth):
        now = out[-1]
        out.append([hashed("".join(now[i : i + FAN])).hex() for i in range(0, len(now), FAN)])
    return out


def steps_of(levels: list[list[str]], slot: int) -> list[tuple[int, list[str]]]:
    """The way from a slot to the top of its array: at each level the place in the run, and the run's other nodes."""
    out = []
    for level in levels[:-1]:
        run = level[slot - slot % FAN : slot - slot % FAN + FAN]
        at = slot % FAN
        out.append((at, run[:at] + run[at + 1 :]))
        slot //= FAN
    return out


def folded(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a node and its siblings give."""
    for at, others in path:
        node = hashed("".join([*others[:at], node, *others[at:]])).hex()
    return node


def _depth(height: int, done: int) -> int:
    return max(0, min(DEPTH, height - DEPTH * done))


def _topped(batches: Iterator[pa.RecordBatch], done: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = []
        for slots, height in zip(batch.column("slots"), batch.column("height").to_pylist(), strict=True):
            tops.append(bytes.fromhex(levels_of([x.hex() for x in slots.values.field("leaf").to_pylist()], _depth(height, done))[-1][0]))
        yield common.with_columns(batch, top=pa.array(tops, pa.binary()))


def _passes(nodes: DataFrame) -> list[DataFrame]:
    """The passes from (g, height, pos, id, leaf, claim) to each group's root: tables g, height, b, slots (the array of SLOTS nodes or fewer), top."""
    out, high = [], 0
    while not out or high > DEPTH * len(out):
        block = F.shiftright("pos", FAN_BITS * DEPTH)
        slots = F.sort_array(F.collect_list(F.struct((F.col("pos") % SLOTS).alias("slot"), "id", "leaf", "claim"))).alias("slots")
        blocks = nodes.groupBy("g", "height", block.alias("b")).agg(slots)
        schema = T.StructType([*blocks.schema.fields, T.StructField("top", T.BinaryType())])
        out.append(common.stored(blocks.mapInArrow(partial(_topped, done=len(out)), schema), "levels"))
        if len(out) == 1:
            high = out[0].agg(F.max("height")).first()[0] or 0
        none = [F.lit(None).cast("long").alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("claim")]
        nodes = out[-1].where(F.col("height") > DEPTH * len(out)).select("g", "height", F.col("b").alias("pos"), *none)
    return out


def _tops(passes: list[DataFrame]) -> DataFrame:
    """(g, top): the root of each group."""
    ended = [p.where((F.col("height") <= DEPTH * (k + 1)) & (F.col("height") > DEPTH * k if k else F.lit(True))).select("g", "top") for k, p in enumerate(passes)]
    whole = ended[0]
    for more in ended[1:]:
        whole = whole.unionByName(more)
    return whole


def _children(batches: Iterator[pa.RecordBatch], done: int) -> Iterator[pa.RecordBatch]:
    """A pass's nodes, each with the path above it."""
    for batch in batches:
        for row in batch.to_pylist():
            levels = levels_of([x["leaf"].hex() for x in row["slots"]], _depth(row["height"], done))
            paths = [[{"slot": at, "siblings": others} for at, others in steps_of(levels, i)] + row["path"] for i in range(len(levels[0]))]
            places = [row["b"] * SLOTS + i for i in range(len(paths))]
            same = [pa.array([row[c]] * len(paths), pa.string()) for c in ("g", "subroot", "root")]
            kind = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([same[0], pa.array(places, pa.int64()), pa.array(paths, kind), *same[1:]], names=["g", "b", "path", "subroot", "root"])


def _with_paths(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first pass with path, subroot and root: `above` has them for whole groups (g, path, subroot, root), each pass gives them to the one below."""
    met = None
    for k in range(len(passes) - 1, -1, -1):
        ended = passes[k].where((F.col("height") <= DEPTH * (k + 1)) & (F.col("height") > DEPTH * k if k else F.lit(True))).join(above, "g")
        if met is not None:
            higher = passes[k].where(F.col("height") > DEPTH * (k + 1)).join(met, ["g", "b"])
            ended = ended.unionByName(higher)
        if k == 0:
            return ended
        met = common.stored(ended.mapInArrow(partial(_children, done=k), f"g string, b long, path {_PATH}, subroot string, root string"), "paths")


def _proved(batches: Iterator[pa.RecordBatch], paths: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            leaves = [x["leaf"].hex() for x in row["slots"]]
            levels = levels_of(leaves, _depth(row["height"], 0))
            above = [(s["slot"], s["siblings"]) for s in row["path"]]
            higher = "".join("".join(others) for _, others in above)
            proofs, roots, ways = [], [], []
            for i, x in enumerate(row["slots"]):
                steps = steps_of(levels, i)
                proofs.append(hashed("".join("".join(others) for _, others in steps) + higher).hex())
                roots.append(folded(leaves[i] if x["claim"] is None else x["claim"].hex(), steps + above))
                ways.append([{"slot": at, "siblings": others} for at, others in steps + above] if paths else None)
            n = len(leaves)
            text = lambda v: pa.array(v, pa.string())
            columns = [text([row["g"]] * n), pa.array([x["id"] for x in row["slots"]], pa.int64()), text(leaves), text([row["subroot"]] * n), text([row["root"]] * n), text(proofs), text(roots), pa.array([r == row["root"] for r in roots])]
            if paths:
                columns.append(pa.array(ways, pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*_ROWS.names, "path"][: len(columns)])


def _numbered(subroots: DataFrame) -> DataFrame:
    """(g, top, pos): groups in the bytewise order of their names, null first. Only rows per partition reach the driver."""
    ordered = common.stored(subroots.orderBy("g").withColumn("m", F.monotonically_increasing_id()), "groups")
    part = F.shiftright("m", 33)
    sizes = dict(ordered.groupBy(part.alias("p")).count().collect())
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    at = F.element_at(F.lit(before or [0]), (part + 1).cast("int")) + F.col("m").bitwiseAND((1 << 33) - 1)
    return ordered.select("g", "top", at.cast("long").alias("pos"))


def proofs(leaves: DataFrame, paths: bool = False) -> DataFrame:
    """Tree and proofs over `leaves`: group (any type that casts to string, nullable), id (an integer, nullable), leaf and claim (binary sha256; claim may be null).

    In a group leaves ascend by id (nulls first, repeated ids by leaf and claim); while there are several nodes, every FAN consecutive ones become their hash. What remains
    is the group's subroot, and the subroots in bytewise order of the groups' names, null first, give the root likewise. One row per leaf: group (string), id, leaf,
    subroot, root, proof_sha256 (of all siblings up to the root), folded_root (of the claim, else the leaf, with these siblings), verified, and with `paths` the
    siblings themselves. No rows give no rows. Arrays have SLOTS nodes at most, whatever the size of a group; what is broadcast or joined is left to Spark.
    """
    spark = leaves.sparkSession
    name = F.when(F.col("group").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("group").cast("string")))
    rows = common.stored(leaves.select(name.alias("g"), F.col("id").cast("long").alias("id"), "leaf", "claim"), "leaves")
    passes = _passes(placed(rows))
    subroots = common.stored(_numbered(_tops(passes)), "subroots")
    count = subroots.count()
    height = -(-(count - 1).bit_length() // FAN_BITS) if count > 1 else 0
    one = [F.lit("").alias("g"), F.lit(height).alias("height"), "pos", F.lit(None).cast("long").alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("claim")]
    whole = _passes(subroots.select(*one))
    root = _tops(whole).first()
    start = spark.createDataFrame([("", [], "", root[1].hex() if root else "")], f"g string, path {_PATH}, subroot string, root string")
    tree = _with_paths(whole, start).mapInArrow(partial(_children, done=0), f"g string, b long, path {_PATH}, subroot string, root string")
    above = subroots.join(tree.select(F.col("b").alias("pos"), "path", "root"), "pos").select("g", "path", F.lower(F.hex("top")).alias("subroot"), "root")
    schema = T.StructType([*_ROWS.fields, *([T.StructField("path", T._parse_datatype_string(_PATH))] if paths else [])])
    found = _with_paths(passes, common.stored(above, "above")).mapInArrow(partial(_proved, paths=paths), schema)
    return found.withColumn("g", F.when(F.col("g") != "n", F.substring("g", 2, 1 << 30))).withColumnRenamed("g", "group")


def manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), found: dict[str, Column] | None = None, paths: bool = False) -> DataFrame:
    """The proofs of all rows of `docs`, each the leaf of its `fields` (see leaf_of), see proofs.

    `found` has columns in place of fields as they are found elsewhere: rows whose leaf differs with them are not verified. Nulls may be in any column,
    texts of any length are hashed whole; repeated rows are leaves of their own, other columns don't take part.
    """
    as_found = [(found or {}).get(f, common.column(f)) for f in fields]
    claim = leaf_of(*as_found) if found else F.lit(None).cast("binary")
    return proofs(docs.select(common.column(group).alias("group"), common.column(doc_id).alias("id"), leaf_of(*map(common.column, fields)).alias("leaf"), claim.alias("claim")), paths)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; a third of them is verified against lower-cased texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.when(common.remainder(F.col("doc_id"), 3) == 0, common.ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return manifest(docs, found={"text": text}).select(F.col("id").alias("doc_id"), *_ROWS.names[2:])


def op11_sql() -> str:
    """The same by recursion over levels; the crc32 of an id is folded over its digits with a table made on the way."""
    value = lambda c: f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"
    leaf = lambda text: "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    up = """select id, t, lvl + 1 as lvl, pos // 8 as pos, sha256(array_to_string(hs[:pos % 8] || [h] || hs[pos % 8 + 2:], '')) as h, sibs || array_to_string(hs[:pos % 8] || hs[pos % 8 + 2:], '') as sibs"""
    level = "any_value(lvl) + 1 as lvl, pos // 8 as pos, sha256(string_agg(h, '' order by pos)) as h, (any_value(n) + 7) // 8 as n"
    return f"""with recursive
crc(list) as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end))),
docs as (select d.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda c, b: xor(list[(xor(c, b) & 255) + 1], c >> 8))) % 3 = 0 as third from documents d, crc),
leaves as (select doc_id as id, case when lang is null then 'n' else 'v' || lang end as t, {leaf("text")} as leaf,
    {leaf("(case when third then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end)")} as claim from docs),
nodes(t, lvl, pos, h, n) as (
  select t, 0, row_number() over (partition by t order by id) - 1, leaf, count(*) over (partition by t) from leaves
  union all select t, {level} from nodes where n > 1 group by t, pos // 8),
subroots as (select t, h, row_number() over (order by t) - 1 as pos, count(*) over () as n from nodes where n = 1),
whole(lvl, pos, h, n) as (select 0, pos, h, n from subroots union all select {level} from whole where n > 1 group by pos // 8),
runs as (select t, lvl, pos // 8 as r, list(h order by pos) as hs from nodes where n > 1 group by all),
top_runs as (select lvl, pos // 8 as r, list(h order by pos) as hs from whole where n > 1 group by all),
up(id, t, lvl, pos, h, sibs) as (
  select id, t, 0, row_number() over (partition by t order by id) - 1, claim, '' from leaves
  union all {up} from up join runs using (t, lvl) where r = pos // 8),
ended as (select u.id, u.t, u.h, u.sibs, s.h as subroot, s.pos from (select *, row_number() over (partition by id, t order by lvl desc) as last from up) u join subroots s using (t) where last = 1),
top_up(id, t, lvl, pos, h, sibs) as (select id, t, 0, pos, h, sibs from ended union all {up} from top_up join top_runs using (lvl) where r = pos // 8),
folded as (select *, row_number() over (partition by id, t order by lvl desc) as last from top_up)
select l.id as doc_id, leaf, subroot, root, sha256(f.sibs) as proof_sha256, f.h as folded_root, f.h = root as verified
from leaves l join ended e using (id, t) join folded f using (id, t), (select h as root from whole where n = 1) where f.last = 1"""
