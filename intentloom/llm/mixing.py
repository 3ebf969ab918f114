"""Mixing sources to target weights with a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intentloom.llm import common

#: The golden ratio's fraction times 2**47: multiples of it modulo 2**47 are the points of the schedule.
GOLDEN, MODULUS = 86_980_551_294_885, 1 << 47
#: Rows or slots of a bucket in the two-level rankings, and words in a block of the schedule.
BUCKET_ROWS, BLOCK_WORDS = 512, 1024
#: Cells of the grid in which points find their source, buckets whose totals are added up in one window.
GRID, RUN = 4096, 4096


def golden_point(i: Column) -> Column:
    """i * GOLDEN modulo 2**47 as a fraction of 1, exact for i below 2**45: the factor is split into
    digits of 15 bits so that no product leaves 63 bits."""
    c, b, a = i.bitwiseAND(F.lit(32767)), F.shiftright(i, 15).bitwiseAND(F.lit(32767)), F.shiftright(i, 30)
    low = c * F.lit(GOLDEN)
    mid = (b * F.lit(GOLDEN)).bitwiseAND(F.lit((1 << 32) - 1)) * F.lit(1 << 15)
    high = (a * F.lit(GOLDEN % (1 << 17))).bitwiseAND(F.lit((1 << 17) - 1)) * F.lit(1 << 30)
    return ((low % MODULUS + mid + high) % MODULUS) / F.lit(float(MODULUS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Target words per source: (source, source_size) -> plus rank, weight, target.

    Sources ordered by code point, null last, weigh `weights` in turn and share the sum of all sizes by
    weight; no target exceeds `most` times its source's size, what is above goes to the others by
    weight until none is above. That is min(most * size, weight * level) with one level for all: with the
    sources in order of most * size / weight, those before the first whose share stays under its cap are capped.
    One row per source is ranked, not one per document.
    """
    one = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    cap = F.lit(most) * F.col("source_size")
    order = one.orderBy((cap / F.col("weight")).asc(), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # The level of the first source that stays under its cap holds for all after it.
    leveled = ranked.withColumn("mine", F.when(level * F.col("weight") <= cap, level))
    level = F.first("mine", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return leveled.withColumn("target", F.when(F.col("source_size") > 0, F.coalesce(F.least(F.lit(most) * F.col("source_size"), level * F.col("weight")), F.lit(most) * F.col("source_size"))).otherwise(0.0)).drop("mine")


def before(totals: DataFrame, order: str, *values: str) -> DataFrame:
    """`totals` (rank, `order`, values: one row per rank and place in order) with before_<value>, the sum over earlier places of the rank.

    Places are added up inside runs of RUN places, and runs after that, so that no window holds all places of a rank.
    """
    run = totals.withColumn("run_", F.expr(f"{order} div {RUN}"))
    earlier = lambda *keys: Window.partitionBy("rank", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda v, w: F.coalesce(F.sum(v).over(w), F.lit(0))
    runs = run.groupBy("rank", "run_").agg(*[F.sum(v).alias(f"run_{v}") for v in values])
    runs = runs.select("rank", "run_", *[total(f"run_{v}", earlier("run_")).alias(f"runs_{v}") for v in values])
    inside = run.select("*", *[total(v, earlier("run_", order)).alias(f"in_{v}") for v in values])
    return inside.join(runs, ["rank", "run_"]).select(*totals.columns, *[(F.col(f"in_{v}") + F.col(f"runs_{v}")).alias(f"before_{v}") for v in values])


def shuffled(docs: DataFrame, rows: int, seed: int) -> DataFrame:
    """Rows of each source in a fixed pseudo-random order: columns at (words before in the source) and nth (rows before).

    Rows are dealt to buckets by their hash, running totals are taken inside each bucket,
    and one row per bucket carries the totals before it. So a source with a third of all rows is
    ordered by many tasks. Ties of the hash fall to id, size and all columns; rows equal in all are alike.
    """
    buckets = common.partitions_for(rows, BUCKET_ROWS)
    h = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    dealt = docs.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftright("h", 7), F.lit(buckets)))
    total = before(dealt.groupBy("rank", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "bucket", "words", "rows").drop("words", "rows")
    inside = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("w", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("r", F.count(F.lit(1)).over(inside))
    at, nth = (F.col("before_words") + F.col("w")).alias("at"), (F.col("before_rows") + F.col("r")).alias("nth")
    return run.join(total, ["rank", "bucket"]).select(*[F.col(c) for c in docs.columns], at, nth)


def schedule(spark, targets: DataFrame, block: int, most: float) -> DataFrame:
    """The slots of the mix: slot, rank (source), nth (slots of that source before), epoch, block, words.

    A source needs as many slots as blocks cover its target. Slot i draws the source in whose share of the cumulative
    needs the golden-ratio point of i falls, so every stretch of the schedule is close to the
    weights. Slots are then ranked per source: inside chunks of the schedule, plus the counts
    of the chunks before. Draws past a source's target are dropped; the few that the points leave short of it, by their
    discrepancy, follow at the end. A source's last slot takes only the words that are missing.
    """
    goal = F.floor(F.col("target") + 0.5).cast("long")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    needs = targets.where("source_size > 0").select("rank", "source_size", goal.alias("goal"), blocks.alias("blocks"))
    epoch, rest = F.expr("goal div source_size"), F.col("goal") % F.col("source_size")
    needs = needs.withColumn("need", epoch * F.col("blocks") + F.ceil(rest / block).cast("long")).where("need > 0")
    one = Window.partitionBy(F.lit(0))
    to = F.sum("need").over(one.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    needs = common.stored(needs.withColumn("to", to).withColumn("all", F.sum("need").over(one)), "needs")
    n = needs.agg(F.max("all")).first()[0] or 0
    # Shares are met through a grid over [0, 1): a point is compared with the shares of its cell only.
    share = needs.select("rank", ((F.col("to") - F.col("need")) / F.col("all")).alias("low"), F.when(F.col("to") < F.col("all"), F.col("to") / F.col("all")).otherwise(2.0).alias("high"))
    cells = F.sequence(F.floor(F.col("low") * GRID), F.least(F.lit(GRID - 1).cast("long"), F.floor(F.col("high") * GRID)))
    share = share.select("rank", "low", "high", F.explode(cells).alias("cell"))
    slots = spark.range(n).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * GRID)).join(share, "cell").where("low <= point and point < high").select("slot", "rank")
    chunk = F.expr(f"slot div {BUCKET_ROWS}")
    slots = slots.withColumn("chunk", chunk)
    counts = before(slots.groupBy("rank", "chunk").agg(F.count("*").alias("n")), "chunk", "n")
    inside = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")) - 1
    drawn = slots.withColumn("r", inside).join(counts.drop("n"), ["rank", "chunk"]).select("slot", "rank", (F.col("before_n") + F.col("r")).alias("nth"))
    got = slots.groupBy("rank").agg(F.count("*").alias("got"))
    short = needs.join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    short = short.select(F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("nth"), "rank").select((F.lit(n) + F.col("nth")).alias("slot"), "rank", "nth")
    placed = drawn.unionByName(short).join(needs, "rank").where("nth < need")
    epoch = F.expr("nth div blocks")
    at = F.col("nth") % F.col("blocks")
    full = F.least(F.lit(block), F.col("source_size") - at * block)
    left = F.col("goal") - epoch * F.col("source_size") - at * block
    return placed.select("slot", "rank", "nth", epoch.alias("epoch"), at.alias("block"), F.least(full, left).alias("words"))


def takes(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, block: int = BLOCK_WORDS, seed: int = 11, source: str = "source", text: str = "text", doc_id: str = "doc_id", row: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows, pieces) of the mix. `row`: a column to carry along in rows.

    rows: every input row with size, source_size, target, rank and nth (its place among its source's rows).
    pieces: one row per slot and document that it draws on: slot, rank, nth, epoch, start and length in words of the document.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(text).alias("text_hash"), common.row_hash(docs).alias("row_hash"),
        *([F.col(row)] if row else []),
    )
    slim = common.stored(slim, "sizes")
    sizes = common.stored(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    ranked = slim.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, slim.source.eqNullSafe(sizes.source)).drop(sizes.source)
    rows = common.stored(shuffled(ranked, slim.count(), seed), "order")
    at = F.expr(f"explode(sequence(at div {block}, (at + size - 1) div {block}))").alias("block")
    held = rows.where("size > 0").select("rank", "nth", "at", "size", at)
    slots = schedule(spark, sizes, block, most).select(F.col("rank").alias("s_rank"), F.col("block").alias("s_block"), "slot", "epoch", "words")
    met = held.join(slots, (F.col("rank") == F.col("s_rank")) & (F.col("block") == F.col("s_block")))
    start = F.greatest(F.lit(0), F.col("block") * block - F.col("at"))
    stop = F.least(F.col("size"), F.col("block") * block + F.col("words") - F.col("at"))
    pieces = met.select("slot", "rank", "nth", "epoch", start.alias("start"), (stop - start).alias("length")).where("length > 0")
    return rows, pieces


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, first_slot (of the schedule; null if the mix never takes the row).

    Null texts have size 0 and are never taken; a null source is a source of its own, the last one.
    Repeated rows and ids are rows of their own. An empty table, or one without words, takes nothing. Other columns only break ties.
    """
    rows, pieces = takes(docs, **options)
    taken = pieces.groupBy("rank", "nth").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"))
    taken = rows.join(taken, ["rank", "nth"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def mixed_documents(docs: DataFrame, text: str = "text", chars: str = "n_chars", slot: str = "", **options) -> DataFrame:
    """The mix as documents: a row for every time that the mix takes a row of `docs`, with its columns, in every partition in the order of the schedule.

    Rows are dealt to partitions by hash, so each partition is a thinner mix of its own; with a name for `slot`, a column of that name at the end has the slot at which each row
    starts. Taken whole, a document stays as it is; the one at which its source stops is cut after the words taken, joined by
    one space, and `chars`, if there is such a column, counts what is left. Documents without words (null, empty, white space) are never taken.
    Repeated rows are taken each. Columns of any names pass through, maps too. An empty table, or one without words, gives no rows.
    """
    columns, mine = docs.columns, common.own(docs)
    row, cut, length, at = (common.fresh(docs, n) for n in ("mix_row", "mix_cut", "mix_length", "mix_slot"))
    docs = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "mixed", "zstd")
    rows, pieces = takes(docs, text=text, row=row, **options)
    taken = pieces.groupBy("rank", "nth", "epoch").agg(F.sum("length").alias(length), F.min("slot").alias(at))
    taken = rows.select("rank", "nth", row, "size").join(taken, ["rank", "nth"]).select(row, at, length, (F.col(length) < F.col("size")).alias(cut))
    words = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({common.WORD})"), 1), F.lit(1), F.col(length).cast("int")), " ")
    out = docs.join(taken, row).withColumn(text, F.when(F.col(cut), words).otherwise(F.col(text)))
    if chars in columns:
        out = out.withColumn(chars, F.when(F.col(cut), F.length(text).cast(docs.schema[chars].dataType)).otherwise(F.col(chars)))
    out = out.sortWithinPartitions(at, row)
    return out.select(*mine, *([F.col(at).alias(slot)] if slot else []))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed_sizes(docs).drop("source")
