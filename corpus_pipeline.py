"""The corpus pipeline: from `documents` to packed sequences in five stages.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that its predecessor kept;
all but the last return the columns of docs, of whatever names beside doc_id, text, lang, source and n_chars. An empty table goes through all
of them and stays empty; null texts are empty texts, and repeated rows are rows of their own.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import functions as F

from intentloom.llm import common, mixing, packing, quality, simhash, substring

#: Documents below this quality score go.
LEAST_QUALITY = 0.3
#: Near duplicates: words of a shingle, and the similarity that makes two texts one group.
WIDTH, LEAST_ALIKE = 5, 0.8
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: What the last stage stored on its way, by application.
_LEFT: dict[str, list] = {}


def _tidy(stage):
    """A stage that first drops what the stage before stored on its way: its result has been written by then, and if `docs` still reads any of it, that stays."""

    @wraps(stage)
    def run(spark, docs, sf_dir):
        app = spark.sparkContext.applicationId
        common.let_go(spark, _LEFT.pop(app, []), docs)
        had = common.since(spark, 0)
        out = stage(spark, docs, sf_dir)
        _LEFT[app] = [t for t in common.since(spark, 0) if t not in had]
        return out

    return run


@_tidy
def quality_stage(spark, docs, sf_dir):
    """Drops documents that the line field, fitted on a bounded sample of `labels`, scores below LEAST_QUALITY.

    Texts without words get the share of good documents in the sample. A score right at the bound stays; equal texts have equal scores.
    """
    field, score = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), common.fresh(docs, "quality_score")
    return quality.with_quality(docs, field, out=score).where(F.col(score) >= LEAST_QUALITY).select(*common.own(docs))


@_tidy
def near_duplicate_stage(spark, docs, sf_dir):
    """Keeps one document, that of the smallest id, of each group connected by LEAST_ALIKE or more of shingles of WIDTH words.

    Null ids come last, ties fall to the text; texts without words are one group, and rows that are equal in all keep one.
    """
    return simhash.one_of_each(docs, width=WIDTH, least=LEAST_ALIKE)


@_tidy
def substring_stage(spark, docs, sf_dir):
    """Cuts passages of 35 words and more that stand anywhere else; the text and its length follow. Every document stays, even
    one that is left without words; texts without such a passage, null ones too, are not touched."""
    words, removed, kept = names = tuple(common.fresh(docs, n) for n in ("n_words", "n_removed", "kept_text"))
    found, cut = substring.without_repeats(docs, names=names), F.col(removed) > 0
    changed = {"text": F.when(cut, F.col(kept)).otherwise(F.col("text")).alias("text"), "n_chars": F.when(cut, F.length(kept).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")}
    return found.select(*[changed.get(c, common.column(c)) for c in docs.columns])


@_tidy
def mixing_stage(spark, docs, sf_dir):
    """Repeats and cuts documents so that sources come near their target shares, in the order of the schedule.

    Documents without words are never taken; a null source is the last source.
    """
    return mixing.mixed_documents(docs)


@_tidy
def packing_stage(spark, docs, sf_dir):
    """Packs the mix, as it lies, into sequences of at most 4096 tokens: one row per piece. A text without words is its end id."""
    return packing.pack(docs, TOKENIZER, in_order=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Trained scores, hashes of word shingles and token ids are not SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies STAGES to documents, one after the other. What a stage returns is written to the shared folder and read again; then its
    own tables, and what its predecessor returned, are dropped."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with common.scratch(spark):
            path = common.kept(stage(spark, docs, sf_dir), name)
        if last:
            common.drop(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
