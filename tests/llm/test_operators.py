"""The training-data operators against brute force, round trips and held-out accuracy, and on odd inputs."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intentloom.llm import common, hmm, langid, licences, mixing, neardup, packing, quality, registry, shingles, simhash, substring, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, None, None, None, None, 0.0), (2, "", "en", "a", 0, 0.0), (3, " \n\t ", "en", "a", 4, 0.0), (4, "one", "en", "b", 3, 0.0), (5, LONG, "de", "a", len(LONG), 1.0),
    (6, "the same text twice, here it is", "en", "a", 31, 0.0), (7, "the same text twice, here it is", "en", None, 31, 0.0), (7, "the same text twice, here it is", "en", None, 31, 0.0),
    (None, "no id here", None, "c", 10, 0.0), (9, "123 456 !!", "fr", "c", 10, 0.0), (10, "\x1cnot a space\x85 é", "fr", "c", 15, 0.0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def table(docs):
    return docs.toPandas()


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- mixing ---


def targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        out |= {s: 3 * sizes[s] for s in over} or {s: weight[s] * level for s in free}
        free -= over or free
    return out


def check_mix(rows):
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    for s, t in targets(dict(size)).items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 1


def test_mix_meets_targets(docs):
    rows = mixing.mixed_sizes(docs.select("doc_id", "text", "source")).collect()
    assert len(rows) == 200
    check_mix(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed_sizes(docs.select("doc_id", "text", "source")).collect()))


def test_mix_of_odd_rows(spark, odd):
    rows = mixing.mixed_sizes(odd, block=16).collect()
    assert len(rows) == len(ODD)
    check_mix(rows)
    assert mixing.mixed_sizes(empty(spark)).count() == 0
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark, odd):
    want = sum(r.taken for r in mixing.mixed_sizes(odd).collect())
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns
    clash = odd.select("*", *[F.lit(n).alias(n) for n in ("rank", "nth", "epoch", "size", "mix_row", "mix_length", "slot", "at", "target")])
    assert mixing.mixed_documents(clash).columns == clash.columns and mixing.mixed_documents(clash).count() == got.count()
    assert sum(len(common.words_of(r.text)) for r in got.collect()) == want


def unevenness(spark, sources, block=8):
    """How many slots any stretch from the start of the schedule is away from the sources' shares, at most."""
    targets = spark.createDataFrame([(i + 1, n, float(t)) for i, (n, t) in enumerate(sources)], "rank int, source_size long, target double")
    slots = [r.rank for r in mixing.schedule(spark, targets, block, 3.0).orderBy("slot", "rank").collect()]
    share, seen, worst = collections.Counter(slots), collections.Counter(), 0.0
    for i, r in enumerate(slots, 1):
        seen[r] += 1
        worst = max(worst, *(abs(seen[k] - share[k] * i / len(slots)) for k in share))
    return worst


def test_every_stretch_of_the_schedule_is_near_the_weights(spark, monkeypatch):
    sources = [(4000, 9000), (9000, 7000), (500, 1500), (40, 8)]
    assert unevenness(spark, sources) < 4
    monkeypatch.setattr(mixing, "golden_point", lambda i: F.lit(0.999999) + i * 0)
    assert unevenness(spark, sources) > 100


def test_the_mix_lies_in_the_order_of_the_schedule(spark, docs, monkeypatch):
    sizes = {(r.doc_id, r.first_slot) for r in mixing.mixed_sizes(docs.select("doc_id", "text", "source"), block=16).collect() if r.taken}
    mix = mixing.mixed_documents(docs, slot="slot", block=16)
    rows = mix.withColumn("part", F.spark_partition_id()).collect()
    assert sizes == {(i, min(r.slot for r in rows if r.doc_id == i)) for i in {r.doc_id for r in rows}}
    for part in {r.part for r in rows}:
        slots = [r.slot for r in rows if r.part == part]
        assert slots == sorted(slots)
    monkeypatch.setattr(mixing, "RUN", 2)  # totals in several runs
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    check_mix(mixing.mixed_sizes(docs.select("doc_id", "text", "source")).collect())


def test_rows_with_maps(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", "s", {"k": 1}), (2, "a b c d e f", "s", {}), (3, None, None, None)], "doc_id long, text string, source string, m map<string,int>")
    assert mixing.mixed_documents(rows).count() >= 2 and simhash.one_of_each(rows).count() == 2 and shingles.one_of_each(rows).count() == 2


def test_golden_points_are_spread(spark):
    points = np.sort([r[0] for r in spark.range(2000).select(mixing.golden_point(F.col("id"))).collect()])
    assert np.diff(points).max() < 3 / 2000
    assert spark.range(2**44, 2**44 + 2).select(mixing.golden_point(F.col("id"))).first()[0] == pytest.approx((2**44 * mixing.GOLDEN % 2**47) / 2**47)


def test_one_source_with_all_rows(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit(None).cast("string").alias("source"))
    check_mix(mixing.mixed_sizes(rows, block=4).collect())


# --- language ---


def test_language_accuracy_and_odd_texts(spark, docs, table, odd):
    net = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang"))
    rows = {r.doc_id: r for r in langid.with_language(docs.drop("lang"), net).collect()}
    right = [rows[i].lang_pred == lang for i, lang in zip(table.doc_id, table.lang, strict=True)]
    assert np.mean(right) > 0.97 and all(0 <= r.lang_score <= 1 for r in rows.values())
    found = [(r.doc_id, r.lang_pred, r.lang_score) for r in langid.with_language(odd, net).collect()]
    assert len(found) == len(ODD)
    assert [(p, s) for i, p, s in found if i in (1, 2, 3, 9)] == [("und", 0.0)] * 4
    assert langid.with_language(empty(spark), net).count() == 0


def test_language_learns_nothing_from_nothing(spark):
    net = langid.fit(empty(spark).select("doc_id", "text", "lang"))
    assert net.predict(["text"]) [0] == ["und"]


def test_filters_by_pairs_equal_plain_convolution():
    net = langid.train(["abcd efgh" * 30, "xyz uvw" * 40] * 8, ["a", "b"] * 8, epochs=1)
    w = langid.windows("hällo wörld " * 50)[0]
    got, at = net.pooled(w, net.prepare()), 0
    for width, t, b in zip(langid.WIDTHS, net.tables, net.bias, strict=True):
        z = sum(t[k][w[:, k : langid.WINDOW - width + 1 + k]] for k in range(width)).max(1) + b
        assert np.allclose(got[:, at : at + langid.FILTERS], np.maximum(z, 0), atol=1e-4)
        at += langid.FILTERS


# --- packing ---


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_packing(rows, texts, path):
    tok = packing._tokenizer(path)
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    want = collections.Counter()
    for a in ids:
        for start, length in packing.pieces_of(len(a)):
            want[(len(a), start, length, zlib.crc32(a[start : start + length].tobytes()))] += 1
    assert collections.Counter((r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return sum(map(len, ids)), len(sequences)


def test_packing_round_trip(docs, table, tokenizer):
    tokens, sequences = check_packing(packing.pack(docs, tokenizer).collect(), table.text, tokenizer)
    assert tokens / (4096 * sequences) > 0.95


def test_packing_of_odd_rows(spark, odd, tokenizer):
    check_packing(packing.pack(odd, tokenizer).collect(), [r[1] for r in ODD], tokenizer)
    assert packing.pack(empty(spark), tokenizer).count() == 0
    kept = packing.pack(odd, tokenizer, keep_ids=True).where("doc_id = 4").first()
    assert zlib.crc32(kept.ids) == kept.ids_crc32 and len(kept.ids) == 4 * kept.length


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_part_ids_equal_the_tokenizer(text):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    want = packing._tokenizer(path).encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in packing._part_ids(path).of(pa.array([text, None, text]))] == [want, [], want]


def test_part_ids_past_the_bound_and_of_other_tokenizers(monkeypatch, table, tokenizer):
    texts = pa.array(table.text.tolist() * 2)
    want = packing.PartIds(tokenizer).of(texts)
    monkeypatch.setattr(packing, "HELD_BYTES", 100_000)
    small = packing.PartIds(tokenizer)
    got = [x for i in range(0, len(texts), 40) for x in small.of(texts.slice(i, 40))]
    assert 0 < 48 * len(small.at) + 4 * len(small.flat) <= 100_000
    other = packing.PartIds(tokenizer.replace("word_bpe_49k", "byte_bpe_50k"))
    assert small.by_parts and not other.by_parts
    plain = [other.tokenizer.encode(t, add_special_tokens=False).ids for t in table.text[:20]]
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and [x.tolist() for x in other.of(texts.slice(0, 20))] == plain


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1024), min_size=1, max_size=60))
def test_windows_hold_every_piece(lengths):
    where = packing.windows(np.array(lengths))
    assert np.bincount(where, lengths).max() <= 4096 and len(where) == len(lengths)


def test_differencing_balances():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1000, 500)
    loads = np.bincount(packing.differencing(lengths, 40), lengths, 40)
    assert loads.sum() == lengths.sum() and loads.max() - loads.min() < 100


# --- language model ---


def brute_likelihood(model, kinds, weight):
    a = model.start * model.emission[:, kinds[0]] * weight[kinds[0]]
    for k in kinds[1:]:
        a = (a @ model.transition) * model.emission[:, k] * weight[k]
    return math.log10(a.sum())


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(0)
    share = rng.dirichlet(np.ones(hmm.CLASSES + 1))
    model, weight = hmm.HiddenMarkov.first(share, 4), rng.uniform(0.5, 2000, hmm.CLASSES + 1)
    sizes = np.array([3, 1, 7, 7, 2])
    kinds = rng.integers(0, hmm.CLASSES + 1, sizes.sum())
    got = model.log10_likelihood(kinds, sizes, weight)
    for g, part in zip(got, np.split(kinds, np.cumsum(sizes)[:-1]), strict=True):
        assert g == pytest.approx(brute_likelihood(model, part, weight), abs=1e-9)


def test_expected_counts_equal_brute_force():
    rng = np.random.default_rng(2)
    model = hmm.HiddenMarkov.first(np.full(hmm.CLASSES + 1, 1 / (hmm.CLASSES + 1)), 3)
    sizes = np.array([2, 4, 1])
    kinds = rng.integers(0, 50, sizes.sum())
    first = np.array([True, False, True])
    counts = hmm.expected_counts(model, kinds, sizes, first)
    want = np.zeros_like(counts)
    for part, whole in zip(np.split(kinds, np.cumsum(sizes)[:-1]), first, strict=True):
        paths = list(np.ndindex(*[3] * len(part)))
        start = model.start if whole else model.share()
        p = np.array([start[s[0]] * np.prod([model.transition[a, b] for a, b in zip(s, s[1:], strict=False)]) * np.prod([model.emission[a, k] for a, k in zip(s, part, strict=True)]) for s in paths])
        for s, w in zip(paths, p / p.sum(), strict=True):
            want[-1, s[0]] += w * whole
            for a, k in zip(s, part, strict=True):
                want[k, a] += w
            for a, b in zip(s, s[1:], strict=False):
                want[hmm.CLASSES + 1 + a, b] += w
    assert np.allclose(counts, want, atol=1e-4)


def check_base(rows, texts, held):
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    c = collections.Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for ws in tokens)
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want


def test_model_beats_the_base(spark, docs, table):
    rows = registry.queries()["op4_hmm"](spark, SF).collect()
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in table.doc_id]
    check_base(rows, table.text, held)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_model_on_odd_rows(spark, odd):
    marked = odd.withColumn("held_out", F.coalesce(F.col("doc_id") == 6, F.lit(False)))
    rows = hmm.scored(marked, rounds=1).collect()
    check_base(rows, [r[1] for r in ODD], [r[0] == 6 for r in ODD])
    assert all(math.isfinite(r.score) for r in rows)
    assert hmm.scored(empty(spark).withColumn("held_out", F.lit(True))).count() == 0
    alone = hmm.scored(odd.where("doc_id = 4").withColumn("held_out", F.lit(True)), rounds=1).collect()
    assert (alone[0].n_known, alone[0].train_tokens, alone[0].base_score) == (0, 0, 0.0)


def test_model_on_clashing_names_and_many_cells(spark, docs, monkeypatch):
    few = docs.limit(40).select("doc_id", F.col("text").alias("body"), F.lit("x").alias("text"), F.lit(1).alias("Score"), F.lit(2).alias("c0"), F.create_map(F.lit("k"), F.lit(1)).alias("m.n"))
    few = few.withColumn("hidden", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 == 1))
    plain = {r.doc_id: r for r in hmm.scored(few, held_out="hidden", text="body", rounds=1).collect()}
    assert len(plain) == 40 and set(next(iter(plain.values())).asDict()) == {"doc_id", "text", "c0", "m.n", "hidden", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    monkeypatch.setattr(hmm, "CELL_TOKENS", 100)
    rows = hmm.scored(few, held_out="hidden", text="body", rounds=1).collect()
    assert all((r.n_known, r.train_tokens) == plain[r.doc_id][6:8] and r.score == pytest.approx(plain[r.doc_id].score) for r in rows)
    bodies = {r.doc_id: r.body for r in few.collect()}
    check_base(rows, [bodies[r.doc_id] for r in rows], [r.hidden is None or r.hidden for r in rows])


# --- vector near-duplicates ---


def brute_links(rows, cosine=0.93):
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in good}
    near = {i: [j for j in good if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]) >= cosine] for i in good}
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(rows[j][0] for j in seen)
        out.append((r[0], len(near.get(i, [])), low, low == r[0]))
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vector_links_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(0, 0.12, 16)], i % 2) for i in range(200)]
    rows += [(200 + i, rows[0][1], 0) for i in range(30)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [None] * 16, 1), (304, [float("nan")] * 16, 1), (305, rows[0][1], None), (306, rows[0][1][:8], 0)]
    want = brute_links(rows)
    got = sorted(tuple(r) for r in neardup.near_duplicates(vectors(spark, rows)).collect())
    links = lambda x: sum(r[1] for r in x)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True)) and links(got) >= 0.95 * links(want)
    monkeypatch.setattr(neardup, "SPLIT", 8)  # every bucket in parts: the same links
    assert sorted(tuple(r) for r in neardup.near_duplicates(vectors(spark, rows)).collect()) == got
    assert neardup.near_duplicates(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in neardup.near_duplicates(vectors(spark, rows[-7:-6])).collect()] == [(300, 0, 300, True)]


def test_vectors_with_text_labels_and_tiny_or_rare_ones(spark):
    rows = [(i, [1e-200 * (1 + (k == i % 3)) for k in range(3)], "x") for i in range(6)] + [(10, [1.0, 2.0], "x"), (11, [1.01, 2.0], "x"), (12, [1.0, 2.0], "y"), (13, [5.0], "x")]
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect())
    want = [(i, 5, 0, i == 0) for i in range(6)] if 5 / 6 >= 0.93 else [(i, 1, i % 3, i < 3) for i in range(6)]
    assert got == [*want, (10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True), (13, 0, 13, True)]


@pytest.mark.parametrize("offset", [0.2, 2.0])
def test_codes_are_balanced_and_pairs_meet(spark, offset):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 12)) + offset
    index = neardup.learn(spark.createDataFrame([([float(v) for v in r],) for r in x], "embedding array<double>"), 1500, 0.93, 0.98)
    units = neardup.unit(x)
    signs = index.signs(units)
    if offset < 1:  # vectors in a narrow cone keep signs around the origin
        assert 0.45 < signs.mean(0).min() and signs.mean(0).max() < 0.55
    a, b = np.nonzero(np.triu(units @ units.T >= 0.93, 1))
    codes = index.codes(signs)
    assert (codes[a] == codes[b]).any(1).mean() >= 0.97 and ((signs[a] != signs[b]).sum(1) <= index.radius).all()


# --- top-k ---


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (90, 6))
    v[40:70] = v[40]  # ties
    rows = [(i, [int(x) for x in v[i]]) for i in range(90)] + [(None, [1] * 6), (91, None)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    queries = frame.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "v")
    got = sorted(map(tuple, topk.search(queries, frame, 7).collect()))
    want = []
    for q in range(0, 90, 10):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(90) if i != q)[:7]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_topk_by_blocks_and_ranges(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.integers(-50, 51, (400, 5))
    frame = spark.createDataFrame([(i % 390, [int(x) for x in v[i]]) for i in range(400)], "vec_id long, v array<long>")  # ids 0 to 9 twice
    queries = frame.where("vec_id % 6 = 0").select(F.col("vec_id").alias("query_id"), "v")
    want = []
    for q in (i for i in range(400) if i % 390 % 6 == 0):
        best = sorted((-int(v[q] @ v[i]), i % 390) for i in range(400) if i % 390 != q % 390)[:4]
        want += [(q % 390, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for name, value in (("BROADCAST_BYTES", 0), ("QUERY_BLOCK", 20), ("ROW_BLOCK", 16), ("RANGE", 2), ("BINS", 8), ("HELD", 1)):
        monkeypatch.setattr(topk, name, value)
    found = topk.search(queries, frame, 4)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_topk_few_rows_and_large_values(spark):
    frame = spark.createDataFrame([(0, [2**30, 1]), (1, [2**30, 2]), (2, [-5])], "vec_id long, v array<long>")
    queries = frame.select(F.col("vec_id").alias("query_id"), "v")
    got = sorted(map(tuple, topk.search(queries, frame, 10).collect()))
    assert got == [(0, 1, 1, 2**60 + 2), (0, 2, 2, -5 * 2**30), (1, 1, 0, 2**60 + 2), (1, 2, 2, -5 * 2**30), (2, 1, 0, -5 * 2**30), (2, 2, 1, -5 * 2**30)]
    assert topk.search(queries.limit(0), frame, 3).count() == 0
    assert topk.search(queries, frame.limit(0), 3).count() == 0
    odd = spark.createDataFrame([(1, [1.0, None]), (2, None), (3, [float("nan")]), (4, [0.5, -0.5])], "vec_id long, e array<float>")
    assert [r.vec_id for r in odd.where(topk.usable(F.col("e"))).collect()] == [4]


# --- repeated passages ---


def brute_removed(texts, width=35):
    words = [common.words_of(t) for t in texts]
    count = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def test_passages_equal_brute_force(spark, docs, table, odd):
    got = substring.without_repeats(docs.select("doc_id", "text")).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_text) for r in got) == brute_removed(table.text)
    got = substring.without_repeats(odd.withColumn("n_words", F.lit("clash")))
    assert sorted((r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == brute_removed([r[1] for r in ODD])
    assert substring.without_repeats(empty(spark)).count() == 0


def test_phrases_are_found_by_the_automata(spark, docs, table, monkeypatch):
    """Picked places alone, without the search through all documents, miss passages; and so does a search without the confirmed phrases."""
    blocks = [substring.Block(r.payload, "text", 35) for r in common.blocks_of(docs.select("doc_id", "text").repartition(1), budget=40_000).collect()]
    posted = [substring._posted(i, b, 3) for i, b in enumerate(blocks)]
    known = collections.defaultdict(list)
    merged = pa.Table.from_batches(posted)
    for cell in set(merged.column("cell").to_pylist()):
        for r in substring._confirmed(merged.filter(pa.compute.equal(merged.column("cell"), cell))).to_pylist():
            known[r["blk"]].append(np.frombuffer(r["hashes"], np.uint8).reshape(-1, substring.PHRASE * substring.LETTERS))
    found = substring.occurrences(blocks, np.unique(np.concatenate([k for v in known.values() for k in v]), axis=0))
    counts = collections.Counter(tuple(b.codes[i : i + 35].tolist()) for b in blocks for i in np.flatnonzero(b.inside(35)).tolist())
    assert max(counts.values()) > 1
    missed = 0
    for block, places in zip(blocks, found, strict=True):
        repeated = {i for i in np.flatnonzero(block.inside(35)).tolist() if counts[tuple(block.codes[i : i + 35].tolist())] > 1}
        assert repeated <= set(block.candidates(places).tolist())
        picked = np.flatnonzero(block.phrases()[2])
        missed += len(set(places.tolist()) - set(picked.tolist()))
        assert len(places) < len(block.codes) / 2
    assert missed > 100


def test_passages_that_meet_and_overlap(spark, monkeypatch):
    monkeypatch.setattr(substring, "CELL_BYTES", 500)
    rng = np.random.default_rng(6)
    run = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    a, b = run(80), run(35)
    texts = [" ".join(x) for x in (run(20) + a + run(5), a[:50] + run(40) + b, b + run(3) + a[30:70], b[:34] + run(9), ["same"] * 90, run(10) + ["same"] * 36, a[10:45])]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = substring.without_repeats(frame).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_text) for r in got) == brute_removed(texts)


# --- quality ---


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in registry.queries()["op8_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95


def test_quality_on_odd_rows(spark, odd):
    field = quality.train(["good line here.\nAnother one."] * 8 + ["BAD!! BAD!! BAD!!"] * 8, [1] * 8 + [0] * 8)
    scores = [r.quality_score for r in quality.with_quality(odd, field).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert scores[0] == scores[1] == scores[2] == field.prior
    assert quality.with_quality(empty(spark), field).count() == 0
    assert quality.train([], []).score(["x", None]).tolist() == [0.5, 0.5]
    assert quality.train(["x y"], [1]).score(["x", None]).tolist() == [2 / 3, 2 / 3]
    lines = quality.line_marginals(odd, field).collect()
    assert all(0 <= r.good <= 1 for r in lines) and sum(r.id == 5 for r in lines) == 1


def test_lines_of_mixed_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.text, labels[r.doc_id], zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.doc_id in labels]
    field = quality.train(*zip(*[r[:2] for r in rows if not r[2]], strict=True))
    made, kinds = quality.spliced(*zip(*[r[:2] for r in rows if r[2]], strict=True), seed=3)
    good, _, counts = field.lines(made)
    assert np.mean((good > 0.5) == np.concatenate(kinds)) > 0.92
    both = [0 < (g > 0.5).mean() < 1 for g in np.split(good, np.cumsum(counts)[:-1])]
    assert np.mean(both) > 0.7  # lines of one document differ
    mixed = field.score(made)
    pure = [field.score([t for t, y, held in rows if held and y == k]) for k in (0, 1)]
    assert np.median(pure[0]) < np.median(mixed) < np.median(pure[1])


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(7)
    counts, trans = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    e = rng.normal(size=(8, 2))
    marginal, z, pairs = quality.forward_backward(e, counts, trans)
    at, want_pairs = 0, np.zeros((2, 2))
    for n, zi in zip(counts, z, strict=True):
        paths = list(np.ndindex(*[2] * n))
        s = np.array([sum(e[at + t, y] for t, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        w = np.exp(s - np.logaddexp.reduce(s))
        assert zi == pytest.approx(np.logaddexp.reduce(s))
        assert np.allclose(marginal[at : at + n, 1], [sum(x for x, p in zip(w, paths, strict=True) if p[t]) for t in range(n)])
        for x, p in zip(w, paths, strict=True):
            for a, b in zip(p, p[1:], strict=False):
                want_pairs[a, b] += x
        at += n
    assert np.allclose(pairs, want_pairs)


# --- SimHash ---


def brute_components(rows, bits=4):
    prints = []
    for _, text in rows:
        words = [w.lower() for w in common.words_of(text)]
        shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        h = [simhash.xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            at = todo.pop()
            for j in range(len(rows)):
                if j not in seen and (prints[at] ^ prints[j]).bit_count() <= bits:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((str(rows[i][0]), prints[i], min(ids) if ids else None))
    return sorted(out, key=str)


def test_simhash_equals_brute_force(spark, table, odd):
    got = [(str(r.doc_id), int(r.fingerprint, 16), r.component_id) for r in registry.queries()["op9_simhash"](spark, SF).collect()]
    assert sorted(got, key=str) == brute_components(list(zip(table.doc_id, table.text, strict=True)))
    got = [(str(r.doc_id), r.simhash % 2**64, r.component_id) for r in simhash.near_duplicates(odd.withColumn("simhash", F.lit(1))).collect()]
    assert sorted(got, key=str) == brute_components([(r[0], r[1]) for r in ODD])
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_of_each(odd).columns == odd.columns
    clash = odd.select("*", *[F.lit(n).alias(n) for n in ("row", "simhash", "first", "id", "component_id")])
    once = simhash.one_of_each(clash)
    assert once.columns == clash.columns and once.count() == simhash.one_of_each(odd).count() and once.first().row == "row"


def test_groups_without_an_id_of_their_own_keep_a_row_each(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[3]), (None, texts[4]), (9, texts[4])]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4])]))


def classes_of(prints, edges):
    low = {p: p for p in prints}
    for _ in prints:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return low


@pytest.mark.parametrize("small", [0, 64])
def test_links_of_near_fingerprints(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)  # all postings breadth first, or pair by pair
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 6)]
    prints = sorted({b ^ sum({1 << int(k) for k in rng.integers(0, 63, rng.integers(0, 7))}) for b in base for _ in range(25)})
    table = pa.table({"cell": [0] * 2, "fps": [np.array(prints[i::2], np.int64).tobytes() for i in range(2)]})
    found = [simhash._linked(table, [m], 1, 4) for m in (0, 0xFF, 0xFFFFFFFF)]
    near = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) % 2**64).bit_count() <= 4}
    for mask, t in zip((0, 0xFF, 0xFFFFFFFF), found, strict=True):
        edges = {(x["a"], x["b"]) for x in t.to_pylist()}
        here = {(a, b) for a, b in near if not (a ^ b) & mask}
        assert edges <= here and classes_of(prints, edges) == classes_of(prints, here)
    edges = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert edges <= near and classes_of(prints, edges) == classes_of(prints, near)


def index_of(prints, max_bits):
    """What meets in the index: the cells that fingerprints are posted to, linked one by one."""
    masks = [sum(0xFF << 8 * j for j in c) for c in simhash.positions(max_bits)]
    batch = pa.record_batch({"fp": pa.array(np.array(prints, np.uint64).view(np.int64))})
    cells = collections.defaultdict(list)
    for out in simhash._posted(iter([batch]), masks, 2):
        for c, f in zip(out.column("cell").to_pylist(), out.column("fps").to_pylist(), strict=True):
            cells[c].append(f)
    edges = set()
    for c, fps in cells.items():
        edges |= {(x["a"], x["b"]) for x in simhash._linked(pa.table({"cell": [c] * len(fps), "fps": fps}), masks, 2, max_bits).to_pylist()}
    return edges


@pytest.mark.parametrize("max_bits", [2, 4, 6])
def test_index_positions_meet_every_fitting_pair(max_bits):
    from itertools import combinations

    chosen = simhash.positions(max_bits)
    assert {len(c) for c in chosen} == {7 - max_bits} and len(chosen) < math.comb(8, 7 - max_bits) or max_bits == 6
    assert all(any(set(c) <= set(shared) for c in chosen) for shared in combinations(range(8), 8 - max_bits))


@pytest.mark.parametrize("small", [64, 1])
def test_the_count_of_shared_bytes_decides(monkeypatch, small):
    """On pairs as the index makes them: a bound one lower lets more candidates through, one higher loses links."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng, real, seen = np.random.default_rng(6), simhash.retained, []
    prints = set()
    for base in rng.integers(0, 1 << 62, 40).tolist():
        prints.add(base)
        for n in (1, 4, 4, 5, 5, 5):  # so many bytes differ, by one bit each
            prints.add(base ^ sum(1 << (8 * int(j) + int(rng.integers(8))) for j in rng.permutation(8)[:n]))
    want = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4}
    results = {}
    for change in (0, -1, 1):
        def counted(a, b, least, change=change):
            out = real(a, b, least + change)
            seen.append(len(out))
            return out

        monkeypatch.setattr(simhash, "retained", counted)
        seen.clear()
        edges = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in index_of(sorted(prints), 4)}
        results[change] = (classes_of(sorted(prints), edges), sum(seen))
    assert results[0][0] == classes_of(sorted(prints), want)
    assert results[-1][0] == results[0][0] and results[-1][1] > results[0][1] + 50
    assert results[1][0] != results[0][0]


# --- near copies by shingles ---


def brute_near_copies(rows, least=0.8):
    """The rows that stay: the smallest id of each component, null ids last, by exact sets of shingles."""
    sets = []
    for _, text in rows:
        w = [x.lower() for x in common.words_of(text)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(rows)))
    alike = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if x == y or (x and y and 10 * len(x & y) >= round(10 * least) * len(x | y))]
    for _ in rows:
        for i, j in alike:
            low[i] = low[j] = min(low[i], low[j])
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[low[i]].append((r[0] is None, r[0] or 0, i))
    return sorted(repr(rows[min(g)[2]]) for g in groups.values())


def planted_near_copies(rng):
    """Originals, copies with words replaced at random (similarities on both sides of 0.8), and chains of copies of copies."""
    rows, n = [], 0
    for _ in range(25):
        base = [f"v{x}" for x in rng.integers(0, 5000, rng.integers(60, 400))]
        for edits in (0, 1, 2, 3, 4, 6, 9, 14):
            words = list(base)
            for at in rng.integers(0, len(words), edits):
                words[at] = f"z{n}x{at}"
            rows.append((int(n * 7919 % 1009), " ".join(words).upper() if n % 5 == 0 else " ".join(words)))
            n += 1
    words = [f"c{i}" for i in range(200)]
    for i in range(30):
        words[i * 6] = f"y{i}"
        rows.append((2000 - i, " ".join(words)))
    return rows


def test_near_copies_equal_brute_force(spark, odd):
    import corpus_pipeline

    rows = planted_near_copies(np.random.default_rng(4))
    same = [f"p{i}" for i in range(90)]  # many texts around one passage, most of them below 0.8 of each other
    rows += [(3000 + i, " ".join([*same, *[f"q{i}x{j}" for j in range(i % 40)]])) for i in range(120)]
    rows += [(None, "a text without an id"), (None, "another text without an id"), (5000, "one two"), (5000, "three four"), (5001, "ONE  two"), (5002, None), (5003, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == brute_near_copies(rows)
    clash = odd.select("*", *[F.lit(n).alias(n) for n in ("row", "near", "node", "first", "root", "key", "a", "b")])
    once = shingles.one_of_each(clash)
    assert once.columns == clash.columns and once.count() == len(brute_near_copies([(r[0], r[1]) for r in ODD]))
    assert shingles.one_of_each(empty(spark)).count() == 0


def test_parity_maps_lose_nothing():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    for _ in range(200):
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 600))) for _ in range(2))
        (_, nx, _, mx, _), (_, ny, _, my, _) = (shingles._features(s) for s in (x, y))
        assert (nx, ny) == (len(x), len(y))
        mx, my = mx.view(np.uint64), my.view(np.uint64)
        assert sum(int(d).bit_count() for d in mx ^ my) <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(5, 5)]])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in common.components(frame).collect()}
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {k: v for k, v in low.items() if k != v}


# --- licences ---


def test_licences(spark, odd):
    texts = ["x\nReleased under the MIT license", "RELEASED UNDER THE MIT LICENSE!", "licensed under CC BY-NC 4.0", "Released", "", None, "a long line that says released under the MIT license and then goes on and on", "all rights reserved\nAll Rights  Reserved."]
    rows = licences.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [[(h.at, h.licence) for h in r.licence_hits] for r in rows] == [[(2, "MIT")], [(1, "MIT")], [(1, "CC-BY-NC-4.0")], [], [], [], [], [(1, "reserved"), (2, "reserved")]]
    assert licences.scan(odd).count() == len(ODD)
    plan = licences.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["licensed", "under", "the", "apache", "license", "version", "2", "0", "mit"]), max_size=12))
def test_size_bounds_lose_nothing(words):
    grams = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
    for t in licences.TEMPLATES.values():
        other = set(licences.template_bigrams(t))
        if grams and 2 * len(grams & other) / (len(grams) + len(other)) >= 0.8:
            assert licences.needed_words(licences.template_bigrams(t), 0.8) & set(words)
            assert math.ceil(len(other) * 0.8 / 1.2 - 1e-9) <= len(grams) <= math.floor(len(other) * 1.2 / 0.8 + 1e-9)
