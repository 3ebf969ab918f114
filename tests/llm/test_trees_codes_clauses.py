"""Merkle manifests, vector codes and the toxicity grammar against brute force, and on odd inputs."""

import hashlib
import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from intentloom.llm import common, merkle, shingles, simhash, toxicity, vectorcodes

SF = "/root/testdata/sf0.001"


def H(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# --- manifests ---


def brute_tree(leaves):
    """Root and the siblings of each leaf, level by level."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for i, p in enumerate(paths):
            run = leaves[at[i] // 8 * 8 : at[i] // 8 * 8 + 8]
            p.append((at[i] % 8, run[: at[i] % 8] + run[at[i] % 8 + 1 :]))
            at[i] //= 8
        leaves = [H("".join(leaves[i : i + 8])) for i in range(0, len(leaves), 8)]
    return leaves[0], paths


def brute_manifest(rows, fields, found):
    """(group, id, leaf, subroot, root, proof, folded, verified) of rows of dicts; `found` gives a row as it is found elsewhere."""
    leaf = lambda r: H("".join("-" if r[f] is None else f"{len(str(r[f]).encode('utf-8', 'surrogatepass'))}:{r[f]}" for f in fields))
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(found(r)), r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:4])]) for g in names}
    root, above = brute_tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, above, strict=True):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:4]), trees[g][1], strict=True):
            now = x[3]
            for at, others in path + up:
                now = H("".join(others[:at] + [now] + others[at:]))
            out.append((g, x[4], x[2], trees[g][0], root, H("".join(s for _, o in path + up for s in o)), now, now == root))
    return sorted(out, key=repr)


def lowered(r):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]) if r["text"] is not None else None
    return r | {"text": low} if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else r


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

def text_as_found():
    return F.when(common.remainder(F.col("doc_id"), 3) == 0, common.ascii_lower(F.col("text"))).otherwise(F.col("text"))


def test_manifest_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, merkle.manifest(docs, found={"text": text_as_found()}).collect()), key=repr)
    assert got == brute_manifest([r.asDict() for r in docs.collect()], FIELDS, lowered)
    assert {x[-1] for x in got} == {True, False}


@pytest.mark.parametrize("bits", [12, 3])
def test_manifest_of_odd_rows(spark, monkeypatch, bits):
    """Sparse, negative, repeated and null ids, null and one-row groups, several passes in both trees, any number of directory levels."""
    monkeypatch.setattr(merkle, "NODE_BITS", bits)
    ids = [*range(600), -5, -(1 << 63), (1 << 63) - 1, 1 << 40, 70, 70, 70, None, None]
    rows = [{"doc_id": i, "text": f"T {i}" if k % 5 else None, "lang": None if k % 50 == 7 else "en", "source": "é" if k % 3 else None, "n_chars": k % 4} for k, i in enumerate(ids)]
    rows += [{"doc_id": i, "text": "", "lang": f"l{i}", "source": None, "n_chars": None} for i in range(70)] + [dict(rows[3]), dict(rows[3])]
    frame = spark.createDataFrame([(*[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")], "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, g string")
    crc = lambda r: r | ({} if r["doc_id"] is None else lowered(r))
    found = F.when(F.col("doc_id").isNull(), F.col("text")).otherwise(text_as_found())
    got = sorted(map(tuple, merkle.manifest(frame, found={"text": found}).collect()), key=repr)
    assert got == brute_manifest(rows, FIELDS, crc)


def test_paths_of_a_manifest_fold_to_its_root(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "a.b")
    rows = merkle.manifest(docs, group="a.b", fields=("doc_id", "a.b"), paths=True).collect()
    assert len(rows) == docs.count() and all(r.verified and merkle.folded(r.leaf, [(s.slot, s.siblings) for s in r.path]) == r.root for r in rows)
    assert {r.group for r in rows} == {r[0] for r in docs.select("`a.b`").distinct().collect()}
    assert merkle.manifest(docs.limit(0), group="a.b", fields=("doc_id",)).count() == 0
    single = merkle.manifest(docs.where("doc_id = 3"), group="a.b", fields=("doc_id",)).first()
    assert single.leaf == single.subroot == single.root == single.folded_root and single.proof_sha256 == H("")


# --- codes ---


def brute_codes(rows, k, rounds):
    """Codes, errors and codebooks by plain loops over all entries; rows (id, label, vector)."""
    v = {i: [int(np.floor(1024 * float(x))) for x in vec] for i, (_, _, vec) in enumerate(rows)}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))
    w = len(next(iter(v.values()))) // 4
    part = lambda i, p: v[i][p * w : p * w + w]
    books = [[part(i, p) for i in order[:k]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for t in range(rounds + 1):
        best = {(i, p): near(part(i, p), books[p]) for i in v for p in range(4)}
        if t < rounds:
            for p in range(4):
                for e in range(len(books[p])):
                    own = [part(i, p) for i in v if best[i, p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    error = {i: sum(best[i, p][0] for p in range(4)) for i in v}
    by = {}
    for i in v:
        by[rows[i][1]] = by.get(rows[i][1], 0) + error[i]
    out = [(rows[i][0], rows[i][1], "".join(f"{best[i, p][1]:02x}" for p in range(4)), error[i], by[rows[i][1]]) for i in v]
    return sorted(out, key=repr), H(",".join(str(x) for b in books for c in b for x in c))


@pytest.mark.parametrize(("entries", "block"), [(20, 16_384), (256, 50), (1, 7)])
def test_codes_equal_brute_force(spark, monkeypatch, entries, block):
    monkeypatch.setattr(vectorcodes, "BLOCK", block)
    rng = np.random.default_rng(entries)
    centres = rng.normal(0, 2, (9, 12))
    rows = [(int(i), None if i % 7 == 0 else int(i % 3), (centres[i % 9] + rng.normal(0, 0.05 if i % 2 else 0.6, 12)).round(3).tolist()) for i in rng.permutation(300)]
    rows += [(7, 1, rows[0][2]), (7, 1, rows[0][2]), (None, 2, [0.5] * 12), (-3, 1, [0.0] * 12), (-2, None, [-0.0005] * 12)]  # ties and repeats
    bad = [(900, 1, None), (901, 1, [None] * 12), (902, 1, [float("nan")] + [0.0] * 11), (903, 1, [float("inf")] * 12), (904, 1, [1.0] * 8), (-9, 1, []), (-10, 1, [1.0] * 7), (-11, 1, [1e30] * 12)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, label int, embedding array<double>, code string").repartition(3)
    coded, books = vectorcodes.compressed(frame, entries=entries)
    expected, sha = brute_codes(rows, entries, 4)
    assert sorted(map(tuple, coded.collect()), key=repr) == expected
    assert books.sha256() == sha
    back = np.array(books.decoded(expected[0][2]))
    assert back.shape == (12,)


def test_codes_of_no_and_large_vectors(spark):
    schema = "vec_id long, label string, embedding array<float>"
    none, books = vectorcodes.compressed(spark.createDataFrame([(1, "a", None), (2, None, [])], schema))
    assert none.collect() == [] and books.sha256() == H("")
    big = [(i, "a", [float(i * 1000), -float(i * 900), 3.0, 1.0]) for i in range(1, 60)]
    coded, books = vectorcodes.compressed(spark.createDataFrame(big, schema), entries=8)
    expected, sha = brute_codes(big, 8, 4)
    assert sorted(map(tuple, coded.collect()), key=repr) == expected and books.sha256() == sha


def test_balls_leave_out_only_what_is_farther():
    rng = np.random.default_rng(3)
    entries, x = rng.integers(-50, 50, (30, 5)), rng.integers(-60, 60, (500, 5))
    own, best = vectorcodes.assigned(x, None, vectorcodes.Balls(entries))
    moved = entries + rng.integers(-4, 5, entries.shape)
    reach = np.array([max([((a - moved[i]) ** 2).sum() for a in x[own == i]], default=-1) for i in range(30)])
    part = vectorcodes.balls(moved, reach)
    code, d = vectorcodes.assigned(x, own, part)
    full = vectorcodes.squared(x, moved)
    assert (code == full.argmin(1)).all() and (d == full.min(1)).all()
    assert sum(map(len, part.near)) < 30 * 29  # some entries are out of a ball's reach


def test_large_numbers_keep_their_exact_distances():
    x, c = np.array([[(1 << 27) - 1, -(1 << 27)]]), np.array([[-(1 << 27), 1 << 27]])
    assert vectorcodes.squared(x, c)[0, 0] == ((1 << 28) - 1) ** 2 + (1 << 28) ** 2


# --- clauses ---


def test_machines_compose():
    m = toxicity.grammar({"negated": -1.5, "reported": -1.0, "directed": 0.5})
    for words, marks, weight in (
        (["abuse"], ["insult"], 0.0), (["negation", "abuse"], ["insult negated"], -1.5), (["abuse", "negation"], ["insult"], 0.0),
        (["report", "target", "abuse"], ["insult reported directed"], -0.5), (["report", "negation", "abuse", "target"], ["insult negated reported"], -2.0),
        (["violence"], [], 0.0), (["intent", "violence", "target"], ["threat"], toxicity.THREAT + 0.5), (["negation", "intent", "violence"], ["threat negated"], toxicity.THREAT - 1.5),
    ):
        out, total = m.run(words)
        assert [x for x in out if x.startswith(toxicity.CORES)] == marks and total == pytest.approx(weight), words
    one, two = toxicity.threat_machine(), toxicity.context_machine("negation", "negated", -1.0, toxicity.CORES)
    both = one @ two
    rng = np.random.default_rng(1)
    for _ in range(200):  # running the composition is running one after the other
        words = rng.choice(["negation", "intent", "violence", "abuse", "report"], 8).tolist()
        middle, a = one.run(words)
        out, b = two.run(middle)
        assert both.run(words) == (out, pytest.approx(a + b))


def test_clauses_and_contexts_decide():
    model = toxicity.Toxicity({"idiot": 4.0, "stup": 3.0})
    weights = {t: [round(c[3], 2) for c in model.clauses(t)] for t in ("You IDIOT!", "An idiot.", "not an idiot, you", "she said idiot", "stupid$$$ idiots", "unidiotic", "I will kill you. Idiot", "kill", "")}
    assert weights == {"You IDIOT!": [4.5], "An idiot.": [4.0], "not an idiot, you": [2.5], "she said idiot": [3.0], "stupid$$$ idiots": [7.0], "unidiotic": [], "I will kill you. Idiot": [3.0, 4.0], "kill": [], "": []}
    assert [m for c in model.clauses("idiot you and kill") for m in c[2]] == ["insult directed"]
    assert model.clauses(None) == []


def planted(n, seed):
    rng = np.random.default_rng(seed)
    plain = ["ba", "ko", "lim", "dor", "sa", "tel", "mun", "ver"]
    word = lambda: "".join(rng.choice(plain, rng.integers(1, 4)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(20, 200)))]
        if i % 6 == 0:
            for at in rng.integers(0, len(words), max(2, len(words) // 40)):
                words[at] = str(rng.choice(["gnarf", "zwick" + word()]))
        texts.append(" ".join(words) + ".")
        labels.append(int(i % 6 == 0))
    return texts, labels


def test_stems_are_learned_and_held_out_texts_told():
    model = toxicity.train(*planted(600, 1))
    assert {"gnarf", "zwick"} <= set(model.stems)
    texts, labels = planted(300, 2)
    assert [int(s >= 0.3) for s in model.score(texts)] == labels
    repeats = ["blub " * 500 + "ba."] * 2 + ["ko sa."] * 40
    assert "blub" not in toxicity.train(repeats, [1] * 2 + [0] * 40).stems


def test_toxicity_of_odd_rows(spark):
    model = toxicity.train(*planted(200, 1))
    long = "word " * 200_000 + "gnarf"
    frame = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, long, 1.0), (3, long, 1.0), (None, "gnarf gnarf zwickba", 1.0)], "doc_id long, text string, `a.b` double")
    got = toxicity.with_toxicity(frame.withColumnRenamed("a.b", "toxicity_score"), model).collect()
    score = [r.toxicity_score for r in got]
    assert score[0] == score[1] < 0.3 < score[4] and score[2] == score[3] and all(0 <= s <= 1 for s in score)
    found = toxicity.matched_clauses(frame, model).collect()
    assert [(r.id, r.marks) for r in found if r.id is None] == [(None, "insult, insult, insult")] and len(found) == 3
    assert toxicity.with_toxicity(frame.limit(0).select("doc_id", "text"), model).count() == 0
    for texts, labels in (([], []), (["a"], [1]), ([None, ""], [0, 1])):
        assert all(0 <= s <= 1 for s in toxicity.train(texts, labels).score(["x", None]))


def test_labels_that_are_learned_from(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int").withColumn("text", F.lit(str(date(2024, 1, 1))))
    rows = toxicity.training_rows(docs, labels, 1000, 2).collect()
    assert {r.text for r in rows} == {f"t{i}" for i in range(40) if i != 3 and zlib.crc32(str(i).encode()) % 4 != 2}
    assert all(r.label == int(r.text[1:]) % 2 for r in rows) and len(toxicity.training_rows(docs, labels, 7, 2).collect()) == 7


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.with_toxicity(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).collect()
    held = [(r.toxicity_score >= 0.3, truth[r.doc_id]) for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held) and sum(p for p, y in held if not y) <= 0.03 * len(held)


# --- column names ---


def test_names_with_dots(spark):
    from intentloom.llm import langid, quality, shingles, simhash, substring

    rows = [(1, "one line of words.\nand another one of them", 1.0), (2, None, 2.0), (3, "one line of words.\nand another one of them", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` double")
    plain = lambda f, drop=(): sorted(repr(tuple(r)) for r in f.drop(*drop).collect())
    model, field, net = toxicity.train(*planted(60, 1)), quality.train(["a b", "| |"], [1, 0]), langid.train(["one line", "und nicht"], ["en", "de"])
    for call in (
        lambda d: toxicity.with_toxicity(d, model), lambda d: quality.with_quality(d, field), lambda d: langid.with_language(d, net), lambda d: simhash.with_fingerprints(d), lambda d: simhash.near_duplicates(d),
        lambda d: shingles.one_of_each(d), lambda d: simhash.one_of_each(d), lambda d: substring.without_repeats(d, width=8),
    ):
        got, same = call(docs), call(docs.withColumnRenamed("a.b", "ab"))
        assert got.columns == [c.replace("ab", "a.b") if c == "ab" else c for c in same.columns] and plain(got) == plain(same)


def test_a_band_of_many_unlike_members_is_split(spark, monkeypatch):
    """One very common shingle set of minima: pairs are compared in parts, and none is lost."""
    from intentloom.llm import shingles

    monkeypatch.setattr(shingles, "PART", 16)
    n = 200
    words = lambda i, k: " ".join(["same"] * 1 + [f"w{i}x{j}" for j in range(30 + k)])
    rows = [(2 * i, words(i, 0)) for i in range(n)] + [(2 * i + 1, words(i, 1)) for i in range(n)]
    real = shingles._features

    def crowded(s):
        node, size, print_, parity, keys = real(s)
        return node, size, print_, parity, np.append(keys, np.int64(7))  # all share a bucket

    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    feats = []
    import pyarrow as pa

    for s, (i, _) in zip(shingles.shingle_sets(pa.array([t for _, t in rows]), 5), rows, strict=True):
        node, size, print_, parity, keys = crowded(s)
        feats.append((node, size, print_, *parity.tolist(), keys.tolist(), i, s.astype(np.uint64).tobytes()))
    frame = spark.createDataFrame(feats, "node long, size long, print long, m0 long, m1 long, m2 long, m3 long, keys array<long>, i long, shingles binary")
    edges = shingles.links(frame.drop("i", "shingles"), lambda wanted: wanted.join(frame.select("node", "shingles"), "node"), 0.8)
    by = {r.node: r.i for r in frame.collect()}
    low = {i: i for i in by.values()}
    for r in edges.collect():
        a, b = sorted((by[r.a], by[r.b]))
        assert b == a + 1 and a % 2 == 0
        low[b] = a
    assert all(low[2 * i + 1] == 2 * i for i in range(n)) and docs.count() == 2 * n


def test_index_proposes_a_row_per_fingerprint(spark, monkeypatch):
    """A group of SimHashes that are all linked to each other brings the join one row each, not one per pair; before, it brought 780 for 40."""
    base, seen, real = np.uint64(0x5555_0F0F_3333_00FF), [], shingles.common.stored
    prints = [int(x) for x in np.array([base ^ np.uint64((1 << i) | (1 << j)) for i in range(8) for j in range(i + 1, 8)] + [base ^ np.uint64(1 << i) for i in range(12)], np.uint64).view(np.int64)]
    monkeypatch.setattr(shingles.common, "stored", lambda df, what, *a: seen.append((what, real(df, what, *a))) or seen[-1][1])
    rows = [(i + 1, 9, p, 0, 0, 0, 0, [1000 + i]) for i, p in enumerate(prints)]
    frame = spark.createDataFrame(rows, shingles._FEATURES)
    sets = spark.createDataFrame([(i + 1, np.arange(1, 10, dtype=np.uint64).tobytes()) for i in range(len(prints))], "node long, shingles binary")
    edges = shingles.links(frame, lambda wanted: wanted.join(sets, "node"), 0.8).collect()
    alike = dict(seen)["alike"].count()
    assert alike == len(prints) - 1 and {r.b for r in edges} | {r.a for r in edges} == set(range(1, len(prints) + 1))


@pytest.mark.parametrize("least", [0.8, None])
def test_texts_stay_where_they_are_stored(spark, monkeypatch, least):
    """The surviving rows' numbers come to the texts, even if they are too many to be broadcast; before, such a join moved all whole rows."""
    monkeypatch.setattr(common, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(shingles, "BROADCAST_ROWS", 0)
    rows = [(i, " ".join(f"w{i // 2 * 31 + j}" for j in range(20)), "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(3)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = simhash.one_of_each(docs, width=5, least=least)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in found.collect()) == list(range(0, 60, 2)) and found.columns == docs.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    above, scan = plan.split("LeftSemi", 1)[1].split("FileScan", 1)
    assert "Exchange" not in above and "Bucketed: true" in scan.splitlines()[0], plan
