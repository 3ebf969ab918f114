"""Toxicity by a weighted grammar: transducers over the words of a clause, composed into one, score clauses, and matched clauses score the text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.llm import common

# Closed classes of words in four languages, and insults that need no example.
TARGETS = "you your yours yourself u ur tu toi te vous votre vos ton du dich dir dein deine ihr euch euer usted ustedes vosotros contigo tus".split()
NEGATIONS = "not no never nor cannot without ne pas jamais aucun sans nicht kein keine keinen nie niemals ohne nunca jamás tampoco sin".split()
REPORTS = "said says say saying called calls wrote writes quoted claimed dit disait écrit appelé citait sagte sagt schrieb nannte zitierte dijo dice escribió llamó citó".split()
INTENTS = "will shall gonna going ll vais vas allons werde werden wird voy vamos va".split()
VIOLENCE = "kill hurt destroy murder shoot stab burn tuer frapper détruire brûler töten schlagen verbrennen matar golpear destruir quemar".split()
INSULTS = "idiot moron imbecile scum filth imbécile crétin ordure dummkopf abschaum vollidiot imbécil basura escoria".split()
#: Weights of contexts before any are learned, of a threat, and of an insult that was not learned from labels.
CONTEXTS = {"negated": -1.5, "reported": -1.0, "directed": 0.5}
THREAT, SEED = 2.5, 2.0
#: Letters of a stem, fewest documents that show it, least odds and likelihood ratio, occurrences of one word that count in a document.
STEM, SHOWN, ODDS, SURE, COUNTED = (3, 14), 3, 6.0, 24.0, 2
#: Bytes of the longest text to learn from.
LONGEST = 65_536

_WORD, _BREAK = re.compile(r"[^\W\d_]+"), re.compile(r"[.,;:!?|()\[\]\"\n\r]+")
CORES = ("insult", "threat")


@dataclass
class Transducer:
    """A sequential weighted transducer: arcs (state, symbol) -> (state, symbol, weight). Without an arc the symbol passes and the state stays."""

    arcs: dict[tuple, tuple] = field(default_factory=dict)
    start: tuple = ("",)

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def symbols(self) -> set[str]:
        return {s for _, s in self.arcs} | {o for _, o, _ in self.arcs.values()}

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out is read by the other; weights add up. States are pairs, made as they are reached."""
        out, alphabet = Transducer(start=self.start + other.start), self.symbols() | other.symbols()
        todo = [(self.start, other.start)]
        seen = set(todo)
        while todo:
            a, b = todo.pop()
            for symbol in alphabet:
                a2, middle, w = self.step(a, symbol)
                b2, end, v = other.step(b, middle)
                if (a2 + b2, end, w + v) != (a + b, symbol, 0.0):
                    out.arcs[a + b, symbol] = (a2 + b2, end, w + v)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return out

    def run(self, symbols: Sequence[str]) -> tuple[list[str], float]:
        state, total, out = self.start, 0.0, []
        for s in symbols:
            state, put, w = self.step(state, s)
            total += w
            out.append(put)
        return out, total


def insult_machine() -> Transducer:
    """An insulting word is a core."""
    return Transducer({(("",), "abuse"): (("",), "insult", 0.0)})


def threat_machine() -> Transducer:
    """A violent verb after a word of intent is a core; alone it is a word like others."""
    on, off = ("intent",), ("",)
    return Transducer({(off, "intent"): (on, "word", 0.0), (on, "intent"): (on, "word", 0.0), (on, "violence"): (off, "threat", THREAT), (off, "violence"): (off, "word", 0.0)})


def context_machine(sign: str, name: str, weight: float, marks: Sequence[str]) -> Transducer:
    """After the sign, cores of the clause are marked by the context's name and weigh that much more or less."""
    on, off = (name,), ("",)
    arcs = {(off, sign): (on, "word", 0.0), (on, sign): (on, "word", 0.0)}
    return Transducer(arcs | {(on, m): (on, f"{m} {name}", weight) for m in marks})


def target_machine(weight: float, marks: Sequence[str]) -> Transducer:
    """A core and a target in one clause, in either order, weigh more, once."""
    off, target, core, both = ("",), ("target",), ("core",), ("both",)
    arcs = {(off, "target"): (target, "word", 0.0), (target, "target"): (target, "word", 0.0), (core, "target"): (both, "directed", weight), (both, "target"): (both, "word", 0.0)}
    for m in marks:
        arcs |= {(off, m): (core, m, 0.0), (target, m): (both, f"{m} directed", weight)}
    return Transducer(arcs)


def grammar(contexts: dict[str, float]) -> Transducer:
    """Insults and threats, then negation, reported speech and target, as one transducer from classes of words to marked cores."""
    negated = [*CORES, *[f"{c} negated" for c in CORES]]
    reported = [*negated, *[f"{c} reported" for c in negated]]
    return (
        insult_machine() @ threat_machine() @ context_machine("negation", "negated", contexts["negated"], CORES)
        @ context_machine("report", "reported", contexts["reported"], negated) @ target_machine(contexts["directed"], reported)
    )


_CLOSED = {w: c for c, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("intent", INTENTS), ("violence", VIOLENCE)) for w in words}


@dataclass
class Toxicity:
    """A trained grammar: weights of stems and contexts, and the logistic function of a text's evidence."""

    stems: dict[str, float]
    contexts: dict[str, float] = field(default_factory=lambda: dict(CONTEXTS))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(3))
    scale: np.ndarray = field(default_factory=lambda: np.ones(3))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def _tools(self):
        if "_machine" not in self.__dict__:
            self._machine, self._automaton = grammar(self.contexts), ahocorasick.Automaton()
            for word in {*self.stems, *VIOLENCE}:
                self._automaton.add_word(word, len(word))
            self._automaton.make_automaton()
        return self._machine, self._automaton

    def clauses(self, text: str | None) -> list[tuple[int, int, list[str], float]]:
        """Clauses with a core: begin, end (places in the lower-cased text), the marks of their cores, weight (0 at least).

        A clause ends at punctuation or a line's end. A word is abuse by the longest stem that it begins with. Only clauses with a stem or a violent verb are read by words.
        """
        if not text:
            return []
        machine, automaton = self._tools()
        text = text.lower()
        starts = {}
        for last, size in automaton.iter(text):
            at = last - size + 1
            if at == 0 or not text[at - 1].isalpha():
                starts[at] = max(size, starts.get(at, 0))
        out, end = [], 0
        for at in sorted(starts):
            if at < end:
                continue
            begin = end
            for m in _BREAK.finditer(text, end, at):
                begin = m.end()
            stop = _BREAK.search(text, at)
            end = stop.start() if stop else len(text)
            classes, weight = [], 0.0
            for m in _WORD.finditer(text, begin, end):
                kind = _CLOSED.get(m[0])
                stem = text[m.start() : m.start() + starts[m.start()]] if m.start() in starts else None
                if stem in self.stems:
                    classes.append("abuse")
                    weight += self.stems[stem]
                elif kind:
                    classes.append(kind)
            marks, extra = machine.run(classes)
            found = [m for m in marks if m.startswith(CORES)]
            if found:
                directed = "directed" in marks
                out.append((begin, end, [f"{m} directed" if directed and "directed" not in m else m for m in found], max(0.0, weight + extra)))
        return out

    def evidence(self, text: str | None) -> list[float]:
        """The weight of all matched clauses (its logarithm), the text's words (their logarithm), and the weight in 50 words."""
        total, words = sum(c[3] for c in self.clauses(text)), len(text.split()) if text else 0
        return [math.log1p(total), math.log(words + 10), 50 * total / (words + 30)]

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = (np.array([self.evidence(t) for t in texts], np.float64).reshape(-1, 3) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:3] + self.weights[3], -30, 30)))


def learned_stems(texts: list[str | None], labels: list[int]) -> dict[str, float]:
    """Beginnings of words that toxic texts have more often, with their logarithmic odds; of nested ones those that tell most, and shorter ones for what is left.

    A document counts a word COUNTED times at most, so one text with a thousand of it shows no more than another. Stems need SHOWN toxic documents, odds of
    ODDS and a likelihood ratio of SURE. The INSULTS are there from the start.
    """
    seen: dict[str, list[int]] = {}
    total = [1.0, 1.0]
    least, most = STEM
    for label in (1, 0):
        for text, y in zip(texts, labels, strict=True):
            if y != label or not text:
                continue
            words = {w: min(n, COUNTED) for w, n in Counter(w for w in _WORD.findall(text.lower()) if len(w) >= least).items()}
            total[label] += sum(words.values())
            found: Counter[str] = Counter()
            for w, n in words.items():
                for k in range(least, min(most, len(w)) + 1):
                    found[w[:k]] += n
            for stem, n in found.items():
                if label:
                    at = seen.setdefault(stem, [0, 0, 0])
                    at[1] += n
                    at[2] += 1
                elif stem in seen:
                    seen[stem][0] += n
        if label:
            seen = {s: v for s, v in seen.items() if v[2] >= SHOWN}

    def told(v: list[int]) -> tuple[float, float]:
        bad, good = v[1], v[0]
        odds = (bad + 0.5) / total[1] / ((good + 0.5) / total[0])
        even = (bad + good) / (total[0] + total[1])
        ratio = 2 * sum(n * math.log(n / (even * size)) for n, size in ((bad, total[1]), (good, total[0])) if n)
        return odds, ratio

    out: dict[str, float] = {}
    seen = {s: v for s, v in seen.items() if told(v)[0] >= ODDS and told(v)[1] >= SURE}
    while seen:
        best = max(seen, key=lambda s: (round(told(seen[s])[1], 6), len(s), s))
        out[best] = min(5.0, math.log(told(seen[best])[0]))
        bad, good = seen[best][1], seen[best][0]
        rest = {}
        for s, v in seen.items():
            if s.startswith(best):
                continue
            if best.startswith(s):
                v = [max(0, v[0] - good), max(0, v[1] - bad), v[2]]
            if told(v)[0] >= ODDS and told(v)[1] >= SURE:
                rest[s] = v
        seen = rest
    for word in INSULTS:
        if not any(word.startswith(s) for s in out):
            out[word] = SEED
    return out


def learned_contexts(model: Toxicity, texts: list[str | None], labels: list[int], trust: float = 20.0) -> dict[str, float]:
    """Weights of contexts: how the odds of a toxic text differ for clauses in them, drawn to CONTEXTS as strongly as `trust` clauses would."""
    counts = {k: [0.5, 0.5] for k in ("", *CONTEXTS)}
    for text, y in zip(texts, labels, strict=True):
        for _, _, marks, _ in model.clauses(text):
            kinds = {k for k in CONTEXTS if any(k in m for m in marks)}
            for k in kinds or {""}:
                counts[k][int(y)] += 1
    plain = math.log(counts[""][1] / counts[""][0])
    out = {}
    for k, usual in CONTEXTS.items():
        n = sum(counts[k]) - 1
        seen = min(2.0, max(-3.0, math.log(counts[k][1] / counts[k][0]) - plain))
        out[k] = (n * seen + trust * usual) / (n + trust)
    return out


def train(texts: list[str | None], labels: list[int]) -> Toxicity:
    """Stems, contexts and the logistic function of evidence, by Newton steps with a ridge. Labels of one kind only, or none, give a constant score."""
    y = np.asarray(labels, np.float64)
    prior = float((y.sum() + 1) / (len(y) + 2))
    if len(set(labels)) < 2:
        return Toxicity({w: SEED for w in INSULTS}, weights=np.array([0.0, 0.0, 0.0, math.log(prior / (1 - prior))]))
    model = Toxicity(learned_stems(texts, labels))
    model = Toxicity(model.stems, learned_contexts(model, texts, labels))
    x = np.array([model.evidence(t) for t in texts])
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))])
    w, ridge = np.array([0.0, 0.0, 0.0, math.log(prior / (1 - prior))]), np.array([0.3, 0.3, 0.3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge)
        move = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w = w - move * min(1.0, 3 / max(1e-9, np.abs(move).max()))
    model.weights = w
    return model


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, hidden: int, modulus: int = 4) -> DataFrame:
    """At most `rows` labelled documents (text, label) of LONGEST bytes at most outside the held-out part, a fixed pseudo-random choice of
    them: that is the bound in rows and bytes of what the driver reads.

    Labels that are null or contradict each other for an id are left out, and so are null ids; a repeated id counts once per row. Ties
    of the hash fall to id and text. Null and empty texts may be chosen. Without labelled documents there are no rows. Other columns don't matter.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("label"))
    known = known.where("low = label").select("doc_id", "label").where(common.remainder(F.col("doc_id"), modulus) != hidden)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    return short.join(F.broadcast(chosen), "doc_id").select("text", "label").orderBy(F.xxhash64("text"), "text", "label").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, hidden: int = 2) -> Toxicity:
    """A grammar trained on at most `rows` labelled documents (the bounded sample, see training_rows) whose id is not held out."""
    sample = training_rows(docs, labels, rows, hidden).toPandas()
    return train([t if isinstance(t, str) else None for t in sample["text"]], sample["label"].tolist())


def _scored(batches: Iterator[pa.RecordBatch], model: Toxicity, text: str, out: str) -> Iterator[pa.RecordBatch]:
    for batch in common.small_batches(batches, text):
        yield common.with_columns(batch, **{out: pa.array(model.score(batch.column(text).to_pylist()))})


def with_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", out: str = "toxicity_score") -> DataFrame:
    """`docs` with the toxicity of each whole text (0 to 1) in column `out`, replacing a column of that name. Texts that are null, empty or without a
    matched clause have the score of no evidence. Other columns and repeated rows pass through; an empty table stays empty."""
    return common.mapped(docs.drop(out), partial(_scored, model=model, out=out), text, T.StructField(out, T.DoubleType()))


def _matched(batches: Iterator[pa.RecordBatch], model: Toxicity) -> Iterator[pa.RecordBatch]:
    for batch in common.small_batches(batches, "text"):
        which, found = [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            for begin, end, marks, weight in model.clauses(t):
                which.append(i)
                found.append((t.lower()[begin:end].strip(), ", ".join(marks), weight))
        clause, marks, weight = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which, pa.int64())), pa.array(clause, pa.string()), pa.array(marks, pa.string()), pa.array(weight, pa.float64())], names=["id", "clause", "marks", "weight"])


def matched_clauses(docs: DataFrame, model: Toxicity, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per matched clause: id, clause (lower-cased), marks (its cores with their contexts), weight. Nulls and empty texts have none."""
    rows = docs.select(common.column(doc_id).alias("id"), common.column(text).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("clause", T.StringType()), T.StructField("marks", T.StringType()), T.StructField("weight", T.DoubleType())])
    return rows.mapInArrow(partial(_matched, model=model), schema)


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = F.col("toxicity_score")
    return with_toxicity(docs, model).select(
        "doc_id", (common.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted")
    )
