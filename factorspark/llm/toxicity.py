"""Toxicity scores by a weighted finite-state pattern grammar (operator 10).

Over each clause (text between sentence marks, line ends or semicolons) run five transducers, composed into one
table beforehand (`compose`). The lexicon writes the class of each word: insult, suspect, verb of violence, intent,
target, negation or report; other words write nothing. Then

* `negation` marks insults and verbs that stand after a negation in the clause;
* `threat` makes a threat of a verb after an intent, and drops other verbs;
* `target` makes insults aimed if the clause names a target, before or after them, and drops threats without one;
* `report` makes all of a clause reported that reports speech, before or after.

What comes out is plain, aimed, negated, reported, threat or suspect. Insults are learned: words and word beginnings
that labelled toxic documents have and clean ones do not. Learned too are suspects: beginnings that go on in many
ways and that toxic documents have far more often than clean ones, so that one proves little and several prove much;
negated or reported ones are passed over. The arcs of a last machine, which tallies each symbol over the document,
carry the weights: the first three occurrences add one, those of suspects the second, third and fourth. The weights
are fitted to the labels by logistic regression with a prior that holds aimed insults and threats to be worse and
negated and reported ones to be milder than plain ones.

Only matched clauses count: a document without a match gets the intercept's score, which is low. NULL and
empty texts have no clause. Rows are scored one by one, also where they share an id or have none (which is not held
out); other columns are dropped. Labels come from rows with crc32(id) mod 3 <> 1, at most `most` ids, chosen by a hash
of the id, one row each; label, language, source and id are no inputs of a score. What is learned on the driver, the
lexicon, is bounded by that sample; without labels it is empty.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .quality_rules import labelled_sample

# The closed classes of the lexicon.
TARGETS = frozenset("you your yours yourself u ur he she they him her them du dich dein deine ihr euch tu toi te vous ton ta tes tú te ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never isn't aren't don't wasn't nicht kein keine nie pas jamais nunca".split())
REPORTS = frozenset("said says say quoted quote called calls claimed claims wrote reported according sagte sagt nannte dit disait écrit dijo dice llamó".split())
VERBS = frozenset("kill hurt destroy beat punish töten schlagen verletzen tuer frapper matar golpear".split())
INTENTS = frozenset("will gonna shall must werde werden vais va voy vamos".split())
SYMBOLS = ("plain", "aimed", "negated", "reported", "threat", "suspect")
STEPS = (2, 3, 4)
PRIOR = np.array([3.0, 4.0, 2.0, 2.0, 3.0, 2.0, 2.0, 2.0])

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE_MARKS = ".!?;\n"
_CLAUSE_END = re.compile(f"[{CLAUSE_MARKS}]")
_VERB = re.compile("|".join(sorted(VERBS)))
SHORTEST, LONGEST = 4, 8
#: Contexts and words are counted in 64 bits, so no more of them are asked for than those can tell apart.
MOST_WAYS = 32


def _entries(word: str) -> list[str]:
    """The whole word (`=word`) and its beginnings."""
    return ["=" + word, *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per entry: toxic and clean documents, and in toxic ones a bit for each context (the words around) and one
    for each whole word."""
    clean: Counter = Counter()
    toxic: Counter = Counter()
    contexts: dict[str, int] = {}
    ways: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        names = list(clean.keys() | toxic.keys())
        bits = [pa.array([b - (1 << 64) if b >> 63 else b for b in (held.get(n, 0) for n in names)], pa.int64()) for held in (contexts, ways)]
        batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in (toxic, clean)], *bits], names=["entry", "toxic", "clean", "contexts", "ways"])
        for c in (clean, toxic, contexts, ways):
            c.clear()
        return batch

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = _WORD.findall((text or "").lower())
            if label != 1:
                clean.update({e for w in set(words) for e in _entries(w)})
            else:
                toxic.update({e for w in set(words) for e in _entries(w)})
                for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    bit = 1 << (zlib.crc32(f"{before} {after}".encode()) & 63)
                    way = 1 << (zlib.crc32(word.encode()) & 63)
                    for e in _entries(word):
                        contexts[e] = contexts.get(e, 0) | bit
                        ways[e] = ways.get(e, 0) | way
            if len(clean) + len(toxic) > 300_000:
                yield rows()
    yield rows()


def choose_entries(pure: list[tuple[str, int]], mixed: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """Insults among the pure entries and suspects among the mixed beginnings, both (entry, toxic documents).

    Insults are a word where one word makes up most of a beginning's documents, else the longest beginning
    that keeps nearly all documents of the shorter one; suspects are such beginnings without a word that
    makes up most of them, and take in what lies under them.
    """
    words = {e[1:]: t for e, t in pure if e[0] == "="}
    stems = {e: t for e, t in pure if e[0] != "="}
    loose = dict(mixed)
    begins = loose | stems
    insults: dict[str, None] = {}
    done: set[str] = set()
    for word, n in sorted(words.items()):
        beginnings = [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)]
        # a word of its own, unless its beginning goes on in many other ways
        if all(n >= 0.5 * begins.get(b, 0) for b in beginnings):
            insults["=" + word] = None
            done.update(beginnings)

    def longest(stem: str, among: dict[str, int], longer: dict[str, list[str]]) -> str:
        n = among[stem]
        while following := [s for s in longer.get(stem, ()) if among[s] >= 0.9 * n]:
            stem = following[0]
        return stem

    def chosen_from(among: dict[str, int], *others: dict[str, None]) -> dict[str, None]:
        own: dict[str, None] = {}
        longer: dict[str, list[str]] = {}
        for s in among:
            longer.setdefault(s[:-1], []).append(s)
        for stem in sorted(among, key=lambda s: (len(s), s)):
            if stem not in done and not any(stem[:k] in held for held in (own, *others) for k in range(SHORTEST, len(stem) + 1)):
                best = longest(stem, among, longer)
                if best not in done:
                    own[best] = None
        return own

    suspects = chosen_from(loose)
    chosen = chosen_from(stems, suspects)
    return [*insults, *chosen], list(suspects)


END = "end"
CLASSES = ("insult", "suspect", "verb", "intent", "target", "negation", "report", END)
Arcs = dict[tuple[int, str], tuple[int, tuple[str, ...]]]


@dataclass
class Transducer:
    """A deterministic transducer from state 0: `arcs` has the next state and the output for a state and a symbol;
    a symbol without an arc is copied and leaves the state as it is."""

    arcs: Arcs

    def step(self, state: int, symbol: str) -> tuple[int, tuple[str, ...]]:
        return self.arcs.get((state, symbol), (state, (symbol,)))

    def run(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for symbol in symbols:
            state, written = self.step(state, symbol)
            out += written
        return out


def compose(first: Transducer, second: Transducer, alphabet: tuple[str, ...] = CLASSES) -> Transducer:
    """The transducer that gives what `second` makes of the output of `first`; its states are the reachable pairs."""
    number, arcs = {(0, 0): 0}, {}
    pairs = [(0, 0)]
    for pair in pairs:
        for symbol in alphabet:
            a, written = first.step(pair[0], symbol)
            b, out = pair[1], ()
            for middle in written:
                b, more = second.step(b, middle)
                out += more
            if (a, b) not in number:
                number[a, b] = len(number)
                pairs.append((a, b))
            arcs[number[pair], symbol] = (number[a, b], out)
    return Transducer(arcs)


def negation() -> Transducer:
    """State 1: a negation stands before."""
    arcs: Arcs = {(k, "negation"): (1, ()) for k in (0, 1)}
    return Transducer(arcs | {(1, "insult"): (1, ("negated",)), (1, "verb"): (1, ("no verb",)), (1, "suspect"): (1, ()), (1, END): (0, (END,))})


def threat() -> Transducer:
    """State 1: an intent stands before."""
    arcs: Arcs = {(k, "intent"): (1, ()) for k in (0, 1)} | {(0, v): (0, ()) for v in ("verb", "no verb")}
    return Transducer(arcs | {(1, "verb"): (1, ("threat",)), (1, "no verb"): (1, ("no threat",)), (1, END): (0, (END,))})


def _held(caps: dict[str, int], flushed: dict[str, str], at_end: dict[str, str], then: Arcs, turn: str, seen: int = 0) -> Transducer:
    """Holds back symbols, up to `caps` of each, until `turn`, where they are written as `flushed` has it and the arcs
    `then` of state `seen` go on, or until the clause ends, where they are written as `at_end` has it."""
    names = list(caps)
    counts = list(itertools.product(*(range(caps[n] + 1) for n in names)))
    number = {c: k + (k > 0) for k, c in enumerate(counts)}  # state 1 is left for what comes after `turn`
    write = lambda c, to: tuple(to[n] for n, k in zip(names, c, strict=True) if n in to for _ in range(k))
    arcs: Arcs = dict(then)
    for c, state in number.items():
        arcs[state, turn] = (1, write(c, flushed))
        arcs[state, END] = (0, (*write(c, at_end), END))
        for j, n in enumerate(names):
            more = tuple(min(caps[n], k + (i == j)) for i, k in enumerate(c))
            arcs[state, n] = (number[more], ())
    arcs[1, turn] = (1, ())
    arcs[1, END] = (0, (END,))
    return Transducer(arcs)


def target() -> Transducer:
    """State 1: the clause has named a target; before, insults and threats are held back."""
    aimed = {"insult": "aimed", "threat": "threat", "no threat": "negated"}
    return _held(dict.fromkeys(aimed, 3), aimed, {"insult": "plain"}, {(1, a): (1, (b,)) for a, b in aimed.items()}, "target")


def report() -> Transducer:
    """State 1: the clause has reported speech; before, all is held back."""
    said = dict.fromkeys(("plain", "aimed", "negated", "threat"), "reported")
    after: Arcs = {(1, a): (1, (b,)) for a, b in said.items()} | {(1, "suspect"): (1, ())}
    caps = dict.fromkeys(said, 3) | {"suspect": max(STEPS)}
    return _held(caps, said, {n: n for n in caps}, after, "report")


def machine() -> Transducer:
    """The composed transducers."""
    return compose(compose(compose(negation(), threat()), target()), report())


class Grammar:
    """The lexicon and the composed machine: from a text to the number of each output symbol."""

    def __init__(self, entries: list[str], suspects: list[str] | None = None):
        self.suspects = frozenset(suspects or ())
        self.begins = sorted({len(s) for s in self.suspects})
        self.words = frozenset(e[1:] for e in entries if e[0] == "=")
        self.stems = frozenset(e for e in entries if e[0] != "=")
        self.lengths = sorted({len(s) for s in self.stems})
        parts = sorted({e.lstrip("=") for e in entries} | self.suspects | VERBS, key=lambda s: (-len(s), s))
        self.hint = re.compile("|".join(map(re.escape, parts)))
        self.closed = {w: name for name, words in (("verb", VERBS), ("target", TARGETS), ("intent", INTENTS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}
        self.arcs = machine().arcs

    def word_class(self, word: str) -> str | None:
        """The lexicon transducer, of one state."""
        found = self.closed.get(word)
        if found is None or found == "verb":
            if word in self.words or any(word[:n] in self.stems for n in self.lengths):
                return "insult"
            if found is None and any(word[:n] in self.suspects for n in self.begins):
                return "suspect"
        return found

    def clause(self, words: list[str]) -> Counter:
        """One pass of the machine over a clause."""
        state, out, arcs = 0, Counter(), self.arcs
        for word in words:
            if symbol := self.word_class(word):
                state, written = arcs[state, symbol]
                out.update(written)
        out.update(arcs[state, END][1][:-1])
        return out

    def symbols(self, text: str) -> list[int]:
        """How often each of SYMBOLS is written; clauses without a hint of the lexicon are passed over."""
        low, at, total = text.lower(), 0, Counter()
        while hit := self.hint.search(low, at):
            start = max(at, *(low.rfind(mark, at, hit.start()) + 1 for mark in CLAUSE_MARKS))
            end = _CLAUSE_END.search(low, hit.end())
            at = end.end() if end else len(low)
            total += self.clause(_WORD.findall(low, start, at))
        return [total[s] for s in SYMBOLS]


def _features(counts: np.ndarray) -> np.ndarray:
    """Each symbol's number, up to 3; for suspects, the last, whether each of STEPS is reached."""
    return np.column_stack((np.minimum(counts[:, :-1], 3), counts[:, -1:] >= np.array(STEPS))).astype(float)


def fit(counts: np.ndarray, label: np.ndarray, steps: int = 200) -> tuple[float, np.ndarray]:
    """Intercept and weights at the posterior's maximum, by Newton steps on at most the sample's rows."""
    x = np.column_stack((np.ones(len(counts)), _features(counts)))
    mean, strength = np.concatenate(([-2.0], PRIOR)), np.array([0.01, *[2.0] * len(PRIOR)])
    strength[-len(STEPS) :] = 0.5
    w = mean.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (label - p) - strength * (w - mean)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(strength), gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def _symbols(grammar):
    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                count = [grammar.value.symbols(t) if t else [0] * len(SYMBOLS) for t in part.column("text").to_pylist()]
                names = part.schema.names[:-1]  # the text is last
                yield pa.RecordBatch.from_arrays([*map(part.column, names), *[pa.array([c[k] for c in count], pa.int64()) for k in range(len(SYMBOLS))]], names=[*names, *SYMBOLS])

    return symbols


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = 15_000, chance: float = 5e-6, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """Per document: doc_id, `key_col` (a long, if given), held_out, score, and the number of each output symbol.

    A lexicon entry needs so many toxic documents that chance alone, at the labels' share of toxic ones,
    would give it with a probability under `chance`, as many different contexts (so that copies of one
    document do not add up; MOST_WAYS at most), and at least 20 toxic documents for each clean one. A suspect needs that many too,
    as many different words that begin with it, four times the labels' odds of toxic to clean documents, and that chance would give its share of toxic
    documents with a probability under `chance` (Chernoff's bound).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = labelled_sample(texts, labels.where(~held_out()), "toxic", most).select("doc_id", "text", "label")
    counts = sample.mapInArrow(_count, "entry string, toxic long, clean long, contexts long, ways long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_count(F.bit_or("contexts")).alias("contexts"), F.bit_count(F.bit_or("ways")).alias("ways"))
    share = sample.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0] or 0.0
    support = max(4, math.ceil(math.log(chance) / math.log(min(max(share, 1e-6), 0.9))))
    toxic, clean, usual = F.col("toxic").cast("double"), F.col("clean").cast("double"), min(max(share, 1e-6), 1 - 1e-6)
    surprise = toxic * F.log(toxic / ((toxic + clean) * usual)) + F.when(clean > 0, clean * F.log(clean / ((toxic + clean) * (1 - usual)))).otherwise(0.0)
    ways = min(support, MOST_WAYS)
    strong = toxic >= 20 * clean
    weak = (F.col("ways") >= ways) & (toxic * (1 - usual) >= 4 * usual * clean) & (surprise >= -math.log(chance))
    kinds = counts.where((F.col("toxic") >= support) & (F.col("contexts") >= ways)).where(strong | weak).select("entry", "toxic", strong.alias("strong"))
    found = kinds.collect()  # entries of the sample, which is bounded
    entries, suspects = choose_entries([(r.entry, r.toxic) for r in found if r.strong], [(r.entry, r.toxic) for r in found if not r.strong])
    grammar = spark.sparkContext.broadcast(Grammar(entries, suspects))
    schema = "doc_id long, " + ", ".join(f"{s} long" for s in SYMBOLS)
    rows = sample.select("doc_id", "text").mapInArrow(_symbols(grammar), schema).join(sample.select("doc_id", "label"), "doc_id").toPandas()
    rows = rows.sort_values(list(rows.columns))
    intercept, weights = fit(rows[list(SYMBOLS)].to_numpy().reshape(-1, len(SYMBOLS)), rows["label"].to_numpy(float))
    total = F.lit(intercept)
    numbers = [F.least(F.col(s), F.lit(3)) for s in SYMBOLS[:-1]] + [(F.col(SYMBOLS[-1]) >= n).cast("int") for n in STEPS]
    for number, weight in zip(numbers, weights.tolist(), strict=True):
        total = total + F.lit(weight) * number
    keys = [key_col] if key_col else []
    rows = docs.select(*keys, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_symbols(grammar), "".join(f"`{k}` long, " for k in keys) + schema)
    return scored.select("doc_id", *keys, F.coalesce(held_out(), F.lit(False)).alias("held_out"), (1 / (1 + F.exp(-total))).alias("score"), *SYMBOLS)
