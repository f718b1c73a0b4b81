"""BPE encoding and decoding by a token automaton (operator 1).

The merges are compiled into a deterministic automaton over tokens, one gadget per merge. It starts with
one state that every byte token leads back to. The gadget of merge (u, v) -> w copies the state that u
leads to, takes the transition on v out of the copy, leads u there, and lets w lead where v led, from every
state that could read u then v. A sequence of tokens is accepted exactly if it is what the merges make of
its bytes.

A copy differs from its original by one transition, so the transition table is kept as those differences:
`state` (where a token leads), `removed` (which copy took a transition out), `owner`, `base` and `first` (the
run of copies that a state ends, and the state before it), `born` and `left` (when and from what a token's
transitions came). `step` looks a transition up there, in a few steps, and the transitions that occur are
remembered.

A word is encoded in one pass without a step back: every prefix of it has exactly one accepted sequence, so
a place in the word has one state. At each place the tokens that end there are tried, longest first, on the
state of the place where they begin, and the one whose transition exists gives the state. The arcs that lead
to the end of the word are its tokens; decoding emits the labels (bytes) on them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# The pre-splitting pattern of byte-level BPE, as the vocabulary's pre-tokenizer has it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS, CACHED_STEPS = 300_000, 1_000_000
_BITS = 20


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """Merge-gadget automaton of a byte-level BPE vocabulary."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.labels = {t: b for b, t in vocab.items()}
        size = max(vocab.values(), default=-1) + 1
        self.state = [-1] * size  # where a token leads; -1: no state reads it
        self.left, self.born = [-1] * size, [0] * size
        self.owner, self.base, self.first = [-1], [0], [0]
        self.removed: dict[int, int] = {}
        for label, t in vocab.items():
            if len(label) == 1:
                self.state[t] = 0
        for u, v, w in merges:
            self._gadget(u, v, w)
        self.tokens = {label: t for label, t in vocab.items() if self.state[t] >= 0}
        self._steps: dict[int, int] = {}
        self._ends: ahocorasick.Automaton | None = None

    def __getstate__(self):
        return self.__dict__ | {"_steps": {}, "_ends": None}

    def _gadget(self, u: int, v: int, w: int) -> None:
        if self.state[u] < 0 or self.state[v] < 0 or self.state[w] >= 0 or self.step(self.state[u], v) < 0:
            return  # no state reads u then v: the gadget adds nothing
        old, copy = self.state[u], len(self.owner)
        again = self.owner[old] == u
        self.owner.append(u)
        self.base.append(self.base[old] if again else old)
        self.first.append(self.first[old] if again else copy)
        self.removed[u << _BITS | v] = copy
        self.state[w] = self.state[v]
        self.state[u] = copy
        self.left[w], self.born[w] = u, copy

    def step(self, state: int, token: int) -> int:
        """The state that `state` leads to on `token`, or -1.

        The transition is out if a copy on the way to `state` took it out after the token was made, or if
        the state's original of that time had none on the token's left part.
        """
        owner, base, first, removed, born, left = self.owner, self.base, self.first, self.removed, self.born, self.left
        run = until = state
        part = token
        while run and part >= 0:
            since = born[part]
            while until > since:
                copy = removed.get(owner[run] << _BITS | part)
                if copy is not None and copy <= until:
                    return -1
                if first[run] <= since:
                    until = since
                else:
                    run = until = base[run]
            part = left[part]
        return self.state[token]

    def _tokens_by_end(self) -> ahocorasick.Automaton:
        if self._ends is None:
            self._ends = ahocorasick.Automaton()
            for label, t in self.tokens.items():
                self._ends.add_word(label.decode("latin-1"), (len(label), t))
            self._ends.make_automaton()
        return self._ends

    def encode(self, word: bytes) -> list[int]:
        """The tokens on the accepting path of `word`."""
        whole = self.tokens.get(word)
        if whole is not None:
            return [whole]
        steps = self._steps
        if len(steps) > CACHED_STEPS:
            steps.clear()
        at = len(word)
        states, arcs = [0] + [-1] * at, [(0, 0)] * (at + 1)
        for last, arc in (self._ends or self._tokens_by_end()).iter(word.decode("latin-1")):
            last += 1
            if states[last] < 0:
                size, token = arc
                before = states[last - size]
                key = before << _BITS | token
                after = steps.get(key)
                if after is None:
                    after = steps[key] = self.step(before, token)
                if after >= 0:
                    states[last] = after
                    arcs[last] = arc
        path = []
        while at:
            size, token = arcs[at]
            path.append(token)
            at -= size
        return path[::-1]


class Tokenizer:
    """A byte-level BPE vocabulary file, compiled; encodes and decodes whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        vocab = {raw(s): t for s, t in spec["model"]["vocab"].items()}
        merges = []
        for pair in spec["model"]["merges"]:
            u, v = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            merges.append((vocab[u], vocab[v], vocab[u + v]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(vocab, merges)
        self._words: dict[str, tuple[int, str, bytes]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_words": {}}

    def _word(self, word: str) -> tuple[int, str, bytes]:
        path = self.automaton.encode(word.encode())
        if len(self._words) >= CACHED_WORDS:
            self._words.clear()
        labels = self.automaton.labels
        found = self._words[word] = (len(path), ",".join(map(str, path)), b"".join([labels[t] for t in path]))
        return found

    def paths(self, text: str) -> list[tuple[int, str, bytes]]:
        """For each pre-split word: number of tokens, their ids joined by commas, the arc labels."""
        pieces = [text]
        for content in self.special:
            if content in text:
                pieces = [y for x in pieces for y in ([x] if x in self.special else _split(x, content))]
        out = []
        for piece in pieces:
            if piece in self.special:
                out.append((1, str(self.special[piece]), piece.encode()))
                continue
            known = self._words.get
            out += [known(w) or self._word(w) for w in _SPLIT.findall(piece)]
        return out

    def decode(self, ids: list[int]) -> str:
        names = {t: s.encode() for s, t in self.special.items()}
        labels = self.automaton.labels
        return b"".join([names[t] if t in names else labels[t] for t in ids]).decode("utf-8", "replace")


_SPLIT = regex.compile(SPLIT)


def _split(text: str, content: str) -> list[str]:
    parts = text.split(content)
    out = [parts[0]] if parts[0] else []
    for part in parts[1:]:
        out += [content, part] if part else [content]
    return out


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids (decimal, joined by commas), decoded (bytes, from the ids' labels).

    The vocabulary is read and compiled once on the driver and broadcast; its size does not depend on the
    data. NULL and empty texts have no tokens. Texts are encoded whole. Other columns are dropped.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(Tokenizer(tokenizer_path))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = tokenizer.value.paths
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                count, ids, decoded = [], [], []
                for text in part.column("text").to_pylist():
                    found = paths(text) if text else []
                    n, names, labels = zip(*found, strict=True) if found else ((), (), ())
                    count.append(sum(n))
                    ids.append(",".join(names))
                    decoded.append(b"".join(labels))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return texts.mapInArrow(encode, "doc_id long, n_tokens long, ids string, decoded binary")
