"""Token counts by a linear longest-match automaton.

Greedy longest match over a trie of the vocabulary, without ever going back in the text: every trie node has a failure
link to the node in which matching goes on once no child fits, and the number of pieces that are finished on the way
there. Counting a word's pieces is then one walk along its bytes. Links and numbers are computed once from the
vocabulary, whose size bounds what is broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_WORDS_KEPT = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a byte-level vocabulary file as bytes; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    return sorted(bytes(letters[c] for c in piece) for piece in vocabulary if all(c in letters for c in piece))


class Automaton:
    """Counts greedy longest-match pieces. A byte that starts no piece counts as one piece of its own."""

    def __init__(self, pieces: Iterable[bytes]):
        self.children: list[dict[int, int]] = [{}]
        depth, ends, parent, last = [0], [False], [0], [0]
        for piece in pieces:
            at = 0
            for b in piece:
                to = self.children[at].get(b)
                if to is None:
                    to = self.children[at][b] = len(self.children)
                    self.children.append({})
                    depth.append(depth[at] + 1)
                    ends.append(False)
                    parent.append(at)
                    last.append(b)
                at = to
            if at:
                ends[at] = True
        # fail[v]: where matching goes on when no child of v fits; pops[v]: pieces finished by then. None at the root.
        self.fail = [0] * len(self.children)
        self.pops = [0] * len(self.children)
        for v in sorted(range(1, len(depth)), key=depth.__getitem__):
            if ends[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            u, n = self._step(self.fail[parent[v]], last[v]) if parent[v] else (0, 1)
            self.fail[v], self.pops[v] = u, n + (self.pops[parent[v]] if parent[v] else 0)

    def _step(self, at: int, b: int) -> tuple[int, int]:
        """From a node along one byte: the next node and the pieces finished before it."""
        done = 0
        while True:
            to = self.children[at].get(b)
            if to is not None:
                return to, done
            if not at:
                return 0, done + 1
            done += self.pops[at]
            at = self.fail[at]

    def count(self, word: bytes) -> int:
        """Pieces of a word."""
        children, fail, pops = self.children, self.fail, self.pops
        at = n = 0
        for b in word:
            to = children[at].get(b)
            while to is None:
                if not at:
                    n += 1
                    to = 0
                    break
                n += pops[at]
                at = fail[at]
                to = children[at].get(b)
            at = to
        while at:
            n += pops[at]
            at = fail[at]
        return n


def count_tokens(docs: DataFrame, pieces: Iterable[bytes], text_col: str = "text", mark: bytes = b" ") -> DataFrame:
    """docs with n_words and n_tokens (both bigint): words between ASCII white space, and their greedy pieces.

    Every word is matched with the mark before it, as such vocabularies write the space before a word. Null and empty
    texts have no words. If docs has one of the two columns, it is replaced; rows are otherwise as they came.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sorted(pieces))

    @F.pandas_udf("n_words bigint, n_tokens bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(shared.value)
        known: dict[bytes, int] = {}
        for texts in batches:
            words, tokens = [], []
            for text in texts:
                found = text.encode("utf-8", "surrogatepass").split()
                n = 0
                for w in found:
                    c = known.get(w)
                    if c is None:
                        c = automaton.count(mark + w)
                        if len(w) <= 64:
                            if len(known) >= _WORDS_KEPT:
                                known.clear()
                            known[w] = c
                    n += c
                words.append(len(found))
                tokens.append(n)
            yield pd.DataFrame({"n_words": words, "n_tokens": tokens}, dtype="int64")

    kept = [c for c in docs.columns if c not in ("n_words", "n_tokens")]
    (work,) = fresh(docs.columns, "counted")
    counted = docs.withColumn(work, of(text_of(text_col)))
    return counted.select(*kept, F.col(work)["n_words"].alias("n_words"), F.col(work)["n_tokens"].alias("n_tokens"))
