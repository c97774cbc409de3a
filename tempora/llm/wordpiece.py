"""Token counts by a linear longest-match automaton.

Greedy word-piece lengths need no pieces: each node of the vocabulary trie keeps a failure link and the number of
pieces popped on it, so every byte of a word is read once (Song et al., "Fast WordPiece Tokenization").
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import by_few, ship

ship(__name__)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the pattern by which the vocabulary's published tokenizer cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words that a worker remembers; beyond it the memory starts anew. It bounds memory, not results.
REMEMBERED = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes, from the published rule."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces as bytes; special tokens, which stand for no bytes, are left out."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {x["content"] for x in data.get("added_tokens", [])}
    letters = byte_letters()
    return [bytes(letters[c] for c in piece) for piece in data["model"]["vocab"] if piece not in special]


class LongestMatch:
    """Counts the pieces that greedy longest-match-first takes for a word, in time linear in its bytes."""

    def __init__(self, pieces: Iterable[bytes]):
        # child: node * 256 + byte -> node. Node 0 is the root.
        self.child: dict[int, int] = {}
        ends, parent_of = [False], [(0, 0)]
        for piece in pieces:
            node = 0
            for b in piece:
                at = node << 8 | b
                if at not in self.child:
                    self.child[at] = len(ends)
                    parent_of.append((node, b))
                    ends.append(False)
                node = self.child[at]
            ends[node] = node > 0
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        below: list[list[int]] = [[] for _ in ends]
        for node in range(1, len(ends)):
            below[parent_of[node][0]].append(node)
        todo = deque(below[0])
        while todo:
            v = todo.popleft()
            todo.extend(below[v])
            u, b = parent_of[v]
            if ends[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            z, n = self.fail[u], self.popped[u]
            while z >= 0 and (z << 8 | b) not in self.child:
                n += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.child[z << 8 | b], n
        #: A word that no sequence of pieces spells counts as one unknown token.
        self.unknown = 1

    def count(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        u = n = 0
        for b in word:
            while (v := child.get(u << 8 | b)) is None:
                if fail[u] < 0:
                    return self.unknown
                n += popped[u]
                u = fail[u]
            u = v
        while u:
            if fail[u] < 0:
                return self.unknown
            n += popped[u]
            u = fail[u]
        return n


def count_tokens(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Count the greedy word pieces of every whole text: (key, n_bytes, n_words, n_tokens).

    A null or empty text has no words and no tokens. Null keys and repeated rows come back as they are, an empty table
    gives none; a long text is counted as a whole; only the two named columns are read. `vocabulary` is a byte-level vocabulary file that every worker
    can open. One pass, no shuffle.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = LongestMatch(load_vocabulary(vocabulary)), {}
        word, chunk = regex.compile(WORDS), regex.compile(r"\s*\S+|\s+")

        def measure(text: str | None) -> tuple[int, int, int]:
            n_words = n_tokens = 0
            # No word spans two chunks, so what a chunk adds depends on the chunk alone.
            for c in chunk.findall(text or ""):
                if (got := known.get(c)) is None:
                    words = word.findall(c)
                    got = len(words), sum(machine.count(w.encode("utf-8", "surrogatepass")) for w in words)
                    if len(c) <= 64:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[c] = got
                n_words += got[0]
                n_tokens += got[1]
            return len((text or "").encode("utf-8", "surrogatepass")), n_words, n_tokens

        for b in by_few(batches):
            columns = list(zip(*map(measure, b.column(1).to_pylist()), strict=True)) if b.num_rows else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["_key", "n_bytes", "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"_key {kind}, n_bytes long, n_words long, n_tokens long").withColumnRenamed("_key", key)
