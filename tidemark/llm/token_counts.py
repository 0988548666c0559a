"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word (between white space) with the word mark before it. The
distinct new pre-tokens of some documents go into a trie. Each node holds the
forward score of its prefix, the best over all segmentations into vocabulary
pieces, and the pieces of that best one; it is computed once, from the nodes
above it, so words that begin alike share the work. The terminal node of a word
has its count, which the documents add up.

The trie is made level by level from the sorted words. A node carries the pieces
that are open at it: where each began, as its score there, and how far it has
come in the vocabulary's own trie. A level's open pieces take their next
characters together; those that end in a piece are candidates for the
node's score, those that lead nowhere are dropped. Words of over `WIDE`
characters, few at any depth, go through a trie one by one.

Pieces have unigram log probabilities by Zipf's law of their rank in a public
vocabulary. A character without a piece falls back to its bytes, each one token
of less probability than any piece. Of equal scores the one with the longer
last piece counts.

Nothing is shuffled; the counts start anew when they have grown to `WORDS`, the
trie of long words at `NODES`, so memory is bounded however many words there are.

Defined cases: null, empty and white-space texts have no words and no tokens;
repeated rows give equal rows; other columns pass through; one named n_words, n_tokens
or score (in any case) comes back with `_in` appended.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import Carried, arrow_map, as_bytes, tuned

MARK = "▁"
NODES = 400_000
WORDS = 400_000
LONGEST = 16
#: Characters of a word, beyond which it is scored alone.
WIDE = 64
#: Bytes of text whose words are looked up together.
TOGETHER = 4 << 20


def pieces(path: str) -> dict[str, float]:
    """Log probability of each ordinary piece of a sentencepiece vocabulary, by its rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    total = sum(1 / (k + 2) for k in range(len(names)))
    return {name: -math.log((k + 2) * total) for k, name in enumerate(names) if len(name) <= LONGEST}


class Trie:
    """Nodes by (parent, character); best scores and their token counts."""

    def __init__(self, vocabulary: dict[str, float]) -> None:
        self.vocabulary = vocabulary
        self.byte = min(vocabulary.values(), default=0.0) - 10
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def add(self, word: str) -> int:
        """The word's terminal node; only the nodes that no other word has made are scored."""
        path, node = [0], 0
        for end, char in enumerate(word, 1):
            key = (node, char)
            node = self.child.get(key, -1)
            if node < 0:
                node = self.child[key] = len(self.best)
                self._score(word, end, path)
            path.append(node)
        return node

    def _score(self, word: str, end: int, path: list[int]) -> None:
        best, count = -math.inf, 0
        for start in range(max(0, end - LONGEST), end):
            value = self.vocabulary.get(word[start:end])
            if value is not None and (value := value + self.best[path[start]]) > best:
                best, count = value, self.count[path[start]] + 1
        if best == -math.inf or word[end - 1] not in self.vocabulary:
            n = len(word[end - 1].encode("utf-8", "replace"))
            value = self.best[path[-1]] + n * self.byte
            if value > best:
                best, count = value, self.count[path[-1]] + n
        self.best.append(best)
        self.count.append(count)


class Pieces:
    """The vocabulary as a trie in arrays: children by (node, character) in one sorted array, log probabilities by node."""

    def __init__(self, vocabulary: dict[str, float]) -> None:
        child: dict[tuple[int, str], int] = {}
        logp, names = [-math.inf], {c for name in vocabulary for c in name}
        for name, value in vocabulary.items():
            if len(name) <= LONGEST:
                node = 0
                for c in name:
                    node = child.setdefault((node, c), len(logp))
                    if node == len(logp):
                        logp.append(-math.inf)
                logp[node] = value
        letters = sorted(names)
        self.width = len(letters) + 1
        self.kind = np.zeros(0x110000, np.int32)  # by code point; 0: in no piece
        self.kind[[ord(c) for c in letters]] = np.arange(1, self.width)
        keys = np.array([n * self.width + self.kind[ord(c)] for n, c in child], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array(list(child.values()), np.int64)[order], 0)
        self.logp = np.array(logp)
        self.open = np.zeros(len(logp), bool)  # has children
        self.open[[n for n, _ in child]] = True
        self.first = np.zeros(self.width, np.int64)  # the root's children, 0: none
        self.first[[self.kind[ord(c)] for n, c in child if n == 0]] = [to for (n, _), to in child.items() if n == 0]

    def step(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Children, 0 where there is none."""
        key = node * self.width + kind
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], 0)


def scored(text: np.ndarray, start: np.ndarray, size: np.ndarray, pieces: Pieces, byte: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and score of each word, from the trie of all of them, level by level.

    text: code points; start, size: where each word lies in it. Words in order share their prefixes' nodes; in any other order
    the results are the same.
    """
    tokens, scores = np.zeros(len(start), np.int64), np.zeros(len(start))
    word = np.arange(len(start))
    at = np.zeros(len(start), np.int64)  # each word's node on this level
    best, count = np.zeros(1), np.zeros(1, np.int64)  # by node
    opened, at_piece, base, pieces_before = np.zeros(2, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)  # open pieces, by node and then by beginning
    for depth in range(int(size.max(initial=0))):
        going = size[word] > depth
        word, at = word[going], at[going]
        char = text[start[word] + depth]
        new = np.append(True, (at[1:] != at[:-1]) | (char[1:] != char[:-1]))
        above, char = at[new], char[new]
        at = np.cumsum(new) - 1
        kind = pieces.kind[char]
        # pieces open at the node above, one character on
        n = opened[above + 1] - opened[above]
        owner = np.repeat(np.arange(len(above)), n)
        old = np.arange(len(owner)) + np.repeat(opened[above] - np.cumsum(n) + n, n)
        node = pieces.step(at_piece[old], kind[owner])
        old, owner, node = old[node > 0], owner[node > 0], node[node > 0]
        # a piece that begins here comes last
        own = pieces.first[kind]
        top = pieces.logp[own] + best[above]
        made = count[above] + 1
        value = pieces.logp[node] + base[old]
        ends = np.flatnonzero(value > -np.inf)
        if len(ends):
            value, holder = value[ends], owner[ends]
            runs = np.flatnonzero(np.append(True, holder[1:] != holder[:-1]))
            most = np.maximum.reduceat(value, runs)
            hit = np.flatnonzero(value == np.repeat(most, np.diff(runs, append=len(value))))
            hit = hit[np.append(True, holder[hit][1:] != holder[hit][:-1])]  # the longest of equal ones
            better = most >= top[holder[runs]]
            to, hit = holder[runs][better], hit[better]
            top[to], made[to] = value[hit], pieces_before[old[ends[hit]]] + 1
        # bytes of a character that is no piece
        lone = np.flatnonzero(pieces.logp[own] == -np.inf)
        n_bytes = 1 + (char[lone] > 0x7F) + (char[lone] > 0x7FF) + (char[lone] > 0xFFFF)
        fallback = best[above[lone]] + n_bytes * byte
        better = fallback > top[lone]
        top[lone[better]], made[lone[better]] = fallback[better], (count[above[lone]] + n_bytes)[better]
        # what stays open, by node and beginning
        stays = pieces.open[node]
        old, owner, node = old[stays], owner[stays], node[stays]
        begins = pieces.open[own] & (own > 0)
        total = np.bincount(owner, minlength=len(above)) + begins
        opened = np.append(0, np.cumsum(total))
        place = np.ones(opened[-1], bool)
        place[opened[1:][begins] - 1] = False
        place = np.flatnonzero(place)
        last = opened[1:][begins] - 1
        at_piece, base, pieces_before = (joined(place, x, last, y) for x, y in ((node, own[begins]), (base[old], best[above[begins]]), (pieces_before[old], count[above[begins]])))
        best, count = top, made
        done = size[word] == depth + 1
        tokens[word[done]], scores[word[done]] = count[at[done]], best[at[done]]
    return tokens, scores


def joined(at: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty(len(x) + len(y), x.dtype)
    out[at], out[other] = x, y
    return out


class Counter(dict):
    """Word -> (tokens, score); made anew at `WORDS` words, the trie of words that are asked for alone at `NODES` nodes."""

    def __init__(self, vocabulary: dict[str, float]) -> None:
        self.trie = Trie(vocabulary)
        self.pieces = Pieces(vocabulary)

    def __missing__(self, word: bytes) -> tuple[int, float]:
        if len(self.trie.best) > NODES:
            self.clear()
            self.trie = Trie(self.trie.vocabulary)
        node = self.trie.add(MARK + word.decode("utf-8", "replace"))
        out = self[word] = (self.trie.count[node], self.trie.best[node])
        return out

    def learn(self, words: set[bytes]) -> None:
        """Makes all words known that aren't too long."""
        if len(self) > WORDS:
            self.clear()
        new = sorted(w for w in words.difference(self) if len(w) < WIDE)
        if new:
            text = np.frombuffer((MARK + b"\n".join(new).decode("utf-8", "replace").replace("\n", "\n" + MARK)).encode("utf-32-le"), "<u4")
            ends = np.append(np.flatnonzero(text == 10), len(text))
            start = np.append(0, ends[:-1] + 1)
            tokens, scores = scored(text, start, ends - start, self.pieces, self.trie.byte)
            self.update(zip(new, zip(tokens.tolist(), scores.tolist(), strict=True), strict=True))


def together(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about `TOGETHER` bytes."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    yield run


def counted(docs: DataFrame, vocabulary: dict[str, float], text: str = "text") -> DataFrame:
    """docs with n_words, n_tokens and score (the log probability of the best segmentation) added."""
    tuned(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    carried = Carried(docs, "n_words", "n_tokens", "score")
    names = carried.inner
    held: list[Counter] = []

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        if not held:
            held.append(Counter(shared.value))
        words, tokens, scores = [], [], []
        for texts in together([x.as_py() for x in batch.column(len(names))]):
            split = [t.split() for t in texts]
            held[0].learn(set().union(*split))
            for own in split:
                found = list(map(held[0].__getitem__, own))
                words.append(len(found))
                tokens.append(sum([n for n, _ in found]))
                scores.append(math.fsum([s for _, s in found]))
        yield {c: batch.column(k) for k, c in enumerate(names)} | {"n_words": words, "n_tokens": tokens, "score": scores}

    return carried.back(arrow_map(carried.docs.withColumn("raw", as_bytes(carried.of(text))), run, carried.schema("n_words bigint, n_tokens bigint, score double")))
