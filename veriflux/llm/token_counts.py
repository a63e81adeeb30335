"""Token counts by dynamic programming on a trie of pre-tokens.

A pre-token is a run of non-space characters with a word mark before it. Its
tokens are the best-scoring unigram segmentation over a public vocabulary. The
forward score of a prefix (best score, tokens on that path) does not depend on
what follows, so it is computed once at a trie node and shared by all
pre-tokens with that prefix; terminals store the counts.

The distinct new pre-tokens of a batch, sorted, are such a trie: its nodes of one
depth are where neighbours begin to differ. They are scored depth by depth, all
nodes of a depth at once. Terminals stay with the task, so a pre-token is scored
once; nothing is shuffled. A store that reaches MAX_TERMINALS starts anew, which
changes no count.

No public vocabulary at hand has unigram scores. The one used ranks its pieces,
by the order in which they were merged, and Zipf's law turns ranks into
probabilities: a stand-in that counts some 2 % more tokens than the vocabulary's
own merges do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, small_text_batches, to_batch, worker_cache

MARK = "▁"
MAX_TERMINALS = 1_000_000
#: Pre-tokens longer than this are scored one by one and not stored.
SHARED_DEPTH = 64
#: Nodes of a trie that is scored at once, at most.
NODES = 1_000_000
ROLL = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 21

COUNTED = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


def vocabulary(path: str) -> tuple[dict[str, float], float]:
    """Pieces with their log-probabilities, and that of one byte of a character outside the vocabulary.

    The file's scores only rank its pieces; Zipf's law turns a rank into a
    probability, -log((rank + 1) * log(size)).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    spread = math.log(len(ids) + 1)
    scores = {model.id_to_piece(i): -math.log((rank + 1) * spread) for rank, i in enumerate(ids)}
    return scores, min(scores.values()) - 10.0


class Pieces:
    """The vocabulary's pieces by a 64-bit hash of their characters, which tells all of them apart."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.tails = {p[i:] for p in scores for i in range(len(p))}
        self.longest = max(map(len, scores))
        names = sorted(scores)
        hashes = np.array([self.hashed(p) for p in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.score = hashes[order], np.array([scores[p] for p in names])[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.slot(self.hashes)] = True

    @staticmethod
    def hashed(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(ROLL) + ord(c) + 1) % (1 << 64)
        return h

    @staticmethod
    def slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * ROLL >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes that are pieces', and those pieces' scores."""
        at = np.flatnonzero(self.filter[self.slot(hashes)])
        i = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        sure = self.hashes[i] == hashes[at]
        return at[sure], self.score[i[sure]]


def count_one(word: str, pieces: Pieces) -> int:
    """Tokens of one marked pre-token, by its prefixes in order."""
    scores, tails, path = pieces.scores, pieces.tails, [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best = None
        for start in range(end - 1, -1, -1):
            piece = word[start:end]
            if piece not in tails:
                break
            if (s := scores.get(piece)) is not None:
                reached = (path[start][0] + s, path[start][1] - 1)
                if best is None or reached > best:
                    best = reached
        if word[end - 1] not in scores:
            n = len(word[end - 1].encode("utf-8", "replace"))
            spelled = (path[end - 1][0] + n * pieces.byte_score, path[end - 1][1] - n)
            if best is None or spelled > best:
                best = spelled
        path.append(best)
    return -path[-1][1]


def count_sorted(words: list[str], pieces: Pieces) -> np.ndarray:
    """Tokens of sorted distinct marked pre-tokens of at most SHARED_DEPTH + 1 characters, on their trie."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max())
    chars = np.zeros((len(words), width), np.uint32)
    chars[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    differ = chars[1:] != chars[:-1]
    shared = np.r_[0, np.where(differ.any(1), differ.argmax(1), width)]  # characters in common with the word before
    depth_of = [(np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64))]  # of each depth's nodes: score, minus tokens, parent
    out, node = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    rolled = np.zeros((1, pieces.longest), np.uint64)  # of each node: hashes of its last 1, 2, ... characters
    for depth in range(1, width + 1):
        here = np.flatnonzero(sizes >= depth)
        new = shared[here] < depth
        new[0] = True
        first = here[new]
        parent, c = node[first], chars[first, depth - 1].astype(np.uint64) + np.uint64(1)
        before = rolled[parent]
        rolled = np.empty((len(first), pieces.longest), np.uint64)
        rolled[:, 0] = c
        rolled[:, 1:] = before[:, :-1] * ROLL + c[:, None]
        best, tokens = np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
        known = np.zeros(len(first), bool)
        for k in range(1, min(depth, pieces.longest) + 1):
            at, score = pieces.find(rolled[:, k - 1])
            if k == 1:
                known[at] = True
            if not len(at):
                continue
            up = parent[at]
            for j in range(1, k):
                up = depth_of[depth - j][2][up]
            score, less = depth_of[depth - k][0][up] + score, depth_of[depth - k][1][up] - 1
            better = (score > best[at]) | ((score == best[at]) & (less > tokens[at]))
            best[at[better]], tokens[at[better]] = score[better], less[better]
        spell = np.flatnonzero(~known)
        if len(spell):
            point = chars[first[spell], depth - 1]
            n = 1 + (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)
            n[(point >= 0xD800) & (point < 0xE000)] = 1  # a lone surrogate counts as "?"
            score, less = depth_of[depth - 1][0][parent[spell]] + n * pieces.byte_score, depth_of[depth - 1][1][parent[spell]] - n
            better = (score > best[spell]) | ((score == best[spell]) & (less > tokens[spell]))
            best[spell[better]], tokens[spell[better]] = score[better], less[better]
        depth_of.append((best, tokens, parent))
        node[here] = np.cumsum(new) - 1
        ends = here[sizes[here] == depth]
        out[ends] = -tokens[node[ends]]
    return out


class Counter:
    """Token counts of pre-tokens, kept at the terminals of the tries they were scored on."""

    def __init__(self, pieces: Pieces, most: int = MAX_TERMINALS):
        self.pieces, self.most, self.terminal = pieces, most, {}

    def learn(self, tokens: set[str]) -> None:
        new = sorted(t for t in tokens if t not in self.terminal and len(t) <= SHARED_DEPTH)
        if len(self.terminal) + len(new) > self.most:
            self.terminal = {}
            new = sorted(t for t in tokens if len(t) <= SHARED_DEPTH)
        step = max(1, NODES // (SHARED_DEPTH + 1))
        step = max(step, NODES // max(1, max(map(len, new), default=1) + 1))
        for i in range(0, len(new), step):
            part = new[i : i + step]
            self.terminal.update(zip(part, count_sorted([MARK + t for t in part], self.pieces).tolist()))

    def count(self, token: str) -> int:
        n = self.terminal.get(token)
        return count_one(MARK + token, self.pieces) if n is None else n


def count_all(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(worker_cache(("unigram", path), lambda: Pieces(*vocabulary(path))))
        for batch in batches:
            n_pretokens, n_tokens = [], []
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), 250):
                found = [(t or "").split() for t in texts[i : i + 250]]
                counter.learn(set().union(*found))
                n_pretokens += map(len, found)
                for f in found:
                    try:
                        n_tokens.append(sum(map(counter.terminal.__getitem__, f)))
                    except KeyError:  # one of the longest pre-tokens
                        n_tokens.append(sum(map(counter.count, f)))
            yield to_batch(COUNTED, batch.column(0), n_pretokens, n_tokens)

    return run


def token_counts(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row of docs.

    White space only separates. A character that no piece covers counts its
    UTF-8 bytes. A null or empty text has no tokens. Among segmentations with
    equal scores the one with fewer tokens counts. An empty table gives no rows.
    """
    small_text_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(count_all(vocabulary_path or public_tokenizers.path("piece_bpe_32k.model")), "doc_id long, n_pretokens long, n_tokens long")
