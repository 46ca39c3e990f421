"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie over bytes.  Every node has a failure link (the node for what is left of its string after
the longest-match pieces that can be taken off its front) and the number of pieces so popped; matching a word only
adds those numbers up, in time linear in the word.  Different words of a batch go through the automaton together, a
numpy step a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpmine.llm.common import LONGEST_WORD, cut_words, distinct_words, pieces, utf8

WORD_START = "▁".encode()     # stands before every word in the vocabulary's pieces
_NONE = -1
_MANY = 64                    # words longer than so many bytes are walked one by one


class Automaton:
    """Trie with failure links (``fail``) and popped-piece counts (``popped``); ``unknown`` marks a dead end.

    ``keys`` (node * 256 + byte, sorted) and ``child`` are the trie's edges.  A word that can't be cut into pieces
    counts as one unknown piece.
    """

    def __init__(self, vocabulary: list[bytes], prefix: bytes = WORD_START):
        children: list[dict] = [{}]
        is_piece = [False]
        for piece in vocabulary:
            at = 0
            for c in piece:
                at = children[at].setdefault(c, len(children))
                if at == len(children):
                    children.append({})
                    is_piece.append(False)
            is_piece[at] = bool(piece)
        n = len(children)
        fail, popped = [_NONE] * n, [0] * n
        level = [0]
        while level:                                     # breadth first: links only lead to shorter strings
            below = []
            for u in level:
                for c, v in children[u].items():
                    below.append(v)
                    if is_piece[v]:
                        fail[v], popped[v] = 0, 1
                        continue
                    z, k = fail[u], popped[u]
                    while z != _NONE and c not in children[z]:
                        k, z = k + popped[z], fail[z]
                    if z != _NONE:
                        fail[v], popped[v] = children[z][c], k
            level = below
        self.children, self.prefix = children, prefix
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)
        pairs = sorted((u << 8 | c, v) for u, cs in enumerate(children) for c, v in cs.items())
        self.keys, self.child = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        self.start = self._walk(0, 0, prefix)            # state and pieces after the prefix

    def _walk(self, state: int, count: int, word: bytes) -> tuple[int, int]:
        for c in word:
            while c not in self.children[state]:
                if self.fail[state] == _NONE:
                    return _NONE, 1
                count, state = count + int(self.popped[state]), int(self.fail[state])
            state = self.children[state][c]
        return state, count

    def count(self, word: bytes) -> int:
        """Pieces of one word (without its prefix)."""
        state, count = self.start
        if state != _NONE:
            state, count = self._walk(state, count, word)
        while state > 0:
            count, state = count + int(self.popped[state]), int(self.fail[state])
        return count if state == 0 else 1

    def counts(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Pieces of many words at once, given by their places in ``codes``."""
        out = np.empty(len(starts), np.int64)
        sizes = stops - starts
        for i in np.flatnonzero(sizes > _MANY).tolist():
            out[i] = self.count(codes[starts[i]:stops[i]].tobytes())
        short = np.flatnonzero(sizes <= _MANY)
        order = short[np.argsort(-sizes[short], kind="stable")]
        at, left = starts[order], sizes[order]
        state, count = np.full(len(order), self.start[0]), np.full(len(order), self.start[1])
        active = np.searchsorted(-left, -np.arange(1, _MANY + 1), "right")       # words with more than j bytes
        for j, n in enumerate(active.tolist()):
            if not n:
                break
            c = codes[at[:n] + j].astype(np.int64)
            todo = np.flatnonzero(state[:n] != _NONE)
            while len(todo):
                key = state[todo] << 8 | c[todo]
                slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[slot] == key
                state[todo[hit]] = self.child[slot[hit]]
                todo = todo[~hit]
                count[todo] += self.popped[state[todo]]
                state[todo] = self.fail[state[todo]]
                todo = todo[state[todo] != _NONE]
        todo = np.flatnonzero(state > 0)
        while len(todo):
            count[todo] += self.popped[state[todo]]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] > 0]
        out[order] = np.where(state == _NONE, 1, count)
        return out


def sentencepiece_vocabulary(path: str) -> list[bytes]:
    """Pieces of a SentencePiece model as bytes; its byte pieces stand for single bytes, control pieces are left out."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            out.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            out.append(model.id_to_piece(i).encode())
    return out


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The worker's automaton of a vocabulary file, built once."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(sentencepiece_vocabulary(path))
    return _AUTOMATA[path]


def text_counts(auto: Automaton, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words and pieces of each text."""
    data = b" ".join(texts)
    codes = np.frombuffer(data, np.uint8)
    starts, stops = cut_words(codes)
    n = np.zeros(0, np.int64)
    if len(starts):
        words = distinct_words(data, starts, stops) if int((stops - starts).max()) <= LONGEST_WORD else None
        if words is None:
            n = auto.counts(codes, starts, stops)
        else:
            n = auto.counts(codes, starts[words[0]], stops[words[0]])[words[3]]
    at = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    return np.diff(at), np.diff(np.concatenate([[0], np.cumsum(n)])[at])


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key, n_words, n_tokens`` of the whole text under a SentencePiece vocabulary file.

    Words are cut at ASCII white space and matched greedily, longest piece first, with the word-start sign before
    them.  Null and empty texts have 0 of both; repeated rows and null ids stay rows; other columns play no part.
    """
    def run(batches):
        auto = automaton(vocabulary)
        for part in pieces(batches):
            words, tokens = text_counts(auto, utf8(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=["_key", "n_words", "n_tokens"])
    rows = docs.select(docs[key].cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, "_key long, n_words long, n_tokens long").withColumnRenamed("_key", key)
