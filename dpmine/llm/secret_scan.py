"""Secret scans: fixed patterns, and probabilistic automata inferred from the credentials that they label.

The patterns' matches are labelled credentials.  A bounded sample of each kind becomes a prefix tree; states of one depth
whose continuations do not differ by a Hoeffding bound are merged, layer by layer, into an acyclic probabilistic
automaton of the kind's format (its lengths, fixed prefixes and alphabets).  Every other run of credential characters in
the corpus is a candidate.  Its likelihood under a format has to be typical of the format (held against the entropies of
the states on its path, as credentials kept out of the inference are) and well above its likelihood under a character
model of all candidates, so that a bare key of a known format is found and an ordinary long word is not.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpmine.llm.common import pieces, utf8
from dpmine.session import materialize

# fixed values: kinds, patterns and least lengths
KINDS = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = (8, 16, 32)

SAMPLE = 2048              # different labelled credentials of a kind that are learned from (those of the smallest hashes)
LABELLED = 32              # fewer than this give a kind no automaton
LONGEST = 256              # longer labelled credentials are not learned from; automata have at most so many layers
MERGE = 0.05               # confidence of the Hoeffding test that keeps two states apart
SMOOTHING = 0.01           # of a count, for ends where no credential ended and symbols that a kind has not seen
PRIORS = (1, 2, 4, 8, 16, 32)   # tried counts, for each symbol a state has seen, of the kind's symbols as a whole
SHORTEST = 8               # of a candidate
FALSE_RATE = 1e-6          # a candidate's chance under the character model to look like a format
HELD = 4                   # every fourth labelled credential is kept out of the automaton, to calibrate it
HELD_QUANTILE = 0.01       # share of held credentials that may fall under the accepted typicality
SLACK = 2.0                # and how far (nats) below that quantile a candidate may be
SHRINK = 0.001             # weight of the single characters in the character model, as a share of all characters

_CORE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_"
_SYMBOL = np.full(256, -1, np.int64)
_SYMBOL[list(_CORE + b".-")] = np.arange(len(_CORE) + 2)
_IS_CORE = np.zeros(256, bool)
_IS_CORE[list(_CORE)] = True
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
SYMBOLS = len(_CORE) + 2
STOP = SYMBOLS             # ends a string; in the character model also what comes before its first symbol


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    return edge[::2], edge[1::2]


def base_spans(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the credential) of the patterns' matches in UTF-8 bytes, by start and kind.

    Leftmost and non-overlapping for each kind; a match that is too short is passed over as a whole.
    """
    found = []
    lowered = data.lower()
    at: list[int] = []
    for word in KEYWORDS:
        k = lowered.find(word)
        while k >= 0:
            at.append(k)
            k = lowered.find(word, k + 1)
    free = 0
    for k in sorted(at):
        if k >= free and (m := ASSIGN.match(data, k)):
            free = m.end()
            if free - m.start(2) >= LEAST[0]:
                found.append((k, 0, free, m.start(2)))
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST[1]]
    starts, stops = _runs(_IS_HEX[np.frombuffer(data, np.uint8)])
    long = stops - starts >= LEAST[2]
    found += [(a, 2, b, a) for a, b in zip(starts[long].tolist(), stops[long].tolist())]
    return sorted(found)


def candidates(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of credential characters (``.`` and ``-`` inside only) of ``SHORTEST`` or more."""
    starts, stops = _runs(_SYMBOL[codes] >= 0)
    core = np.flatnonzero(_IS_CORE[codes])
    first, last = np.searchsorted(core, starts), np.searchsorted(core, stops) - 1
    some = first <= last
    starts, stops = core[first[some]], core[last[some]] + 1
    long = stops - starts >= SHORTEST
    return starts[long], stops[long]


def _outside(starts: np.ndarray, stops: np.ndarray, spans: list) -> np.ndarray:
    """Which candidates touch no span."""
    free = np.ones(len(starts), bool)
    for a, _, b, _ in spans:
        free[np.searchsorted(stops, a, "right"):np.searchsorted(starts, b, "left")] = False
    return free


# ---------------------------------------------------------------- automata
class _Node:
    __slots__ = ("count", "stop", "next")

    def __init__(self) -> None:
        self.count, self.stop, self.next = 0, 0, {}


def prefix_tree(strings: list[bytes]) -> _Node:
    root = _Node()
    for s in strings:
        node = root
        node.count += 1
        for symbol in _SYMBOL[list(s)].tolist():
            node = node.next.setdefault(symbol, _Node())
            node.count += 1
        node.stop += 1
    return root


def compatible(a: _Node, b: _Node, merge: float = MERGE) -> bool:
    """No frequency of a continuation (or of the end) differs by the Hoeffding bound, here and below."""
    width, pairs = math.sqrt(math.log(2 / merge) / 2), [(a, b)]
    while pairs:
        a, b = pairs.pop()
        bound = width * (a.count ** -0.5 + b.count ** -0.5)
        if bound >= 1:
            continue                       # nor can counts below tell anything: they are no larger
        if abs(a.stop / a.count - b.stop / b.count) >= bound:
            return False
        for symbol in a.next.keys() | b.next.keys():
            x, y = a.next.get(symbol), b.next.get(symbol)
            if abs((x.count if x else 0) / a.count - (y.count if y else 0) / b.count) >= bound:
                return False
            if x and y:
                pairs.append((x, y))
    return True


def _fold(into: _Node, other: _Node) -> None:
    pairs = [(into, other)]
    while pairs:
        a, b = pairs.pop()
        a.count, a.stop = a.count + b.count, a.stop + b.stop
        for symbol, child in b.next.items():
            if symbol in a.next:
                pairs.append((a.next[symbol], child))
            else:
                a.next[symbol] = child


@dataclass
class Automaton:
    """``step[state, symbol]`` (-1: none) and ``log_p[state, symbol or STOP]``; state 0 starts."""

    step: np.ndarray
    log_p: np.ndarray
    layers: int
    least: float = -math.inf      # accepted typicality

    def __post_init__(self) -> None:
        self.entropy = -(np.exp(self.log_p) * self.log_p).sum(axis=1)

    def scores(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood, typicality) of strings of one length, given as rows of symbols.

        Typicality is the log-likelihood plus the entropies of the states passed: about zero for the format's own
        strings of any length.  Both are -inf where a string is longer than the automaton.
        """
        state = np.zeros(len(strings), np.int64)
        total, expected = np.zeros(len(strings)), np.zeros(len(strings))
        for k in range(strings.shape[1]):
            total += self.log_p[state, strings[:, k]]
            expected += self.entropy[state]
            state = self.step[state, strings[:, k]]
            if (gone := state < 0).any():
                total[gone], state[gone] = -np.inf, 0
        total += self.log_p[state, STOP]
        return total, total + expected + self.entropy[state]

    def of(self, string: bytes) -> float:
        return float(self.scores(_SYMBOL[list(string)][None, :])[0][0])


def infer(strings: list[bytes], merge: float = MERGE, held: list[bytes] = ()) -> Automaton:
    """Merge the compatible states of the strings' prefix tree, from the root down, a layer at a time.

    A state's frequencies shrink towards the kind's symbols as a whole, the more the more different symbols it has seen;
    how far is what makes the ``held`` strings likeliest.

    A symbol that a state has not seen goes on to the state's most frequent successor, at a smoothed probability; a
    string that goes on below the last layer has none.
    """
    layer, states, depth = [prefix_tree(strings)], [], 0
    while layer:
        states += layer
        depth += 1
        kept: list[_Node] = []
        same: dict[int, _Node] = {}
        children = {id(c): c for node in layer for c in node.next.values()}
        for child in sorted(children.values(), key=lambda c: -c.count):
            own = next((k for k in kept if compatible(k, child, merge)), None)
            if own is None:
                kept.append(child)
            else:
                _fold(own, child)
            same[id(child)] = own or child
        for node in layer:
            node.next = {symbol: same[id(c)] for symbol, c in node.next.items()}
        layer = kept
    number = {id(node): i for i, node in enumerate(states)}
    step, counts = np.full((len(states), SYMBOLS), -1, np.int64), np.zeros((len(states), SYMBOLS + 1))
    for i, node in enumerate(states):
        if node.next:
            step[i] = number[id(max(node.next.values(), key=lambda c: c.count))]
            for symbol, child in node.next.items():
                step[i, symbol] = number[id(child)]
    for s in strings:                      # how often the merged automaton takes each transition
        state = 0
        for symbol in _SYMBOL[list(s)].tolist():
            counts[state, symbol] += 1
            state = step[state, symbol]
        counts[state, STOP] += 1
    overall = np.append(counts[:, :STOP].sum(axis=0), 0)
    seen = (counts[:, :STOP] > 0).sum(axis=1, keepdims=True)
    tried = []
    for weight in PRIORS:
        p = counts + weight * seen * overall / max(overall.sum(), 1) + SMOOTHING
        tried.append(Automaton(step, np.log(p / p.sum(axis=1, keepdims=True)), depth - 1))
    return max(tried, key=lambda a: sum(x for x in map(a.of, held) if math.isfinite(x))) if held else tried[0]


@dataclass
class Model:
    """An automaton for each kind that has one, and the character model ``log_p[before, symbol]`` of all candidates."""

    automata: dict[str, Automaton]
    characters: np.ndarray

    def character_log_likelihood(self, strings: np.ndarray) -> np.ndarray:
        before = np.hstack([np.full((len(strings), 1), STOP), strings])
        after = np.hstack([strings, np.full((len(strings), 1), STOP)])
        return self.characters[before, after].sum(axis=1)

    def kinds_of(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, false_rate: float = FALSE_RATE) -> np.ndarray:
        """Index in ``KINDS`` of the likeliest accepted format of every candidate, or -1."""
        found, sizes = np.full(len(starts), -1), stops - starts
        layers = max((a.layers for a in self.automata.values()), default=0)
        for size in np.unique(sizes[sizes <= layers]).tolist():       # longer strings have no path in any automaton
            rows = np.flatnonzero(sizes == size)
            strings = _SYMBOL[codes[starts[rows][:, None] + np.arange(size)]]
            ordinary, best = self.character_log_likelihood(strings), np.full(len(rows), -np.inf)
            for kind, name in enumerate(KINDS):
                if name not in self.automata:
                    continue
                score, typical = self.automata[name].scores(strings)
                better = (score - ordinary >= -math.log(false_rate)) & (typical >= self.automata[name].least) & (score > best)
                found[rows[better]], best[better] = kind, score[better]
        return found


def learn(labelled: dict[str, list[bytes]], cells: np.ndarray) -> Model:
    """Model from bounded lists of labelled credentials and the counts ``cells[before, symbol]`` of all candidates."""
    automata = {}
    for kind, strings in labelled.items():
        if len(strings) < LABELLED:
            continue
        held, own = strings[::HELD], [s for i, s in enumerate(strings) if i % HELD]
        automaton = infer(own, held=held)
        typical = np.sort([automaton.scores(_SYMBOL[list(s)][None, :])[1][0] for s in held])
        typical = typical[np.isfinite(typical)]
        if len(typical):
            automaton.least = float(typical[int(HELD_QUANTILE * len(typical))]) - SLACK
            automata[kind] = automaton
    # pairs shrink towards single characters, so that the few pairs that only bare credentials have stay rare
    single = (cells.sum(axis=0) + SMOOTHING) / (cells.sum() + SMOOTHING * (SYMBOLS + 1))
    weight = SHRINK * cells.sum() + 1
    return Model(automata, np.log((cells + weight * single) / (cells.sum(axis=1, keepdims=True) + weight)))


# ---------------------------------------------------------------- jobs
def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts in one buffer, a zero byte after each (no pattern runs across it), and where each starts."""
    ends = np.cumsum([len(x) + 1 for x in texts])
    return b"\0".join(texts) + b"\0", np.concatenate([[0], ends[:-1]])


def credential(value: bytes) -> bytes | None:
    """What is learned from a labelled value: its longest candidate, if that is not too long."""
    codes = np.frombuffer(value, np.uint8)
    starts, stops = candidates(codes)
    if not len(starts):
        return None
    k = int((stops - starts).argmax())
    return value[starts[k]:stops[k]] if stops[k] - starts[k] <= LONGEST else None


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Model of a corpus: automata from at most ``sample`` credentials a kind, character counts of all candidates.

    One pass; a task sends its different credentials and a fixed table of counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, labelled = np.zeros((SYMBOLS + 1) ** 2, np.int64), set()
        for batch in pieces(batches):
            data, _ = _joined(utf8(batch.column("text")))
            codes = np.frombuffer(data, np.uint8)
            spans = base_spans(data)
            labelled |= {(kind, c) for _, kind, b, v in spans if (c := credential(data[v:b]))}
            if len(labelled) > 50_000:
                yield _counted([(k, c.decode(), 1) for k, c in labelled])
                labelled = set()
            starts, stops = candidates(codes)
            free = _outside(starts, stops, spans)
            starts, stops = starts[free], stops[free]
            inside = np.zeros(len(codes) + 1, np.int8)
            inside[starts], inside[stops] = 1, -1
            inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
            symbols, pair = _SYMBOL[codes], inside[:-1] & inside[1:]
            cells += np.bincount(symbols[:-1][pair] * (SYMBOLS + 1) + symbols[1:][pair], minlength=len(cells))
            cells += np.bincount(STOP * (SYMBOLS + 1) + symbols[starts], minlength=len(cells))
            cells += np.bincount(symbols[stops - 1] * (SYMBOLS + 1) + STOP, minlength=len(cells))
        yield _counted([(k, c.decode(), 1) for k, c in labelled] + [
            (len(KINDS), str(i), int(cells[i])) for i in np.flatnonzero(cells)])

    seen = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind int, value string, n long")
    seen = materialize(seen.groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    labelled = {}
    for kind, name in enumerate(KINDS):
        some = seen.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample)
        labelled[name] = [r["value"].encode() for r in some.select("value").collect()]
    cells = np.zeros((SYMBOLS + 1) ** 2)
    for r in seen.filter(F.col("kind") == len(KINDS)).collect():        # at most (symbols + 1)^2 rows
        cells[int(r["value"])] = r["n"]
    return learn(labelled, cells.reshape(SYMBOLS + 1, SYMBOLS + 1))


def _counted(rows: list[tuple[int, str, int]]) -> pa.RecordBatch:
    kind, value, n = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "value": pa.array(value, pa.string()),
                                       "n": pa.array(n, pa.int64())})


def all_spans(texts: list[bytes], model: Model) -> dict[int, list[tuple[int, int, int]]]:
    """For each text with a span (start, kind, end) of all its spans, in code points; learned kinds follow the listed ones."""
    data, offsets = _joined(texts)
    codes = np.frombuffer(data, np.uint8)
    base = base_spans(data)
    starts, stops = candidates(codes)
    free = _outside(starts, stops, base)
    starts, stops = starts[free], stops[free]
    kinds = model.kinds_of(codes, starts, stops)
    own = kinds >= 0
    spans = [(a, k, b) for a, k, b, _ in base] + list(zip(
        starts[own].tolist(), (kinds[own] + len(KINDS)).tolist(), stops[own].tolist()))
    found: dict[int, list[tuple[int, int, int]]] = {}
    if not spans:
        return found
    spans.sort()
    place = np.arange(len(codes) + 1) if data.isascii() else np.concatenate(
        [[0], np.cumsum((codes & 0xC0) != 0x80, dtype=np.int64)])          # code points before each byte
    for a, kind, b in spans:
        doc = int(np.searchsorted(offsets, a, "right")) - 1
        start = int(place[offsets[doc]])
        found.setdefault(doc, []).append((int(place[a]) - start, kind, int(place[b]) - start))
    return found


def _written(spans: list[tuple[int, int, int]]) -> str:
    names = [*KINDS, *(f"like_{k}" for k in KINDS)]
    return ",".join(f"{names[kind]}:{a}:{b}" for a, kind, b in spans)


def find_secrets(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_learned, base_sha256, spans`` of every row, in one pass without exchange.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) by start and kind: the patterns' matches and the
    candidates that a format accepts (``like_assign``, ``like_access``, ``like_hex``; they touch no pattern's match).
    ``base_sha256`` is the digest of the patterns' part.  A null or empty text has no span; null ids and repeated rows
    take part, each for itself; long texts are scanned whole; an empty table gives no row; other columns play no part.
    Kinds with fewer than ``LABELLED`` different credentials add nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = all_spans(utf8(batch.column("text")), model)
            counts = np.zeros((batch.num_rows, len(KINDS) + 1), np.int64)
            digests = [hashlib.sha256(b"").hexdigest()] * batch.num_rows
            written = [""] * batch.num_rows
            for doc, spans in found.items():
                base = [x for x in spans if x[1] < len(KINDS)]
                for _, kind, _ in spans:
                    counts[doc, min(kind, len(KINDS))] += 1
                digests[doc] = hashlib.sha256(_written(base).encode()).hexdigest()
                written[doc] = _written(spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(counts[:, k]) for k in range(len(KINDS) + 1)],
                                              pa.array(digests), pa.array(written)], names=[
                "doc_id", "n_assign", "n_access", "n_hex", "n_learned", "base_sha256", "spans"])
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans string")
