"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

One model table serves all languages: for each order the hashes of all seen n-grams, sorted, with a row of
interpolated log-probabilities (one column a language), and the hashes of all contexts with their back-off weights.
A character costs one binary search in the highest order; only n-grams that no language has seen go on to the lower.
The language of least cross-entropy per character wins; a text whose cross-entropy is far outside what its language
shows on labelled rows kept for calibration is rejected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dpmine.llm.common import pieces

ORDER = 4                # characters of the longest n-gram
SAMPLE = 600             # labelled rows a language that the model is fitted on, at most (the documented bound)
CALIBRATION = 4          # every so many of them calibrate instead of being counted
MAX_LANGUAGES = 256
MAX_TYPES = 20_000_000   # n-grams of all languages together that the driver takes; more is an error
FALSE_REJECTION = 1e-3   # share of a language's own texts that may be rejected
LONG = 200               # letters from which a text's cross-entropy shows the spread between texts
LEAST = 8                # texts that give a language figures of its own
UNKNOWN = "und"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def characters(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters with one space for every run of other characters.

    Returns all code points, each text after ``order - 1`` padding spaces, and the first and past-the-last position of
    each text.  A text without letters is empty.
    """
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    ends = np.cumsum(sizes)
    begin = np.zeros(len(codes) + 1, bool)
    begin[(ends - sizes)] = True
    keep = is_letter.copy()
    keep[1:] |= ~is_letter[1:] & is_letter[:-1] & ~begin[1:-1]     # the first non-letter after a letter becomes the space
    upto = np.concatenate([[0], np.cumsum(keep)])
    counts = upto[ends] - upto[ends - sizes]
    kept = np.where(is_letter, codes, 32)[keep]
    pad = order - 1
    first = np.cumsum(counts + pad) - counts
    out = np.full(int(counts.sum()) + pad * len(low), 32, np.uint32)
    out[np.arange(len(kept)) + np.repeat(first - (np.cumsum(counts) - counts), counts)] = kept
    return out, first, first + counts


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters that end at each position from ``k - 1`` on."""
    n = max(0, len(codes) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _FACTOR + codes[j:j + n].astype(np.uint64, copy=False) + np.uint64(1)
    return _mixed(h)


def gram_hash(text: str) -> int:
    return int(gram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), len(text))[0])


@dataclass
class Model:
    """``grams[k], logp[k]``: sorted hashes of the (k+1)-grams and their log2 probabilities (rows x languages);
    ``contexts[k], backoff[k]``: of the k-character contexts; ``unseen``: of a character no language knows."""

    order: int
    languages: list
    grams: list
    logp: list
    contexts: list
    backoff: list
    unseen: np.ndarray
    mean: np.ndarray = None
    spread: np.ndarray = None
    noise: np.ndarray = None
    limit: np.ndarray = None
    foreign: np.ndarray = None
    sharpness: float = 1.0

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for some in (self.grams, self.logp, self.contexts, self.backoff) for a in some)

    def log_probabilities(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log2 probability of the character at each position ``at`` after those before it: (positions, languages)."""
        wide = codes.astype(np.uint64)
        h = gram_hashes(wide, self.order)[at - (self.order - 1)]
        found = np.minimum(np.searchsorted(self.grams[-1], h), len(self.grams[-1]) - 1)
        out = self.logp[-1][found]
        todo = np.flatnonzero(self.grams[-1][found] != h)          # n-grams no language has seen
        out[todo] = 0
        for k in range(self.order - 1, 0, -1):
            if not len(todo):
                return out
            for keys, values in ((self.contexts[k], self.backoff[k]), (self.grams[k - 1], self.logp[k - 1])):
                end = at[todo] - (keys is self.contexts[k])        # the context ends a character earlier
                h = np.zeros(len(todo), np.uint64)
                for j in range(k - 1, -1, -1):
                    h = h * _FACTOR + wide[end - j] + np.uint64(1)
                h = _mixed(h)
                found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[found] == h
                out[todo[hit]] += values[found[hit]]
            todo = todo[~hit]
        out[todo] += self.unseen
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character (texts x languages) and the number of characters of each text."""
        codes, first, past = characters(texts, self.order)
        n = past - first
        total = np.zeros((len(texts), len(self.languages)))
        has = np.flatnonzero(n)
        if len(has):
            inside = np.ones(len(codes), bool)
            for j in range(self.order - 1):
                inside[first - 1 - j] = False
            at = np.flatnonzero(inside)
            lp = self.log_probabilities(codes, at)
            starts = np.concatenate([[0], np.cumsum(n[has])[:-1]])
            total[has] = np.add.reduceat(lp, starts, axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n


def fit(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney from the counts of the ``order``-grams of each language.

    The highest order uses counts, every lower one the number of different characters before the n-gram; one absolute
    discount an order and language (n1 / (n1 + 2 n2)); unigrams are interpolated with the uniform distribution.
    """
    languages = sorted(counts)
    by_order: list[list[dict]] = [[] for _ in range(order)]
    for lang in languages:
        level = {g: c for g, c in counts[lang].items()}
        by_order[order - 1].append(level)
        for k in range(order - 1, 0, -1):
            lower: dict[str, int] = {}
            for g in level:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            by_order[k - 1].append(lower)
            level = lower
    alphabet = len({g for some in by_order[0] for g in some}) + 1
    n_lang = len(languages)
    grams, logp, contexts, backoff = [], [], [], []
    below: dict[str, int] = {"": 0}
    p_below = np.full((1, n_lang), 1.0 / alphabet)
    unseen = None
    for k in range(1, order + 1):
        some = by_order[k - 1]
        names = sorted({g for level in some for g in level})
        ctx_names = sorted({g[:-1] for g in names})
        ctx_at = {c: i for i, c in enumerate(ctx_names)}
        c = np.array([[level.get(g, 0) for level in some] for g in names], np.float64).reshape(-1, n_lang)
        ctx = np.array([ctx_at[g[:-1]] for g in names], np.int64)
        low = np.array([below[g[1:]] for g in names], np.int64)
        ones, twos = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        d = np.clip(np.where(ones + twos > 0, (ones + 0.5) / (ones + 2 * twos + 1), 0.5), 0.05, 0.95)
        den, kinds = np.zeros((len(ctx_names), n_lang)), np.zeros((len(ctx_names), n_lang))
        np.add.at(den, ctx, c)
        np.add.at(kinds, ctx, c > 0)
        weight = np.where(den > 0, d * kinds / np.maximum(den, 1), 1.0)
        p = np.maximum(c - d, 0) / np.maximum(den, 1)[ctx] + weight[ctx] * p_below[low]
        if k == 1:
            unseen = np.log2(weight[0] / alphabet).astype(np.float32)
        hashes = np.array([gram_hash(g) for g in names], np.uint64)
        by_hash = np.argsort(hashes)
        grams.append(hashes[by_hash])
        logp.append(np.log2(p)[by_hash].astype(np.float32))
        h = np.array([gram_hash(x) if x else 0 for x in ctx_names], np.uint64)
        by_hash = np.argsort(h)
        contexts.append(h[by_hash])
        backoff.append(np.log2(weight)[by_hash].astype(np.float32))
        below, p_below = {g: i for i, g in enumerate(names)}, p
    return Model(order, languages, grams, logp, contexts, backoff, unseen)


def _tail(t: np.ndarray, rate: float) -> float:
    """The value that a share ``rate`` exceeds, from an exponential tail above the ninth decile."""
    ninth = float(np.quantile(t, 0.9))
    above = t[t > ninth] - ninth
    return ninth + (float(above.mean()) if len(above) else 0.0) * max(0.0, math.log(0.1 / rate))


def calibrate(model: Model, texts: list[str], langs: list[str], rate: float = FALSE_REJECTION) -> Model:
    """What cross-entropies each language's own texts have, and the sharpness of the score, from labelled texts.

    ``mean`` and ``spread`` are the median and the scaled median deviation of a language's long texts, ``noise`` the
    deviation of a single character (short texts vary more).  ``limit`` is how many such deviations above the mean a
    text of the language is with probability ``rate``.  ``foreign`` is the median that the other languages' texts have.
    A text is rejected above both.  Labelled texts that are likelier in another language are wrongly labelled and play
    no part; a language with fewer than ``LEAST`` texts takes the figures of all together.
    """
    ce, n = model.cross_entropies(texts)
    at = np.array([model.languages.index(x) for x in langs], np.int64)
    own = ce[np.arange(len(at)), at]
    good = (n > 0) & (ce.argmin(axis=1) == at) if len(at) else np.zeros(0, bool)
    middle = lambda x, otherwise: float(np.median(x)) if len(x) >= LEAST else otherwise
    by_lang = [good & (at == i) for i in range(len(model.languages))]
    means = [middle(own[s & (n >= LONG)], middle(own[s], np.nan)) for s in by_lang]
    known = [m for m in means if m == m]
    everywhere = float(np.mean(known)) if known else float(own[n > 0].mean()) if (n > 0).any() else 0.0
    model.mean = np.array([m if m == m else everywhere for m in means])
    off = own - model.mean[at] if len(at) else own
    spread = lambda s, otherwise: 1.4826 * middle(np.abs(off[s & (n >= LONG)]), otherwise / 1.4826)
    noise = lambda s, otherwise: 1.4826 * middle((np.abs(off) * np.sqrt(n))[s & (n < LONG)], otherwise / 1.4826)
    spread_all, noise_all = spread(good, 0.1), noise(good, 2.0)
    model.spread = np.array([max(0.01, spread(s, spread_all)) for s in by_lang])
    model.noise = np.array([max(0.1, noise(s, noise_all)) for s in by_lang])
    t = off / np.sqrt(model.spread[at] ** 2 + model.noise[at] ** 2 / np.maximum(n, 1)) if len(at) else off
    together = _tail(t[good], rate) if good.sum() >= LEAST else 8.0
    model.foreign = np.array([middle(ce[good & ~s, i], 0.0) for i, s in enumerate(by_lang)])
    model.limit = np.array([_tail(t[s], rate) if s.sum() >= LEAST else together for s in by_lang])
    best = None
    for sharpness in 2.0 ** np.arange(-3, 8):
        z = -(ce - ce.min(axis=1, keepdims=True))[n > 0] * sharpness
        loss = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), at[n > 0]]).mean() if (n > 0).any() else 0.0
        if best is None or loss < best[0]:
            best = (loss, float(sharpness))
    model.sharpness = best[1]
    return model


def predict(model: Model | None, texts: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score (0 to 1), cross-entropy and rejection of each text.

    Null or without a letter: ``und``, 0, 0, rejected.  Without a model every text is ``und`` with score 0, and only
    those without a letter are rejected.
    """
    if model is None:
        _, first, past = characters([t or "" for t in texts], 1)
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), first == past
    ce, n = model.cross_entropies([t or "" for t in texts])
    best = ce.argmin(axis=1)
    low = ce[np.arange(len(best)), best] if len(best) else np.zeros(0)
    score = 1.0 / np.exp(-(ce - low[:, None]) * model.sharpness).sum(axis=1)
    limit = model.mean[best] + model.limit[best] * np.sqrt(model.spread[best] ** 2 + model.noise[best] ** 2 / np.maximum(n, 1))
    limit, empty = np.maximum(limit, model.foreign[best]), n == 0
    return ([UNKNOWN if e else model.languages[b] for e, b in zip(empty, best)], np.where(empty, 0.0, score),
            np.where(empty, 0.0, low), empty | (low > limit))


def is_held_out(key: str = "doc_id") -> Column:
    """Rows never learnt from: CRC-32 of the id as text is 2 modulo 4 (a null id: no)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER,
          sample: int = SAMPLE) -> Model | None:
    """Fit on a bounded sample: of each label the ``sample`` rows that are first by a hash of id and text, whole texts.

    Rows of one label, id and text are one row.

    N-grams are counted in the executors and summed there; the driver gets one row per n-gram and the calibration
    texts, as many as the sample allows.  Without any labelled text the result is None.
    """
    rows = (docs.filter(~is_held_out(key) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
            .select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"),
                    F.xxhash64(F.lit(17), F.col(key).cast("string"), text).alias("h")))
    # copies of a row are one row, before anything is ranked; hashes are ranked, texts follow for those taken
    ranked = W.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= sample)
    limits = chosen.groupBy("lang").agg(F.max("h").alias("top"), F.count("*").alias("rows")).collect()
    if not limits:
        return None
    if len(limits) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    top = F.create_map(*[F.lit(x) for r in limits for x in (r["lang"], r["top"])])
    few = {r["lang"] for r in limits if r["rows"] < 2 * CALIBRATION}
    taken = rows.filter(F.col("h") <= top[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    held = F.pmod(F.xxhash64("h"), F.lit(CALIBRATION)) == 0
    scarce = F.col("lang").isin(sorted(few)) if few else F.lit(False)     # too few rows to keep some apart
    counted = taken.filter(~held | scarce)

    def count(batches):
        for part in pieces(batches):
            langs = part.column(0).to_pylist()
            for name in sorted(set(langs)):
                texts = [t for x, t in zip(langs, part.column(1).to_pylist()) if x == name]
                codes, first, past = characters(texts, order)
                inside = np.ones(len(codes), bool)
                for j in range(order - 1):
                    inside[first - 1 - j] = False
                at = np.flatnonzero(inside)
                at = at[at >= order - 1]
                kinds, where, times = np.unique(gram_hashes(codes, order)[at - (order - 1)], return_index=True,
                                                return_counts=True)
                grams = ["".join(map(chr, codes[i - order + 1:i + 1].tolist())) for i in at[where].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.string()),
                                                  pa.array(times, pa.int64())], names=["lang", "gram", "n"])
    sums = (counted.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")).limit(MAX_TYPES + 1).toArrow())
    if sums.num_rows > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} n-grams; lower the sample")
    counts: dict[str, dict[str, int]] = {}
    for name, gram, n in zip(*(sums.column(c).to_pylist() for c in ("lang", "gram", "n"))):
        counts.setdefault(name, {})[gram] = n
    model = fit(counts, order)
    spared = taken.filter(held | scarce).filter(F.col("lang").isin(model.languages)).select("lang", "text")
    spared = spared.collect()            # at most ``sample`` rows a language
    return calibrate(model, [r["text"] for r in spared], [r["lang"] for r in spared])


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key, lang_pred, score, cross_entropy, rejected``.  Only the text is read.

    Null texts and texts without a letter give ``und``, score 0, rejected; equal texts equal rows; ties go to the
    first language by code point.  Whole texts of any length count; other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)      # bounded by MAX_TYPES, in practice a few MB

    def run(batches):
        for part in pieces(batches, 2 << 20):
            langs, score, ce, rejected = predict(shared.value, part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(ce, pa.float64()),
                 pa.array(rejected, pa.bool_())], names=["_key", "lang_pred", "score", "cross_entropy", "rejected"])
    rows = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    kind = dict(docs.select(key).dtypes)[key]
    out = rows.mapInArrow(run, f"_key {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.withColumnRenamed("_key", key)


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text the model doesn't reject; columns unchanged, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keep(texts):
        import pandas as pd
        out = []
        values = texts.tolist()
        for at in range(0, len(values), 256):
            out.extend(~predict(shared.value, values[at:at + 256])[3])
        return pd.Series(out, dtype=bool)
    return docs.filter(keep(docs[text].cast("string")))
