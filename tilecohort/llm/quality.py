"""Quality rules: surface counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Unigrams and bigrams of lower-cased words are hashed into BUCKETS cells. The raw
multinomial counts every document; the trusted one counts every document
labelled good. A document's score is the sum of its cells' log ratios
over its n-grams plus SHRINK, so short texts tend to 0. A document passes when
its score is at least a threshold set once from all labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import quantiles
from .common import discard, first_by_hash, written
from .words import binary_array, column, inside, per_text, raw, slices, split, windows, word_hashes

BUCKETS = 1 << 16
#: Labelled documents of each class in a sample, at most.
SAMPLE = 4096
SHRINK = 32.0
#: Weight, in n-grams, of the raw distribution as the trusted one's prior.
PRIOR = float(BUCKETS)
#: The threshold lies MARGIN under the score that all but LOST of the trusted documents reach, or halfway
#: from there to the score that all but SPARED of those labelled bad stay under, whichever is lower.
LOST, MARGIN, SPARED = 0.002, 0.03, 0.02
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all unigrams and bigrams, and the text of each."""
    w = split(texts, lower=True)
    h = word_hashes(w.vocab)[w.codes]
    two = windows(h, 2)
    ok = inside(w.bounds, 2)
    doc = w.doc_of_word
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([h >> shift, two[ok] >> shift]).astype(np.int64), np.concatenate([doc, doc[: len(two)][ok]])


def labelled(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Each labelled id once with its quality; null or conflicting labels are left out."""
    return labels.filter(F.col("quality").isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min("quality").alias("quality"), F.max("quality").alias("q2")).filter("quality = q2").select(doc_id, "quality")


def sample_of(labels: DataFrame, doc_id: str = "doc_id", n: int = SAMPLE) -> DataFrame:
    """At most n ids of each quality, the first by hash; null or conflicting labels are left out."""
    return first_by_hash(labelled(labels, doc_id), ["quality"], doc_id, "quality", n)


def ratios(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """(log ratio of each cell, threshold). The driver gets BUCKETS sums and two quantiles.

    With no trusted document the ratios are 0 and everything passes.
    """
    # the labels grow with the texts, so they are joined by a shuffle of both, once
    marked = written(docs.select(doc_id, text).join(labelled(labels, doc_id).hint("merge"), doc_id).select(text, "quality"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in slices(batches, text):
            total += np.bincount(cells(column(part, text))[0], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        for i in range(0, len(seen), 20_000):
            s = seen[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(total[s])], names=["cell", "n"])

    def summed(rows: DataFrame) -> np.ndarray:
        got = rows.select(text).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(BUCKETS)
        out[got["cell"].to_numpy()] = got["n"].to_numpy()
        return out

    trusted = summed(marked.filter("quality = 1"))
    if not trusted.sum():
        discard(marked)
        return np.zeros(BUCKETS), -np.inf
    n = summed(docs)
    wide = docs.sparkSession.sparkContext.broadcast((n, trusted))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            good = column(part, "quality").to_numpy(zero_copy_only=False) == 1
            cell, doc = cells(column(part, text))
            key, own = np.unique(doc * BUCKETS + cell, return_counts=True)
            doc, cell = key // BUCKETS, key % BUCKETS
            size = np.bincount(doc, weights=own, minlength=len(good))
            without = log_ratio(*wide.value, cell, own * good[doc], (size * good)[doc])
            out = np.bincount(doc, weights=own * without, minlength=len(good)) / (size + SHRINK)
            yield pa.RecordBatch.from_arrays([pa.array(out), column(part, "quality")], names=["score", "quality"])

    scored = written(marked.mapInArrow(score, "score double, quality int"), "scored")

    def percentile(quality: int, at: float) -> float | None:
        found = quantiles(scored.filter(F.col("quality") == quality).select("score"), [], "score", at=at).first()
        return found.at if found else None

    low, high = percentile(1, LOST), percentile(0, 1 - SPARED)
    discard(marked)
    discard(scored)
    threshold = low - MARGIN
    if high is not None:
        threshold = min(threshold, (low + high) / 2)
    return log_ratio(n, trusted, np.arange(BUCKETS)), threshold


def log_ratio(n: np.ndarray, trusted: np.ndarray, cell: np.ndarray, own=0.0, size=0.0) -> np.ndarray:
    """Log ratio of cells; own and size are counts of one trusted document to leave out, for an unbiased score of it."""
    raw_share = (n[cell] + 0.5) / (n.sum() + 0.5 * BUCKETS)
    return np.log((trusted[cell] - own + PRIOR * raw_share) / (trusted.sum() - size + PRIOR)) - np.log(raw_share)


def scores(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    cell, doc = cells(texts)
    n = np.bincount(doc, minlength=len(texts))
    return np.bincount(doc, weights=ratio[cell], minlength=len(texts)) / (n + SHRINK)


def surface(texts: pa.Array) -> dict[str, np.ndarray]:
    """The exact counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = split(texts)
    n = len(texts)
    if not len(w.data):
        return {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    letters = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=letters[1:])
    word_chars = per_text(letters[w.ends] - letters[w.starts], w.bounds)
    symbols = per_text(_SYMBOL[w.data], w.offsets)
    return {"n_words": np.diff(w.bounds), "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": _dup_lines(w), "n_repeat_words": _repeat_words(w)}


def _dup_lines(w) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n = len(w.bounds) - 1
    cut = np.flatnonzero(w.data == 0x0A)
    starts = np.concatenate([w.offsets[:-1], cut + 1])
    ends = np.concatenate([w.offsets[1:], np.zeros(0, np.int64)])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    doc = np.concatenate([np.arange(n), np.searchsorted(w.offsets, cut, side="right") - 1])[order]
    # a line ends at the next line feed of its text or at the text's end
    stop = np.searchsorted(cut, starts)
    ends = np.minimum(np.append(cut, len(w.data))[stop], w.offsets[doc + 1])
    wordy = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, doc = starts[wordy], ends[wordy], doc[wordy]
    if not len(starts):
        return np.zeros(n, np.int64)
    lines = _gather(w.data, starts, ends).dictionary_encode()
    key = doc * len(lines.dictionary) + lines.indices.to_numpy(zero_copy_only=False)
    return np.bincount(doc, minlength=n) - np.bincount(np.unique(key) // len(lines.dictionary), minlength=n)


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    from .bpe import ragged

    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    pos = np.arange(at[-1]) + np.repeat(starts - at[:-1], ends - starts)
    return binary_array(data[pos], at)


def _repeat_words(w, size: int = 8) -> np.ndarray:
    """Words in windows of ``size`` words that occur twice or more in their text."""
    n = len(w.bounds) - 1
    ok = inside(w.bounds, size)
    if not ok.any():
        return np.zeros(n, np.int64)
    at = np.flatnonzero(ok)
    doc = w.doc_of_word[at].astype(np.uint64)
    key = windows(word_hashes(w.vocab)[w.codes], size)[at] ^ (doc * np.uint64(0x9E3779B97F4A7C15))
    ranked = np.sort(key)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    few = np.zeros(1 << 16, bool)
    few[twice >> np.uint64(48)] = True
    maybe = np.flatnonzero(few[key >> np.uint64(48)])
    place = np.searchsorted(twice, key[maybe])
    hit = maybe[twice[np.minimum(place, len(twice) - 1)] == key[maybe]]
    # equal hashes count only if the words are equal
    rows = at[hit][:, None] + np.arange(size)
    group, same = np.unique(np.column_stack([doc[hit].astype(np.int64), w.codes[rows]]), axis=0, return_inverse=True)
    real = at[hit[np.bincount(same.ravel(), minlength=len(group))[same.ravel()] > 1]]
    covered = np.zeros(len(w.codes) + 1, np.int64)
    np.add.at(covered, real, 1)
    np.add.at(covered, real + size, -1)
    return per_text(np.cumsum(covered)[:-1] > 0, w.bounds)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, score and verdict of every whole text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean) and score (double). A null or empty text has zero counts,
    fails the base and isn't kept. Repeated rows are judged each; other columns are not
    read; an empty table gives an empty result.
    """
    ratio, threshold = ratios(docs, labels, doc_id, text)
    wide = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            texts = column(part, text)
            got = surface(texts)
            score = scores(texts, wide.value)
            failed = (got["n_words"] < 20) | (100 * got["n_repeat_words"] > 30 * got["n_words"])
            out = {doc_id: column(part, doc_id)} | {k: pa.array(v.astype(np.int64)) for k, v in got.items()}
            out |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= threshold)), "score": pa.array(score)}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return docs.select(doc_id, text).mapInArrow(run, schema)
