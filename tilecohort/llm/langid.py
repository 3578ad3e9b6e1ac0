"""Language identification of mixed text.

A word's script narrows the languages it can be; its character trigrams and the
word itself score each of those; Viterbi with a switching penalty labels every
word, and equal neighbours form spans. Scores are integers (1/256 nat), so
results don't depend on the order of additions.

A text whose best single-language path can't be beaten is settled for a whole
slice at once: with gains of another language over it of at most half the
penalty on every run of words, no path that switches does better. The others run
through the word-by-word recurrence.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_by_hash
from .words import column, per_text, raw, slices, split, windows, word_hashes

BUCKETS = 1 << 17
#: Labelled documents of each language that the scores are learned from, at most.
SAMPLE = 2048
#: Switching penalty, in 1/256 nat.
PENALTY = 20 * 256
#: Most that one word can speak for one language over another, in nats.
WORD_LIMIT = 6.0
#: What a word speaks against a language that doesn't use its script, in nats.
FOREIGN = 12.0
#: Words of a script a language must have, as a share, to be a candidate for it.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: Bytes of text in a slice; a slice needs some twenty times as much memory.
_SLICE = 1 << 20

# First code point of each run of a script, from the Unicode block list.
_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"),
    (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"),
    (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
SCRIPTS = sorted({s for _, s in _RANGES})
_FROM = np.array([f for f, _ in _RANGES], np.uint32)
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in _RANGES], np.int8)
_LETTERS: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter; what is found once is kept."""
    if not _LETTERS:
        _LETTERS.append(np.full(0x110000, -1, np.int8))
    known = _LETTERS[0]
    for p in np.unique(points[known[points] < 0]).tolist():
        known[p] = unicodedata.category(chr(p))[0] == "L"
    return known[points] > 0


def word_facts(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each word, and the script of its first letter (-1: none)."""
    data, at = raw(vocab)
    if not len(at) - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    bounds = first[at]
    letter = _is_letter(points)
    count = per_text(letter, bounds)
    where = np.append(np.flatnonzero(letter), len(points))
    lead = where[np.searchsorted(where, bounds[:-1])]
    script = _SCRIPT[np.searchsorted(_FROM, points[np.minimum(lead, len(points) - 1)], side="right") - 1].astype(np.int64)
    return count, np.where(count > 0, script, -1)


def features(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each word's byte trigrams (with its borders) and of the word itself: (cells, offsets)."""
    data, at = raw(vocab)
    # a capital of the first accented block is its small letter plus 0x20 in the second byte
    low = data.copy()
    second = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    low[second] += 0x20
    sizes = np.diff(at)
    padded_at = np.zeros(len(at), np.int64)
    np.cumsum(sizes + 2, out=padded_at[1:])
    padded = np.full(padded_at[-1], 0x20, np.uint64)
    padded[np.arange(len(data)) + np.repeat(padded_at[:-1] - at[:-1] + 1, sizes)] = low
    grams = windows(padded, 3, seed=5)
    # a word of n bytes has n trigrams; then one cell for the word
    cells_at = np.zeros(len(at), np.int64)
    np.cumsum(sizes + 1, out=cells_at[1:])
    cells = np.zeros(cells_at[-1], np.uint64)
    place = np.arange(int(sizes.sum()))
    cells[place + np.repeat(cells_at[:-1] - at[:-1], sizes)] = grams[place + np.repeat(padded_at[:-1] - at[:-1], sizes)] if len(place) else 0
    from .words import binary_array

    cells[cells_at[1:] - 1] = word_hashes(binary_array(low, at), seed=6)
    return (cells >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), cells_at


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS + 1 by languages, log shares less their mean
    allowed: np.ndarray  # scripts by languages

    def word_scores(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(integer score of each word for each language, its letters); words with no candidate score 0 for all."""
        letters, script = word_facts(vocab)
        cells, at = features(vocab)
        out = np.zeros((len(vocab), len(self.languages)))
        if len(vocab):
            for j in range(len(self.languages)):
                out[:, j] = np.add.reduceat(self.weights[:, j][cells], at[:-1])
        allowed = self.allowed[script] & (script >= 0)[:, None]
        out[~allowed] = -np.inf
        out[~allowed.any(1)] = 0
        out -= out.max(1, keepdims=True) if len(vocab) else 0
        out = np.where(np.isfinite(out), np.maximum(out, -WORD_LIMIT), -FOREIGN)
        return (out * 256).round().astype(np.int64), letters


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from at most SAMPLE rows of each language with text and a non-null lang, the first by a hash of the id.

    The driver gets BUCKETS sums a language. With no such row the model knows no language. An id that stands in several languages teaches each by its
    own rows; repeated rows teach each time.
    """
    named = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"))
    chosen = first_by_hash(named, ["lang"], "id", "lang", SAMPLE).distinct().collect()  # SAMPLE ids of each language at most
    languages = sorted({r.lang for r in chosen})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    index = {l: i for i, l in enumerate(languages)}
    ids = docs.sparkSession.createDataFrame([(r.id, r.lang, index[r.lang]) for r in chosen], T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("lang", T.StringType()), T.StructField("l", T.IntegerType())]))
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("t")).join(F.broadcast(ids), ["id", "lang"]).select("t", "l")
    n = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * BUCKETS, np.int64)
        scripts = np.zeros(n * len(SCRIPTS), np.int64)
        for part in slices(batches, "t"):
            w = split(column(part, "t"), lower=True)
            label = column(part, "l").to_numpy()
            key, times = np.unique(label[w.doc_of_word] * np.int64(max(1, len(w.vocab))) + w.codes, return_counts=True)
            label, word = key // max(1, len(w.vocab)), key % max(1, len(w.vocab))
            cells, at = features(w.vocab)
            size = np.diff(at)[word]
            from .bpe import ragged

            total += np.bincount(np.repeat(label * BUCKETS, size) + cells[ragged(at, word)], weights=np.repeat(times, size), minlength=n * BUCKETS).astype(np.int64)
            _, script = word_facts(w.vocab)
            ok = script[word] >= 0
            scripts += np.bincount(label[ok] * len(SCRIPTS) + script[word][ok], weights=times[ok], minlength=n * len(SCRIPTS)).astype(np.int64)
        both = np.concatenate([total, scripts])
        seen = np.flatnonzero(both)
        for i in range(0, len(seen), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(seen[i : i + 20_000]), pa.array(both[seen[i : i + 20_000]])], names=["cell", "n"])

    both = np.zeros(n * (BUCKETS + len(SCRIPTS)))
    summed = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    both[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    counts = both[: n * BUCKETS].reshape(n, BUCKETS).T
    scripts = both[n * BUCKETS :].reshape(n, len(SCRIPTS)).T
    logs = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * BUCKETS))
    return Model(languages, logs - logs.mean(1, keepdims=True), scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0)))


def label_words(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best label of every word: Viterbi with PENALTY for each change, ties to the smaller label."""
    n, k = scores.shape
    docs = len(bounds) - 1
    total = np.column_stack([per_text(scores[:, j], bounds) for j in range(k)])
    best = total.argmax(1)
    out = np.repeat(best, np.diff(bounds))
    if k < 2 or not n:
        return out
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    own = scores[np.arange(n), out]
    rival = np.zeros(docs, np.int64)
    span = int(np.abs(scores).sum(dtype=np.int64)) + 1
    for j in range(k):
        run = np.zeros(n + 1, np.int64)
        np.cumsum(scores[:, j] - own, out=run[1:])
        # prefix sums fall by more than their range from text to text, so a running minimum starts anew in each
        drop = run[:-1] - run[bounds[:-1]][doc] - doc * min(2 * span, (1 << 62) // max(1, docs))
        gain = run[1:] - run[bounds[:-1]][doc] - doc * min(2 * span, (1 << 62) // max(1, docs)) - np.minimum.accumulate(drop)
        peak = np.maximum.reduceat(gain, bounds[:-1][np.diff(bounds) > 0])
        rival[np.diff(bounds) > 0] = np.maximum(rival[np.diff(bounds) > 0], peak)
    for d in np.flatnonzero(rival > PENALTY // 2):
        a, b = int(bounds[d]), int(bounds[d + 1])
        out[a:b] = viterbi(scores[a:b].tolist())
    return out


def viterbi(scores: list[list[int]]) -> list[int]:
    """The word-by-word recurrence."""
    k = range(len(scores[0]))
    value, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(value)
        lead = value.index(top)
        top -= PENALTY
        back.append([lead if top > v else j for j, v in enumerate(value)])
        value = [(top if top > v else v) + row[j] for j, v in enumerate(value)]
    at = value.index(max(value))
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return path[::-1]


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """Language of every whole text, and its spans.

    Returns doc_id, the columns in ``keep``, lang_pred (most letters among the labelled words;
    ``und`` if text is null or has no letter, or the model knows no language), score (0 to 1: the
    share of letters so labelled, damped while the evidence is weak) and spans, an array of
    (lang, first word, words). Repeated rows are judged each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [doc_id] + (keep or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.languages)
        kinds = pa.array([*m.languages, UNKNOWN], pa.string())
        for part in slices(batches, text, _SLICE):
            w = split(column(part, text), lower=True)
            by_word, letters = m.word_scores(w.vocab) if k else (np.zeros((len(w.vocab), 0), np.int64), word_facts(w.vocab)[0])
            scores, letters = by_word[w.codes], letters[w.codes]
            n = len(w.bounds) - 1
            label = label_words(scores, w.bounds) if k else np.zeros(len(w.codes), np.int64)
            doc = w.doc_of_word
            by_doc = np.bincount(doc * max(1, k) + label, weights=letters, minlength=n * max(1, k)).reshape(n, max(1, k))
            all_letters = by_doc.sum(1)
            pred = by_doc.argmax(1)
            share = by_doc[np.arange(n), pred] / np.maximum(1, all_letters)
            total = np.column_stack([per_text(scores[:, j], w.bounds) for j in range(k)]) if k else np.zeros((n, 1))
            lead = total[np.arange(n), pred]
            total[np.arange(n), pred] = np.iinfo(np.int64).min if k else 0
            margin = np.clip((lead - (total.max(1) if k > 1 else lead - 1280)) / 256, -30, 30)
            known = (all_letters > 0) & (k > 0)
            score = np.where(known, share * np.where(share > 0.999, 1 / (1 + np.exp(-margin)), 1.0), 0.0)
            change = np.ones(len(label), bool)
            change[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(change)
            size = np.diff(np.append(at, len(label)))
            span_at = np.searchsorted(at, w.bounds)
            span = pa.StructArray.from_arrays([kinds.take(pa.array(np.where(k > 0, label[at], k))), pa.array((at - w.bounds[doc[at]]).astype(np.int32)), pa.array(size.astype(np.int32))], names=["lang", "first_word", "words"])
            out = {c: column(part, c) for c in keep} | {"lang_pred": kinds.take(pa.array(np.where(known, pred, k))), "score": pa.array(score), "spans": pa.ListArray.from_arrays(pa.array(span_at.astype(np.int32)), span)}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double, spans array<struct<lang:string,first_word:int,words:int>>"
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
