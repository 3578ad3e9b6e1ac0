"""BPE encoding and decoding with the word-end vocabulary of a tokenizers file.

Text is first cut at ASCII white space. The vocabulary's normaliser turns white
space into one space and its pre-tokeniser drops it, NFC never joins characters
across it and no special token holds it, so the ids of a text are those of its
pieces in order. Each distinct piece is encoded once per slice: frequent ones by
a walk of the lexicon automaton, others by exact merges.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .common import written
from .words import Words, binary_array, column, give_back, raw, slices, split

#: Lexicon entries at most; more only cost memory, fewer only cost time.
LEXICON_WORDS = 65_536
#: Words outside the lexicon that a worker remembers from slice to slice.
_REMEMBERED = 100_000
#: Bytes of text in a slice.
_SLICE = 1 << 20
_LATIN = "ß-öø-ÿ"  # these letters and their capitals are stable under NFC and have one-letter lower cases
_PLAIN = re.compile(r"[\n!-~À-ÖØ-öø-ÿ]+")
# Fixed value: the pre-tokeniser's pattern that _PIECES stands for.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|\n|[^\na-z0-9{_LATIN}]+")
#: The rank of pairs that never merge.
NEVER = 1 << 40
_VOCABS: dict[str, "Vocabulary"] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in kept else next(spare)) for b in range(256)}


class Pairs:
    """Merges of a BPE file as an open-addressing table from an id pair to its rank and merged id."""

    def __init__(self, merges: list[tuple[int, int, int]]) -> None:
        self.bits = (4 * max(4, len(merges)) - 1).bit_length()
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NEVER, np.int64)
        self.to = np.zeros(1 << self.bits, np.int64)
        for rank, (left, right, to) in enumerate(merges):
            slot = self._slot(left << 16 | right)
            while self.key[slot] >= 0 and self.key[slot] != left << 16 | right:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.key[slot], self.rank[slot], self.to[slot] = left << 16 | right, rank, to

    def _slot(self, key):
        return (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; an empty slot, whose rank is NEVER, for pairs that never merge."""
        key = left << 16 | right
        slot = self._slot(key)
        seen = self.key[slot]
        wrong = np.flatnonzero((seen != key) & (seen >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            seen = self.key[slot[wrong]]
            wrong = wrong[(seen != key[wrong]) & (seen >= 0)]
        return slot


class Vocabulary:
    """Merges and names of a word-end BPE file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        steps = [s["type"] for s in (file["normalizer"] or {}).get("normalizers", [])], [s["type"] for s in (file["pre_tokenizer"] or {}).get("pretokenizers", [])]
        known = steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and file["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": _SPLIT}
        if not known or model["type"] != "BPE" or max(model["vocab"].values()) >= 1 << 16:
            raise ValueError(f"{path}: another normaliser, pre-tokeniser or id range than this encoder is exact for")
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = Pairs([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        letters = _byte_letters()
        end = model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        names = {i: t.encode() for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.names = [names.get(i, b"") for i in range(max(names) + 1)]

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of pre-tokenised words, none of them empty: (offsets, ids).

        All words take one merge a step, each its best-ranked pair and the leftmost of
        equals, so the steps are as many as the longest word needs and later ones are short.
        """
        data, at = raw(words)
        ids = self.inner[data]
        ids[at[1:] - 1] = self.last[data[at[1:] - 1]]
        done_words, done_ids, done_sizes = [], [], []
        which, sizes = np.arange(len(words)), np.diff(at)
        pairs = self.pairs
        slot = pairs.find(ids, np.append(ids[1:], 0))
        slot_rank = pairs.rank[slot]
        slot_rank[at[1:] - 1] = NEVER
        while len(which):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(slot_rank, starts)
            open_ = best < NEVER
            if not open_.all():
                keep = np.repeat(open_, sizes)
                done_words.append(which[~open_])
                done_sizes.append(sizes[~open_])
                done_ids.append(ids[~keep])
                which, sizes, best = which[open_], sizes[open_], best[open_]
                ids, slot, slot_rank = ids[keep], slot[keep], slot_rank[keep]
                if not len(which):
                    break
                starts = np.cumsum(sizes) - sizes
            at_best = np.flatnonzero(slot_rank == np.repeat(best, sizes))
            of = np.searchsorted(starts, at_best, side="right") - 1
            first = np.ones(len(of), bool)
            first[1:] = of[1:] != of[:-1]
            i = at_best[first]
            ids[i] = pairs.to[slot[i]]
            keep = np.ones(len(ids), bool)
            keep[i + 1] = False
            ended = slot_rank[i + 1] == NEVER
            ended &= i + 1 == (starts + sizes - 1)
            ids, slot, slot_rank = ids[keep], slot[keep], slot_rank[keep]
            i -= np.arange(len(i))  # one symbol is gone in each word before
            sizes = sizes - 1
            starts = np.cumsum(sizes) - sizes
            right = i[~ended]
            slot[right] = pairs.find(ids[right], ids[right + 1])
            slot_rank[right] = pairs.rank[slot[right]]
            slot_rank[i[ended]] = NEVER
            left = i[i > starts] - 1
            slot[left] = pairs.find(ids[left], ids[left + 1])
            slot_rank[left] = pairs.rank[slot[left]]
        order = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        sizes = np.concatenate(done_sizes) if done_sizes else order
        ids = np.concatenate(done_ids) if done_ids else order
        at = np.zeros(len(order) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        back = np.argsort(order, kind="stable")
        out = np.zeros(len(order) + 1, np.int64)
        np.cumsum(sizes[back], out=out[1:])
        return out, ids[ragged(at, back)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that hold no ASCII white space: (offsets, ids)."""
        joined = "\n".join(words)
        if "<|" not in joined and _PLAIN.fullmatch(joined):
            return self._plain(joined, len(words))
        plain = np.array([bool(w) and "<|" not in w and _PLAIN.fullmatch(w) is not None for w in words], bool)
        at, ids = self._plain("\n".join(w for w, p in zip(words, plain) if p), int(plain.sum()))
        odd = [self.library.encode(w, add_special_tokens=False).ids for w, p in zip(words, plain) if not p]
        sizes = np.zeros(len(words), np.int64)
        sizes[plain], sizes[~plain] = np.diff(at), [len(x) for x in odd]
        out = np.zeros(len(words) + 1, np.int64)
        np.cumsum(sizes, out=out[1:])
        all_ids = np.zeros(out[-1], np.int64)
        mine = np.repeat(plain, sizes)
        all_ids[mine] = ids
        all_ids[~mine] = [i for x in odd for i in x]
        return out, all_ids

    def _plain(self, joined: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not n:
            return np.zeros(1, np.int64), np.zeros(0, np.int64)
        found = pa.array(_PIECES.findall(joined.lower()), pa.large_string()).dictionary_encode()
        codes, pieces = found.indices.to_numpy(zero_copy_only=False), found.dictionary
        ends = np.flatnonzero(pc.equal(pieces, "\n").to_numpy(zero_copy_only=False))
        at, ids = self.merge(pieces)
        is_end = codes == (ends[0] if len(ends) else -1)
        word = np.cumsum(is_end)[~is_end]
        codes = codes[~is_end]
        sizes = np.bincount(word, weights=(at[1:] - at[:-1])[codes], minlength=n).astype(np.int64)
        out = np.zeros(n + 1, np.int64)
        np.cumsum(sizes, out=out[1:])
        return out, ids[ragged(at, codes)]


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per worker."""
    if path not in _VOCABS:
        _VOCABS[path] = Vocabulary(path)
        give_back()
    return _VOCABS[path]


def frequent_words(docs: DataFrame, text: str = "text", size: int = LEXICON_WORDS) -> DataFrame:
    """The words that occur most, counted over all texts: those from a count on that at most ``size`` words reach.

    Each task keeps lossy counts: when it holds more than four times ``size``
    words it drops those seen least, and it hands on its ``size`` most frequent.
    A dropped word can only miss the lexicon, never change a result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def summed(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

        waiting: list[pa.Table] = []
        rows = 0
        for part in slices(batches, text):
            w = split(column(part, text))
            waiting.append(pa.table({"word": w.vocab, "n": np.bincount(w.codes, minlength=len(w.vocab)).astype(np.int64)}))
            rows += len(w.vocab)
            if rows > 4 * size:
                held = summed(waiting)
                if len(held) > 2 * size:
                    floor = -np.partition(-held["n"].to_numpy(), 2 * size)[2 * size]
                    held = held.filter(pc.greater(held["n"], int(floor)))
                waiting, rows = [held], len(held)
        if waiting:
            held = summed(waiting)
            held = held.filter(pc.greater(held["n"], 1))
            held = held.sort_by([("n", "descending"), ("word", "ascending")]).slice(0, size)
            for b in held.set_column(0, "word", held["word"].cast(pa.binary())).to_batches(max_chunksize=20_000):
                yield b

    counted = docs.select(text).mapInArrow(count, "word binary, n long")
    words = written(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    # the least count that no more than ``size`` words reach, from how many words have each magnitude (16 steps a doubling)
    step = F.floor(16 * F.log2("n"))
    room, floor = size, None
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r.step):
        room -= r.k
        if room < 0:
            break
        floor = r.n
    return words.filter(F.col("n") >= floor) if floor is not None else words.limit(0)


def make_lexicon(docs: DataFrame, vocab_path: str, text: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """Compiles the frequent words of all texts with their ids; at most ``size`` words reach the driver."""
    vocab = vocabulary(vocab_path)
    words = [w for w in frequent_words(docs, text, size).toArrow()["word"].to_pylist() if len(w) <= 64]
    at, ids = vocab.encode([w.decode("utf-8") for w in words])
    compiled = lexicon.build({w: ids[a:b].tolist() for w, a, b in zip(words, at, at[1:])})
    give_back()
    return compiled


class SliceEncoder:
    """Encodes slices of texts: by the lexicon, by what earlier slices of this worker held, or by merging."""

    def __init__(self, vocab_path: str, compiled: bytes | None) -> None:
        self.vocab = vocabulary(vocab_path)
        self.lexicon = lexicon.mapped(compiled) if compiled else None
        self.words = pa.array([], pa.large_binary())
        self.at, self.kept = np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def ids(self, texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words of texts, and offsets and ids of the distinct ones."""
        w = split(texts)
        n = len(w.vocab)
        row = self.lexicon.find(w.vocab) if self.lexicon else np.full(n, -1, np.int64)
        tables = [(self.lexicon.offsets.astype(np.int64), self.lexicon.ids)] if self.lexicon else []
        base = self.lexicon.size if self.lexicon else 0
        left = np.flatnonzero(row < 0)
        rest = w.vocab.take(pa.array(left))
        old = pc.index_in(rest, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        row[left[old >= 0]] = base + old[old >= 0]
        tables.append((self.at, self.kept))
        base += len(self.words)
        new = left[old < 0]
        fresh = w.vocab.take(pa.array(new))
        at, ids = self.vocab.encode([x.decode("utf-8") for x in fresh.to_pylist()])
        ids = ids.astype(np.uint16)
        row[new] = base + np.arange(len(new))
        tables.append((at, ids))
        sizes = np.concatenate([np.diff(a) for a, _ in tables])
        starts = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=starts[1:])
        out = np.zeros(n + 1, np.int64)
        np.cumsum(sizes[row], out=out[1:])
        flat = np.concatenate([x for _, x in tables])[ragged(starts, row)]
        if len(self.words) + len(new) > _REMEMBERED:
            hit = np.unique(old[old >= 0]) if len(new) < _REMEMBERED else np.zeros(0, np.int64)
            hit = hit[: max(0, _REMEMBERED - len(new))]
            self.kept = self.kept[ragged(self.at, hit)]
            self.at = np.concatenate([[0], np.cumsum(np.diff(self.at)[hit])]).astype(np.int64)
            self.words = self.words.take(pa.array(hit))
        self.words = pa.concat_arrays([self.words, fresh])
        self.kept = np.concatenate([self.kept, ids])
        self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
        return w, out, flat


def ragged(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions of the entries of the given rows, one row after another; at holds row offsets."""
    sizes = at[rows + 1] - at[rows]
    total = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    return np.arange(total[-1]) + np.repeat(at[rows] - total[:-1], sizes)


def _joined(names: pa.Array, at: np.ndarray, ids: np.ndarray) -> pa.Array:
    """For each row of ids, the names of its ids."""
    data, inner = raw(names.take(pa.array(ids.astype(np.int32))))
    return binary_array(data, inner[at])


def encode_decode(docs: DataFrame, vocab_path: str, compiled: bytes | None, doc_id: str = "doc_id", text: str = "text", *, full: bool = False) -> DataFrame:
    """Encodes each whole text and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space) and
    decoded_sha256; with ``full`` also ids (array<int>) and decoded (the text).
    A null text counts as empty: no ids, digests of the empty string. Repeated rows
    give repeated rows, an empty table an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compiled)  # at most LEXICON_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = SliceEncoder(vocab_path, shared.value)
        decimal = pa.array([b"%d " % i for i in range(len(enc.vocab.names))], pa.large_binary())
        tokens = pa.array([n + b" " for n in enc.vocab.names], pa.large_binary())
        for part in slices(batches, text, _SLICE):
            w, at, ids = enc.ids(column(part, text))
            order = pa.array(w.codes)
            count = np.zeros(len(order) + 1, np.int64)
            np.cumsum(np.diff(at)[w.codes], out=count[1:])
            count = count[w.bounds]
            digests, decoded = [], []
            for table in (decimal, tokens):
                data, inner = raw(_joined(table, at, ids).take(order))
                view, ends = memoryview(data), inner[w.bounds]
                digests.append([hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:])])
                if full and table is tokens:
                    decoded = [bytes(view[a : max(a, b - 1)]).decode("utf-8") for a, b in zip(ends[:-1], ends[1:])]
                del data, view
            out = {doc_id: column(part, doc_id), "n_tokens": pa.array(np.diff(count)), "ids_sha256": pa.array(digests[0], pa.string()), "decoded_sha256": pa.array(digests[1], pa.string())}
            if full:
                flat = ids[ragged(at, w.codes)].astype(np.int32)
                out |= {"ids": pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(flat)), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return docs.select(doc_id, text).mapInArrow(run, schema)
