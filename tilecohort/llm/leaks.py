"""Benchmark decontamination by latent semantic retrieval.

Passages are weighted by TF-IDF over CELLS hashed terms, with block frequencies of
the whole corpus. A randomised SVD of all its passages together with the items
(a range finder, a power step, then the small eigenproblem of its image) gives RANK
directions. Every passage of every text is projected there and compared with every item
by cosine. A passage that holds a whole item and much other text besides has a cosine of the item's length over its own at
best, so it is a candidate from REACH of that cosine on, which doesn't depend on what surrounds the item. A basis serves MAX_ITEMS items at most, for it loses
items beyond a few times its rank; larger benchmarks get several.
Candidates go through the checks: the longest common subsequence, the item's
informative words, and its answer (the item's end). A passage with a cosine of NEAR, mostly made of the item, may
be a freer paraphrase: it needs a shorter subsequence, but more of the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .words import LOWER, column, give_back, slices, split, word_hashes

CELLS = 1 << 15
#: Words of a block; a passage is two or three successive blocks of a text.
BLOCK = 32
#: Passages of a row of bags, multiplied at once: few, for their common cells make the columns.
PACK = 32
#: Passages of a task of the fit, and tasks at most; a task sends CELLS * RANK numbers.
_PASSAGES_OF_TASK, _TASKS = 1 << 16, 256
RANK = 128
#: Items of one basis; more go through in several searches.
MAX_ITEMS = 256
#: Sums of the sketch that a passage is added to; with one, passages that meet there could not be told apart.
_SUMS = 3
#: Longest piece of an item; longer items are cut and any piece counts.
PIECE = 60
SUBSEQUENCE, INFORMATIVE, ANSWER, SURE = 0.65, 0.6, 0.5, 0.8
#: Share of the cosine of a passage that holds all of an item, from which it is a candidate.
REACH = 0.5
#: Cosine of a passage that may be a freer paraphrase, and what that needs.
NEAR = 0.5
FREE_SUBSEQUENCE, FREE_INFORMATIVE, FREE_ANSWER = 0.5, 0.55, 0.75
_CELLS_OF_SEARCH = 1 << 20
_BLOCKS_OF_CELLS = 64
_BLOCKS_AT_ONCE = 48
_SLICE = 1 << 20
_TABLE = LOWER.copy()
_TABLE[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 0x20


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _split(texts: pa.Array):
    """Words without ASCII punctuation, lower case; their hashes; first block of each text and block of each word."""
    w = split(texts, table=_TABLE)
    n = np.diff(w.bounds)
    first = np.concatenate([[0], np.cumsum(-(-n // BLOCK))])
    block = np.repeat(first[:-1], n) + (np.arange(len(w.codes)) - np.repeat(w.bounds[:-1], n)) // BLOCK
    return w, word_hashes(w.vocab, seed=21), first, block


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]  # hashes of each piece's words, in order
    owner: np.ndarray  # which id each piece is of

    @property
    def bags(self) -> list[np.ndarray]:
        return [_cells(x) for x in self.words]


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Items:
    """The items; rows with a null id or without a word are left out."""
    rows = benchmark.select(item_id, text).filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).collect()  # a share: MAX_ITEMS pieces at most, or one item
    found = Items([], [], np.zeros(0, np.int64))
    owner = []
    if rows:
        w, h, _, _ = _split(pa.array([r[1] for r in rows], pa.string()))
        for i, r in enumerate(rows):
            x = h[w.codes[w.bounds[i] : w.bounds[i + 1]]]
            if len(x):
                parts = np.array_split(x, -(-len(x) // PIECE))
                owner += [len(found.ids)] * len(parts)
                found.ids.append(r[0])
                found.words += parts
    found.owner = np.array(owner, np.int64)
    return found


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (cell, n): blocks that hold the cell, under cell -1 the number of blocks and under -2 that of passages; rows (bag, tf, sizes): the cells of all passages, PACK a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, blocks, passages = np.zeros(CELLS, np.int64), 0, 0
        for part in slices(batches, text, _SLICE):
            w, h, first, block = _split(column(part, text))
            if not len(w.codes):
                continue
            cell = _cells(h)[w.codes]
            blocks += int(first[-1])
            # passages are every third block of a text with the two after it
            of_text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            count = -(-np.diff(first) // 3)
            passage = (np.cumsum(count) - count)[of_text] + (np.arange(first[-1]) - first[:-1][of_text]) // 3
            # one order by passage, cell and block of the passage serves the blocks' counts and the passages' cells
            place = (np.arange(first[-1]) - first[:-1][of_text]) % 3
            order = np.sort((passage[block] * CELLS + cell) * 4 + place[block])
            df += np.bincount(order[np.append(True, order[1:] != order[:-1])] // 4 % CELLS, minlength=CELLS)
            order //= 4
            lead = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
            key, tf = order[lead], np.diff(np.append(lead, len(order)))
            size = np.bincount(key // CELLS)
            passages += len(size)
            at = np.concatenate([[0], np.cumsum(size)])
            packs = [(slice(at[i], at[min(i + PACK, len(size))]), slice(i, i + PACK)) for i in range(0, len(size), PACK)]
            low, tf, size = (key % CELLS).astype(np.uint16), tf.astype(np.uint8), size.astype(np.uint8)  # a passage has 3 * BLOCK words at most
            none = pa.nulls(len(packs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *(pa.array([x[p[k]].tobytes() for p in packs], pa.binary()) for x, k in ((low, 0), (tf, 0), (size, 1)))], names=names)
        if blocks:
            seen = np.append(np.flatnonzero(df), [-1, -2])
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(np.append(df[seen[:-2]], [blocks, passages])), *[pa.nulls(len(seen), pa.binary())] * 3], names=names)

    names = ["cell", "n", "bag", "tf", "sizes"]
    return docs.select(text).mapInArrow(run, "cell long, n long, bag binary, tf binary, sizes binary")


def _vector(bag: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a bag and their weights, of length 1."""
    cell, tf = np.unique(bag, return_counts=True)
    x = tf * idf[cell]
    return cell, x / max(1e-9, float(np.sqrt((x * x).sum())))


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """Columns that span those of z, from the eigenvectors of the small Gram matrix; directions without weight become zeros."""
    for _ in range(2):
        value, vector = np.linalg.eigh(z.T.astype(float) @ z)
        keep = value > 1e-9 * max(float(value.max(initial=0)), 1e-30)
        z = z @ (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
    return np.pad(z, ((0, 0), (0, RANK - z.shape[1])))


def _held(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells in order, and the place of each cell among them."""
    held = np.zeros(CELLS, bool)
    held[cell] = True
    return np.flatnonzero(held), (np.cumsum(held) - 1)[cell]


def _passages(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, cell, weight) of the entries of each pack of passages, every passage of length 1 times its weight; bags without sizes are one passage."""
    for bag, tf, sizes, weight in zip(*(column(batch, c).to_pylist() for c in ("bag", "tf", "sizes", "weight"))):
        if sizes is None:
            cell, x = _vector(np.frombuffer(bag, np.int32), idf)
            yield np.zeros(len(cell), np.int64), cell, (x * weight).astype(np.float32)
        else:
            cell, size = np.frombuffer(bag, np.uint16).astype(np.int64), np.frombuffer(sizes, np.uint8).astype(np.int64)
            x = np.frombuffer(tf, np.uint8) * idf[cell]
            length = np.maximum(1e-9, np.sqrt(np.add.reduceat(x * x, np.cumsum(size) - size)))
            row = np.repeat(np.arange(len(size)), size)
            yield row, cell, (x / length[row] * weight).astype(np.float32)


def basis(bags: DataFrame, idf: np.ndarray, seed: int = 5) -> np.ndarray:
    """CELLS by RANK: the leading right singular vectors of the weighted bags, by a randomised SVD.

    bags: (bag binary, weight double), or packs of passages with tf and sizes as ``statistics`` makes them. Two passes over all of them:
    a random sketch adds each passage under random signs to _SUMS of RANK sums; their span goes through a power step, whose
    image gives the singular vectors (Nystroem's method). Each task sums a_i (a_i . Q) over its rows, blocks of cells are
    summed in the cluster and the driver gets CELLS * RANK numbers a pass.
    """
    spark = bags.sparkSession
    bags = bags.select("bag", "weight", *[F.col(c) if c in bags.columns else F.lit(None).cast("binary").alias(c) for c in ("tf", "sizes")])
    shared = spark.sparkContext.broadcast(idf)
    width = CELLS // _BLOCKS_OF_CELLS

    def image(q: np.ndarray | None) -> np.ndarray:
        sketch = spark.sparkContext.broadcast(q)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, z = sketch.value, np.zeros((CELLS, RANK), np.float32)
            rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
            for batch in batches:
                for row, cell, x in _passages(batch, shared.value):
                    n = int(row[-1]) + 1 if len(row) else 0
                    if q is None:
                        for _ in range(_SUMS):
                            np.add.at(z.reshape(-1), cell * RANK + rng.integers(0, RANK, n)[row], x * rng.choice(np.array([-1, 1], np.float32), n)[row])
                    else:
                        some, place = _held(cell)
                        dense = np.zeros((n, len(some)), np.float32)
                        dense[row, place] = x
                        z[some] += dense.T @ (dense @ q[some])
            if z.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BLOCKS_OF_CELLS)), pa.array([z[i * width : (i + 1) * width].tobytes() for i in range(_BLOCKS_OF_CELLS)], pa.binary())], names=["block", "z"])
            del q, z
            give_back()

        def add(table: pa.Table) -> pa.Table:
            z = np.zeros(width * RANK)
            for b in table["z"]:
                z += np.frombuffer(b.as_buffer(), np.float32)
            return pa.table({"block": table["block"].slice(0, 1), "z": pa.array([z.astype(np.float32).tobytes()], pa.binary())})

        z = np.zeros((CELLS, RANK), np.float32)
        summed = bags.mapInArrow(partial, "block long, z binary").groupBy("block").applyInArrow(add, "block long, z binary").toArrow()
        for block, part in zip(summed["block"].to_pylist(), summed["z"]):
            z[block * width : (block + 1) * width] = np.frombuffer(part.as_buffer(), np.float32).reshape(width, RANK)
        del summed
        sketch.destroy()
        return z

    q = _orthonormal(image(None))
    z = image(q)
    value, vector = np.linalg.eigh(q.T.astype(float) @ z)
    keep = value > 1e-7 * max(float(value.max()), 1e-30)
    z = z @ (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)  # its left singular vectors are those wanted
    value, vector = np.linalg.eigh(z.T.astype(float) @ z)
    keep = np.flatnonzero(value > 1e-7 * max(float(value.max(initial=0)), 1e-30))[::-1]
    q = z @ (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
    shared.destroy()
    give_back()
    return np.pad(q, ((0, 0), (0, RANK - q.shape[1])))


def common_subsequence(x: list, at: dict, n: int) -> int:
    """Length of the longest common subsequence of x and a sequence of n whose places are the bits of at."""
    state = full = (1 << n) - 1
    for word in x:
        match = at.get(word, 0)
        if match:
            u = state & match
            state = ((state + u) | (state - u)) & full
    return n - state.bit_count()


@dataclass
class Index:
    items: Items
    idf: np.ndarray
    rows: np.ndarray  # CELLS by RANK: weighted rows of the basis
    latent: np.ndarray  # pieces by RANK, of length 1
    length: np.ndarray  # of the pieces' projections before that

    def search(self, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """Findings of a slice: (text, item, cosine, share of common subsequence, share of answer), the best of each text and item."""
        w, h, first, block = _split(texts)
        if not int(first[-1]) or not len(self.latent):
            return []
        start = np.searchsorted(block, np.arange(first[-1] + 1))
        last = np.repeat(first[1:], np.diff(first)) - 1
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        codes = h[w.codes]
        found: dict[tuple[int, int], tuple] = {}
        for i, j, cosine in zip(*(x.tolist() for x in self._near(_cells(h)[w.codes], start, last))):
            stop = min(i + 2, int(last[i])) + 1
            checked = self._check(codes[start[i] : start[stop]].tolist(), j, cosine >= NEAR)
            if checked:
                near = max(self._cosine(codes[start[i] : start[k]], j) for k in range(min(i + 2, stop), stop + 1))
                key = (int(doc[i]), int(self.items.owner[j]))
                found[key] = max(found.get(key, (0.0,) * 3), (checked[0], near, checked[1]))
        return [(d, i, near, share, answer) for (d, i), (share, near, answer) in sorted(found.items())]

    def _near(self, cells: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first block, piece, cosine) of the passages whose cosine is at least REACH of what one holding all of the piece would have."""
        n = len(start) - 1
        vector, square = np.zeros((n, RANK), np.float32), np.add.reduceat(self.idf[cells] ** 2, start[:-1])
        for i in range(0, n, _BLOCKS_AT_ONCE):
            stop = min(n, i + _BLOCKS_AT_ONCE)
            cell, block = cells[start[i] : start[stop]], np.repeat(np.arange(stop - i), np.diff(start[i : stop + 1]))
            some, place = _held(cell)
            vector[i:stop] = np.bincount(block * len(some) + place, minlength=(stop - i) * len(some)).astype(np.float32).reshape(stop - i, -1) @ self.rows[some]
        # a passage is a block with the two after it, as far as its text goes
        own_vector, own_square = vector.copy(), square.copy()
        for k in (1, 2):
            more = np.flatnonzero(np.arange(n) + k <= last)
            vector[more] += own_vector[more + k]
            square[more] += own_square[more + k]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        length = np.sqrt(np.maximum(square, 1e-10))
        # a projection shorter than REACH of the shortest piece's reaches none
        far = np.flatnonzero(np.einsum("ij,ij->i", vector, vector) >= (REACH * self.length.min()) ** 2)
        step = max(1, _CELLS_OF_SEARCH // max(1, len(self.latent)))
        for i in range(0, len(far), step):
            own = far[i : i + step]
            product = vector[own] @ self.latent.T
            a, j = np.nonzero(product >= REACH * self.length[None, :])
            out.append((own[a], j, product[a, j] / length[own[a]]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _cosine(self, words: np.ndarray, piece: int) -> float:
        cell = _cells(words)
        return float(self.rows[cell].sum(0) @ self.latent[piece] / max(1e-5, np.sqrt((self.idf[cell].astype(float) ** 2).sum())))

    def _check(self, x: list[int], piece: int, near: bool = False) -> tuple[float, float] | None:
        """(share of common subsequence, share of answer) of a passage with words x, or None; ``near`` says that its cosine is NEAR at least."""
        words = self.items.words[piece].tolist()
        n = len(words)
        at: dict[int, int] = {}
        for p, word in enumerate(words):
            at[word] = at.get(word, 0) | 1 << p
        there = set(x)
        if sum(word in there for word in words) < FREE_SUBSEQUENCE * n:  # a subsequence has no more words than both share
            return None
        share = common_subsequence(x, at, n) / n
        if share < (FREE_SUBSEQUENCE if near else SUBSEQUENCE):
            return None
        mass = self.idf[_cells(self.items.words[piece])] + 1e-6
        has = np.array([word in there for word in words])
        tail = slice(n - max(1, n // 4), n)
        answer = float(mass[tail][has[tail]].sum() / mass[tail].sum())
        held = mass[has].sum() / mass.sum()
        strict = share >= SUBSEQUENCE and held >= INFORMATIVE and (answer >= ANSWER or share >= SURE)
        free = near and held >= FREE_INFORMATIVE and answer >= FREE_ANSWER
        return (share, answer) if strict or free else None


def build(stats: DataFrame, idf: np.ndarray, items: Items, passages: int) -> Index:
    """Index of the items; the basis comes from all passages of the texts and the items, which weigh as much together."""
    spark = stats.sparkSession
    weight = float(np.sqrt(max(1, passages) / max(1, len(items.words))))
    bags = [(x.astype(np.int32).tobytes(), weight) for x in items.bags]
    corpus = stats.filter("bag IS NOT NULL").select("bag", "tf", "sizes", F.lit(1.0).alias("weight"))
    both = corpus.unionByName(spark.createDataFrame(bags, "bag binary, weight double"), allowMissingColumns=True) if bags else corpus
    q = basis(both.coalesce(min(_TASKS, -(-max(1, passages) // _PASSAGES_OF_TASK))), idf) if bags else np.zeros((CELLS, RANK), np.float32)
    short = idf.astype(np.float32)
    rows = q * short[:, None]
    latent = np.array([rows[bag].sum(0) for bag in items.bags], np.float32).reshape(-1, RANK)
    length = np.maximum(np.sqrt((latent * latent).sum(1)), 1e-6)
    return Index(items, short, rows, latent / length[:, None], length)


def _shares(benchmark: DataFrame, item_id: str, text: str, depth: int = 0) -> list[DataFrame]:
    """The items in shares of MAX_ITEMS pieces at most, halved by bits of a hash of id and text; items that are repeated whole count once."""
    pieces = F.greatest(F.lit(1), F.ceil(F.size(F.split(F.coalesce(text, F.lit("")), r"\s+")) / PIECE))
    if depth == 0:
        benchmark = benchmark.select(item_id, text).filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).distinct()
    if benchmark.count() <= 1 or benchmark.agg(F.sum(pieces)).first()[0] <= MAX_ITEMS or depth == 64:
        return [benchmark]
    bit = F.shiftrightunsigned(F.xxhash64(item_id, text), depth).bitwiseAND(F.lit(1))
    return [half for side in (0, 1) for half in _shares(benchmark.filter(bit == side), item_id, text, depth + 1)]


def _indexes(docs: DataFrame, benchmark: DataFrame, item_id: str, text: str, item_text: str = "text") -> list[Index]:
    shares = _shares(benchmark, item_id, item_text)
    stats = written(statistics(docs, text), "terms")
    summed = stats.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS + 1 rows
    df = np.zeros(CELLS + 2)  # cells -1 and -2 are the last ones
    df[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    df, passages, blocks = df[:-2], df[-2], df[-1]
    idf = np.maximum(0, np.log((blocks + 1) / (df + 0.5)))
    found = [build(stats, idf, items_of(b, item_id, item_text), int(passages)) for b in shares]
    discard(stats)
    return found


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, cosine, common (share of the item in order) and answer.

    Every whole text is searched. A null text holds nothing; an empty benchmark finds nothing; repeated rows
    are found each. Other columns are not read.
    """
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    out = None
    for index in _indexes(docs, benchmark, item_id, text):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # CELLS * RANK numbers and MAX_ITEMS items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text, _SLICE):
                rows = shared.value.search(column(part, text))
                if rows:
                    d, i, near, share, answer = zip(*rows)
                    yield pa.RecordBatch.from_arrays([column(part, doc_id).take(pa.array(d)), pa.array([shared.value.items.ids[k] for k in i]), pa.array(near), pa.array(share), pa.array(answer)], names=[doc_id, item_id, "cosine", "common", "answer"])

        part = docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, cosine double, common double, answer double")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of docs, all columns whatever their names, that hold no benchmark item.

    Rows with a null or empty text stay, repeated rows go or stay alike, an empty table stays empty.
    """
    for index in _indexes(docs, benchmark, item_id, text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text, _SLICE):
                bad = np.zeros(part.num_rows, bool)
                bad[[r[0] for r in shared.value.search(column(part, text))]] = True
                yield part.filter(pa.array(~bad))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
