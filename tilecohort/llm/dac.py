"""Token ids as directly addressable codes.

A shard is one byte string: a header, the document ids and where each begins,
then levels. Level k holds the k-th 8-bit chunk of every id that is that long,
a bitmap that says which of them continue, and a rank directory (set bits before
each block of 512), so any token is read by one chunk and one rank a level and
nothing else is decoded. Shards are rows of an uncompressed Parquet table, which any store
that Spark reads can hold; ascending shard numbers are ascending document ids. The first
``n_null`` documents of a shard have a null id, for which the shard holds 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SliceEncoder, ragged
from .words import column, slices

END_ID = 1
#: A shard is closed when it holds so many tokens.
SHARD_TOKENS = 1 << 21
_MAGIC = b"DACSHRD1"
_BLOCK = 512
_BITS_IN_BYTE = np.array([bin(i).count("1") for i in range(256)], np.int64)
_SLICE = 1 << 20
SHARDS = "shard long, n_docs long, n_null long, n_tokens long, payload binary"


def encode(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard; starts has one entry more than doc_ids."""
    parts, rest = [], ids.astype(np.uint32)
    levels = []
    while True:
        chunk, more = (rest & 255).astype(np.uint8), rest >> 8
        on = more > 0
        bitmap = np.packbits(on, bitorder="little")
        padded = np.zeros(-(-len(bitmap) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
        padded[: len(bitmap)] = bitmap
        in_block = _BITS_IN_BYTE[padded].reshape(-1, _BLOCK // 8).sum(1)
        ranks = np.concatenate([[0], np.cumsum(in_block)]).astype(np.uint32)
        levels += [len(chunk), len(padded), len(ranks)]
        parts += [ranks.tobytes(), padded.tobytes(), chunk.tobytes()]
        rest = more[on]
        if not len(rest):
            break
    head = np.array([len(doc_ids), len(ids), len(levels) // 3, *levels], np.int64)
    return _MAGIC + head.tobytes() + doc_ids.astype(np.int64).tobytes() + starts.astype(np.int64).tobytes() + b"".join(parts)


class Shard:
    """Random access to a shard's tokens."""

    def __init__(self, payload: bytes) -> None:
        view = memoryview(payload)
        if bytes(view[:8]) != _MAGIC:
            raise ValueError("not a shard")
        n_docs, self.n_tokens, n_levels = np.frombuffer(view, np.int64, 3, 8).tolist()
        sizes = np.frombuffer(view, np.int64, 3 * n_levels, 32).reshape(-1, 3).tolist()
        at = 32 + 24 * n_levels
        self.doc_ids = np.frombuffer(view, np.int64, n_docs, at)
        self.starts = np.frombuffer(view, np.int64, n_docs + 1, at + 8 * n_docs)
        at += 8 * (2 * n_docs + 1)
        self.levels = []
        for chunks, bits, ranks in sizes:
            self.levels.append((np.frombuffer(view, np.uint32, ranks, at), np.frombuffer(view, np.uint8, bits, at + 4 * ranks), np.frombuffer(view, np.uint8, chunks, at + 4 * ranks + bits)))
            at += 4 * ranks + bits + chunks

    def token(self, i: int) -> int:
        """The i-th id of the shard, read without its neighbours."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (ranks, bits, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // _BLOCK * (_BLOCK // 8)
            i = int(ranks[i // _BLOCK]) + int(_BITS_IN_BYTE[bits[first : i >> 3]].sum()) + int(_BITS_IN_BYTE[bits[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def all(self) -> np.ndarray:
        """Every id, from the last level up."""
        above = np.zeros(0, np.uint32)
        for _, bits, chunks in reversed(self.levels):
            values = chunks.astype(np.uint32)
            on = np.unpackbits(bits, bitorder="little")[: len(chunks)].astype(bool)
            values[on] |= above << np.uint32(8)
            above = values
        return above


def write_shards(docs: DataFrame, vocab_path: str, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text, ends it with id 1 and writes shards in ascending doc_id order.

    A null text counts as empty. Documents with a null doc_id come before all others and are read back with it;
    repeated rows are documents each, those of one id in order of their texts' hash, an empty table gives no shard, other columns aren't read.
    Memory: one slice of text and one open shard a task.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the hash splits what one id, or none, holds over several ranges
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange(parts, "d", "h").sortWithinPartitions("d", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = SliceEncoder(vocab_path, None)
        shard, held, size = TaskContext.get().partitionId() << 24, [], 0

        def close() -> pa.RecordBatch:
            names, lengths, tokens = zip(*held)
            ids, lengths, tokens = pa.concat_arrays(names), np.concatenate(lengths), np.concatenate(tokens)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            row = [[shard], [len(ids)], [ids.null_count], [len(tokens)], [encode(ids.fill_null(0).to_numpy(), starts, tokens)]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, [pa.int64()] * 4 + [pa.binary()])], names=["shard", "n_docs", "n_null", "n_tokens", "payload"])

        for part in slices(batches, "t", _SLICE):
            w, at, ids = enc.ids(column(part, "t"))
            count = np.zeros(len(w.codes) + 1, np.int64)
            np.cumsum(np.diff(at)[w.codes], out=count[1:])
            lengths = np.diff(count[w.bounds]) + 1
            tokens = np.full(int(lengths.sum()), END_ID, np.uint16)
            own = np.ones(len(tokens), bool)
            own[np.cumsum(lengths) - 1] = False
            tokens[own] = ids[ragged(at, w.codes)]
            held.append((column(part, "d"), lengths, tokens))
            size += len(tokens)
            if size >= SHARD_TOKENS:
                yield close()
                shard, held, size = shard + 1, [], 0
        if held:
            yield close()

    ordered.mapInArrow(run, SHARDS).write.option("compression", "none").parquet(path)


def _names(shard: Shard, n_null: int) -> pa.Array:
    """A shard's document ids, the first n_null of them null."""
    return pa.array(shard.doc_ids, mask=np.arange(len(shard.doc_ids)) < n_null)


def lookup(shards: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", position: str = "position") -> DataFrame:
    """(doc_id, position, token) of the tokens that ``wanted`` asks for by document and place in it, counted from 0.

    Only the shards' directories and the tokens themselves are read, no block is decoded. A place beyond a document's end, an unknown or null id
    and a null place give no row; a document that stands several times gives a row each, a repeated question one each. What is asked of one shard is one task.
    """

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, n_null, payload in zip(column(batch, "shard").to_pylist(), column(batch, "n_null").to_pylist(), column(batch, "payload")):
                s = Shard(payload.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s.doc_ids), number)), _names(s, n_null), pa.array(s.starts[:-1]), pa.array(np.diff(s.starts))], names=["shard", "d", "at", "n"])

    places = shards.select("shard", "n_null", "payload").mapInArrow(directory, "shard long, d long, at long, n long")
    asked = wanted.select(F.col(doc_id).cast("long").alias("d"), F.col(position).cast("long").alias("p")).join(places, "d").filter("p >= 0 AND p < n")

    def read(questions: pa.Table, held: pa.Table) -> pa.Table:
        shard = Shard(held["payload"].combine_chunks()[0].as_buffer()) if questions.num_rows else None
        tokens = [shard.token(i) for i in (questions["at"].to_numpy() + questions["p"].to_numpy()).tolist()] if shard else []
        return pa.table({"d": questions["d"], "p": questions["p"], "token": pa.array(tokens, pa.int64())})

    found = asked.select("shard", "d", "p", "at").groupBy("shard").cogroup(shards.select("shard", "payload").groupBy("shard")).applyInArrow(read, "d long, p long, token long")
    return found.select(F.col("d").alias(doc_id), F.col("p").alias(position), "token")


def read_shards(shards: DataFrame) -> DataFrame:
    """Reads shards back: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, n_null, payload in zip(column(batch, "shard").to_pylist(), column(batch, "n_null").to_pylist(), column(batch, "payload")):
                s = Shard(payload.as_buffer())
                tokens = memoryview(s.all().astype("<u4").view(np.uint8))
                crc = [zlib.crc32(tokens[4 * a : 4 * b]) for a, b in zip(s.starts.tolist(), s.starts[1:].tolist())]
                cols = [pa.array(np.full(len(crc), number)), _names(s, n_null), *(pa.array(c) for c in (s.starts[:-1], np.diff(s.starts), np.array(crc, np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("shard", "n_null", "payload").mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one row a shard of two million tokens, so this window is short
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
