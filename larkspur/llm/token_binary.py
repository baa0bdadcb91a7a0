"""Token-id output as directly addressable codes.

Every id is cut into byte-wide chunks.  Level 0 holds the lowest chunk of every id;
level k+1 holds the next chunk of the ids that need one.  A continuation bitmap per
level says which ids go on, and a rank directory (set bits before every 512-bit
block) turns a position in one level into the position in the next, so any token is
read with one directory lookup and one popcount per level, without decoding a block.

The output is a table of self-contained blocks in ascending ``doc_id`` order: ranges
of ``doc_id`` make partitions, and a partition is cut into blocks of bounded size.
Spark's writer commits it, so lost executors only repeat their own tasks.

Nulls: a null text is the empty text (only the end id); null ``doc_id`` sorts first.
Repeated ``doc_id`` rows are all kept, ordered by text.  An empty table writes no
block.  Further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import text_of

MAGIC = b"DAC1"
RANK_BITS = 512
BLOCK_SCHEMA = "part int, block int, n_docs long, n_tokens long, doc_ids array<long>, payload binary"
DOC_SCHEMA = "part int, block int, doc_id long, block_start long, n_tokens long, ids_crc32 long"

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def pack(ids: np.ndarray, doc_ids: list, doc_offsets: np.ndarray) -> bytes:
    """One block: documents, then the chunk levels with bitmaps and rank directories."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
        per_block = _POPCOUNT[bits].reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.int64)
        rank = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4")
        levels.append(b"".join([np.array([len(rest)], "<u8").tobytes(), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()]))
        rest = rest[more] >> 8
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = [
        MAGIC,
        np.array([len(doc_ids), len(levels)], "<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        known.tobytes(),
        np.asarray(doc_offsets, "<u8").tobytes(),
    ]
    return b"".join(head + levels)


class Block:
    """A packed block, read in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        n_docs, n_levels = np.frombuffer(payload, "<u4", 2, 4)
        at = 12
        ids = np.frombuffer(payload, "<i8", n_docs, at)
        at += 8 * int(n_docs)
        known = np.frombuffer(payload, np.uint8, n_docs, at)
        at += int(n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.offsets = np.frombuffer(payload, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (int(n_docs) + 1)
        self.levels = []
        for _ in range(int(n_levels)):
            n = int(np.frombuffer(payload, "<u8", 1, at)[0])
            at += 8
            chunks = np.frombuffer(payload, np.uint8, n, at)
            at += n
            n_blocks = -(-n // RANK_BITS)
            bits = np.frombuffer(payload, np.uint8, n_blocks * RANK_BITS // 8, at)
            at += len(bits)
            rank = np.frombuffer(payload, "<u4", n_blocks, at)
            at += 4 * n_blocks
            self.levels.append((chunks, bits, rank))

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    def token(self, i: int) -> int:
        """The id at position ``i``, by one rank per level."""
        value, shift = 0, 0
        for chunks, bits, rank in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_BITS * (RANK_BITS // 8)
            i = int(rank[i // RANK_BITS]) + int(_POPCOUNT[bits[first : i >> 3]].sum()) + bin(int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).count("1")
            shift += 8
        return value

    def tokens(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of a range of positions."""
        stop = len(self) if stop is None else stop
        out = np.zeros(max(0, stop - start), np.uint32)
        lo, hi, where, shift = start, stop, slice(None), 0
        for chunks, bits, rank in self.levels:
            if lo >= hi:
                break
            part = chunks[lo:hi].astype(np.uint32) << shift
            base = lo // RANK_BITS * RANK_BITS
            more = np.unpackbits(bits[base // 8 : -(-hi // 8)], bitorder="little", count=hi - base).astype(bool)
            before, more = int(more[: lo - base].sum()), more[lo - base :]
            if isinstance(where, slice):
                out[:] = part
                where = np.flatnonzero(more)
            else:
                out[where] |= part
                where = where[more]
            lo = int(rank[base // RANK_BITS]) + before
            hi = lo + int(more.sum())
            shift += 8
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.offsets[k]), int(self.offsets[k + 1]))


class ChunkEncoder:
    """Ids of whole texts, taken from the library once per distinct white-space chunk.

    The tokenizer's normaliser folds white space to one space and its splitter never
    crosses it, so a text's ids are those of its chunks in order.  Chunks are kept in
    a dictionary of bounded size.  New ones go to the library many to a call: those of
    letters are parted by the ids that end a piece, others by a private-use character
    that stands alone; the few chunks that hold that character go one by one.
    """

    MARK = "\ue000"
    CLOSING = b".,!?;:"

    def __init__(self, path: str, keep: int = 800_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.mark = self._ids([self.MARK])[0]
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a piece
        self.ends[[i for name, i in vocabulary.items() if name.endswith("</w>")]] = True
        self.keep, self.known, self.old = keep, {}, {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, text: bytes) -> list[bytes]:
        """White-space chunks, lower-cased as the tokenizer does, but for texts that may
        hold a special token."""
        return (text if b"<|" in text else text.lower()).split()

    def _learn(self, chunks: list[bytes], at_once: int = 256) -> None:
        """Closing marks after a letter are a piece of their own to the tokenizer, so such
        a chunk is put together of two."""
        parts = {}
        for c in chunks:
            stem = c.rstrip(self.CLOSING)
            if 0 < len(stem) < len(c) and 97 <= stem[-1] <= 122:
                parts[c] = stem, c[len(stem) :]
        fresh = {c for c in chunks if c not in parts}.union(*parts.values()).difference(self.known)
        self._ask(list(fresh), at_once)
        self.known.update((c, self.known[stem] + self.known[marks]) for c, (stem, marks) in parts.items())

    def _ask(self, chunks: list[bytes], at_once: int) -> None:
        words = [c.decode() for c in chunks]
        pieces = [w.lower().isalpha() for w in words]  # of letters alone: one piece, if nothing is composed
        odd = [w for w, one in zip(words, pieces) if not one]
        words = [w for w, one in zip(words, pieces) if one]
        groups = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):
                self._keep(group, ids, [0, *ends[:-1].tolist()], ends.tolist())
            else:
                odd += group
        self._ask_marked(odd, at_once)

    def _ask_marked(self, words: list[str], at_once: int) -> None:
        alone = [w for w in words if self.MARK in w]
        words = [w for w in words if self.MARK not in w]
        self.known.update(zip((w.encode() for w in alone), (i.tobytes() for i in self._ids(alone))))
        groups = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        n = len(self.mark)
        for group, ids in zip(groups, self._ids([f" {self.MARK} ".join(g) for g in groups])):
            hit = np.ones(max(0, len(ids) - n + 1), bool)
            for k in range(n):
                hit &= ids[k : len(ids) - n + 1 + k] == self.mark[k]
            ends = [*np.flatnonzero(hit).tolist(), len(ids)]
            if len(ends) != len(group):
                raise ValueError("the tokenizer joined chunks across white space")
            self._keep(group, ids, [0, *(e + n for e in ends[:-1])], ends)

    def _keep(self, group: list[str], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        raw = ids.tobytes()
        self.known.update((w.encode(), raw[4 * a : 4 * b]) for w, a, b in zip(group, starts, ends))

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """Little-endian 32-bit ids of each text with ``end`` appended."""
        split = [self._chunks(t.encode()) for t in texts]
        if 2 * len(self.known) > self.keep:  # two generations: what is met again moves to the new one
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = set().union(*split).difference(known)
        if new:
            known.update((w, old[w]) for w in new.intersection(old))
            self._learn(list(new.difference(known)))
        return [b"".join(map(known.__getitem__, s)) + end for s in split]


@lru_cache(maxsize=1)
def _encoder(tokenizer: str) -> ChunkEncoder:
    """The Python worker's own encoder: chunks learnt in one task serve the next ones."""
    return ChunkEncoder(tokenizer)


def _encode_blocks(tokenizer: str, end_id: int, block_tokens: int, block_docs: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, number = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, docs, size = [], [], 0

        def block():
            lengths = [len(h) // 4 for h in held]
            payload = pack(np.frombuffer(b"".join(held), "<u4"), docs, np.concatenate([[0], np.cumsum(lengths)]))
            row = [part, number, len(docs), sum(lengths), docs, payload]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                ids = encoder.encode(piece.column("text").to_pylist(), end)
                for doc, one in zip(piece.column("doc_id").to_pylist(), ids):
                    if docs and (size + len(one) // 4 > block_tokens or len(docs) >= block_docs):
                        yield block()
                        held, docs, size, number = [], [], 0, number + 1
                    held.append(one)
                    docs.append(doc)
                    size += len(one) // 4
        if docs:
            yield block()

    return run


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_tokens: int = 1 << 20, block_docs: int = 4096) -> None:
    """Encode ``docs(doc_id, text)`` and write the blocks under ``path``.

    Documents are range-partitioned by ``doc_id``; partition numbers and block
    numbers ascend with it.  A document longer than ``block_tokens`` has a block to
    itself.  ``tokenizer`` is a path that every executor has (it is installed there).
    """
    rows = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_encode_blocks(tokenizer, end_id, block_tokens, block_docs), BLOCK_SCHEMA).write.parquet(path)


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "payload"))):
            block = Block(payload)
            ids, at = block.tokens().astype("<u4"), block.offsets
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
            n = len(block.doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(block.doc_ids, pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
                [c.split()[0] for c in DOC_SCHEMA.split(", ")],
            )


def _block_starts(blocks: DataFrame) -> DataFrame:
    """(part, block, base): ids before each block, by partition totals, then within partitions."""
    per_part = blocks.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("block_base"))
    return local.join(per_part, "part").select("part", "block", (F.col("part_base") + F.col("block_base")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the blocks: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.parquet(path)
    docs = blocks.select("part", "block", "payload").mapInArrow(_read_docs, DOC_SCHEMA)
    starts = _block_starts(blocks.select("part", "block", "n_tokens"))
    return docs.join(starts, ["part", "block"]).select("doc_id", (F.col("base") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """Random access: ``positions(doc_id, position)`` to (doc_id, position, token).

    Asked positions find their blocks by the column of document ids alone; a block then
    reads single tokens by rank.  Each is answered once, however often it is asked; a
    ``doc_id`` that repeats answers once for every row that has it, one that is not there
    not at all.  A position outside its document gives null.
    """
    blocks = spark.read.parquet(path)
    where = blocks.select("part", "block", F.posexplode("doc_ids").alias("number", "doc_id"))
    asked = where.join(positions.select("doc_id", "position").distinct(), "doc_id")
    # a block has a bounded number of tokens, and each of its tokens is asked for once at most
    asked = asked.groupBy("part", "block").agg(F.collect_list(F.struct("number", "doc_id", "position")).alias("asked"))

    def read(batches):
        for batch in batches:
            for payload, asked_here in zip(batch.column("payload").to_pylist(), batch.column("asked").to_pylist()):
                block, out = Block(payload), []
                for a in asked_here:
                    first, end = int(block.offsets[a["number"]]), int(block.offsets[a["number"] + 1])
                    p = a["position"]
                    out.append(block.token(first + p) if p is not None and 0 <= p < end - first else None)
                columns = [[a["doc_id"] for a in asked_here], [a["position"] for a in asked_here], out]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "position", "token"])

    return blocks.join(asked, ["part", "block"]).select("payload", "asked").mapInArrow(read, "doc_id long, position long, token long")
