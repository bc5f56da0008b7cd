"""Packing along a space-filling curve.

Each document's tokens are hashed to a vector of a few dimensions (the mean of signs hashed from the token ids), the
vector is quantised and named by its position on a Hilbert curve, and documents are range-sorted by that position: texts
with like words come to lie together.  Each range partition packs its documents, one after the other, into full
sequences of ``LENGTH`` tokens, cutting freely; what is left at its end goes into sequences whose lengths are powers of
two, so that nothing is padded.

Equal positions (copies) are spread by a hash of the id, so a group of copies never lands in one task.  Token ids are
written once before the sort; a task holds one sequence and one batch.  Null texts count as empty: they have the closing
token only.  Repeated rows are packed each on its own; an empty table gives no pieces.
"""
from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.llm.textblock import LOWER, Block, mix, slices, tidy
from tracespool.plans.layout import settle

LENGTH = 4096
DIMENSIONS, BITS = 3, 16
CACHED_WORDS, TABLE_BITS = 500_000, 21  #: words a task remembers; slots of their table, four times as many
BLOCK = 2 << 20
SPECIAL = b"<|"  #: special tokens begin so
CLOSING = b".,;:!?%&$*#|)"
SPREAD = 6.0  #: means are small; they are stretched by this before quantising


class Words:
    """Token ids by white-space separated word, for tokenizers that drop white space and never look across it.

    ASCII letters are lower-cased first, as this vocabulary's own normaliser does.  The marks that
    close a word after a letter or digit are a token group of their own, so only the stem before them needs encoding.  Stems of letters are encoded many at a time:
    each is one run of the tokenizer's pattern, and ends with the only token that closes a word.
    """

    def __init__(self, path: str, eos: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.eos = Tokenizer.from_file(path), eos
        size = self.tokenizer.get_vocab_size()
        self.signs = 1 - 2 * ((mix(np.arange(max(size, eos) + 1, dtype=np.uint64))[:, None]
                               >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
        self.closes = np.zeros(max(size, eos) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.stems: dict[bytes, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all words; number 0 is the closing token."""
        self.keys, self.numbers = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int64)
        self.flat = np.array([self.eos], np.uint32)
        self.at, self.size = np.array([0]), np.array([1])
        self.vectors = np.zeros((1, DIMENSIONS), np.float32)

    def find(self, word: np.ndarray) -> np.ndarray:
        """Numbers of hashed words in the open-addressing table, 0 for unknown ones."""
        out = np.zeros(len(word), np.int64)
        rest, slot = np.arange(len(word)), (word >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(rest):
            key = self.keys[slot]
            hit = key == word[rest]
            out[rest[hit]] = self.numbers[slot[hit]]
            on = ~hit & (key != 0)
            rest, slot = rest[on], (slot[on] + 1) & ((1 << TABLE_BITS) - 1)
        return out

    def enter(self, word: np.ndarray, number: np.ndarray) -> None:
        """Put new distinct hashes into the table."""
        slot = (word >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(word):
            _, first = np.unique(slot, return_index=True)
            free = np.zeros(len(word), bool)
            free[first] = self.keys[slot[first]] == 0
            self.keys[slot[free]], self.numbers[slot[free]] = word[free], number[free]
            word, number, slot = word[~free], number[~free], (slot[~free] + 1) & ((1 << TABLE_BITS) - 1)

    def whole(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]

    def learn_stems(self, stems: list[bytes]) -> None:
        plain = [w for w in stems if w.decode().isalpha()]
        for lo in range(0, len(plain), 1000):
            some = plain[lo:lo + 1000]
            ids = np.array(self.tokenizer.encode(" ".join([w.decode() for w in some]), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(self.closes[ids]) + 1
            parts = np.split(ids, cut[:-1]) if len(cut) == len(some) else self.whole(some)
            self.stems.update(zip(some, parts, strict=True))
        plain = set(plain)
        other = [w for w in stems if w not in plain]
        self.stems.update(zip(other, self.whole(other), strict=True))

    def learn(self, words: list[bytes]) -> None:
        cut = [w.rstrip(CLOSING) if w[-1] in CLOSING and b"'" not in w and SPECIAL not in w else w for w in words]
        cut = [c if not c or c[-1:].isalnum() or c[-1] > 127 and c.decode()[-1].isalpha() else w for c, w in zip(cut, words, strict=True)]
        pairs = [(c, w[len(c):]) for c, w in zip(cut, words, strict=True)]
        self.learn_stems(sorted({x for pair in pairs for x in pair if x and x not in self.stems}))
        self.stems[b""] = np.zeros(0, np.uint32)
        got = [self.stems[x] for pair in pairs for x in pair]
        size = np.fromiter(map(len, got), np.int64, len(got)).reshape(-1, 2).sum(axis=1)
        flat = np.concatenate(got)
        total = np.concatenate([np.zeros((1, DIMENSIONS), np.float64), np.cumsum(self.signs[flat], axis=0, dtype=np.float64)])
        ends = np.cumsum(size)
        self.vectors = np.concatenate([self.vectors, (total[ends] - total[ends - size]).astype(np.float32)])
        self.at = np.concatenate([self.at, len(self.flat) + ends - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the closing token; tokens per text; vector sums per text."""
        if len(self.size) > CACHED_WORDS:
            self.clear()
        if len(self.stems) > CACHED_WORDS:
            self.stems = {}
        block = Block(column)
        block.cut_words()  # between ASCII white space
        block.raw = lowered(block)
        word = np.maximum(block.range_hash(block.starts, block.ends), np.uint64(1))
        n = self.find(word)
        unknown = np.flatnonzero(n == 0)
        if len(unknown):
            new, at = np.unique(word[unknown], return_index=True)
            at, raw, known = unknown[at], block.raw.tobytes(), len(self.size)
            self.learn([raw[a:b] for a, b in zip(block.starts[at].tolist(), block.ends[at].tolist(), strict=True)])
            self.enter(new, known + np.arange(len(new)))
            n[unknown] = self.find(word[unknown])
        docs = np.arange(block.docs)
        all_ = np.zeros(len(n) + block.docs, np.int64)
        all_[np.arange(len(n)) + block.word_doc] = n
        first = block.first[:-1] + docs
        size = self.size[all_]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.at[all_] - (ends - size), size)]
        return ids, np.add.reduceat(size, first), np.add.reduceat(self.vectors[all_], first, axis=0)


def lowered(block: Block) -> np.ndarray:
    """The bytes with ASCII letters in lower case, except in words that may hold a special token: those are matched as they stand."""
    raw, low = block.raw, LOWER[block.raw]
    at = np.flatnonzero((raw[:-1] == SPECIAL[0]) & (raw[1:] == SPECIAL[1]))
    for w in np.unique(np.searchsorted(block.starts, at, side="right") - 1):
        low[block.starts[w]:block.ends[w]] = raw[block.starts[w]:block.ends[w]]
    return low


def hilbert(point: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of points with coordinates below 2**bits (Skilling's transpose, 2004)."""
    x = point.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def tokenize(docs: DataFrame, path: str, eos: int) -> DataFrame:
    """doc_id, curve position, number of tokens and ids (little-endian, 2 bytes where the vocabulary allows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in slices(texts, BLOCK):
                words = words or Words(path, eos)  # ends with the task
                ids, tokens, total = words.encode(texts.slice(lo, hi - lo))
                mean = np.clip(total / tokens[:, None] * SPREAD, -1, 1)
                key = hilbert(np.floor((mean + 1) / 2 * ((1 << BITS) - 1)))
                width = "<u2" if words.tokenizer.get_vocab_size() < 1 << 16 and eos < 1 << 16 else "<u4"
                raw, ends = ids.astype(width).tobytes(), np.cumsum(tokens) * int(width[2])
                cut = pa.Array.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(key), pa.array(tokens), cut],
                                                 ["doc_id", "key", "doc_tokens", "ids"])
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, key long, doc_tokens long, ids binary")


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Pieces of a stream of documents; ids come out as little-endian unsigned 32-bit numbers."""

    def __init__(self, length: int, first_id: int):
        self.length, self.sequence = length, first_id
        self.open: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.used = 0
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            take = min(self.length - self.used, total - start)
            self.open.append((doc_id, start, ids[start:start + take], total))
            self.used += take
            start += take
            if self.used == self.length:
                self.close([self.length])

    def close(self, sizes: list[int]) -> None:
        """Cut what is open into sequences of these sizes."""
        pieces = self.open[::-1]
        for size in sizes:
            offset = 0
            while offset < size:
                doc_id, start, ids, total = pieces.pop()
                take = min(len(ids), size - offset)
                self.done.append((doc_id, start, take, total, self.sequence, offset, ids[:take].astype("<u4").tobytes()))
                if take < len(ids):
                    pieces.append((doc_id, start + take, ids[take:], total))
                offset += take
            self.sequence += 1
        self.open, self.used = [], 0

    def drain(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        columns = list(zip(*self.done, strict=True)) or [[]] * 7
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(docs: DataFrame, path: str, eos: int, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents (doc_id, text): which ids of a document stand where in which sequence."""
    tokens = settle(tokenize(docs, path, eos))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                packer.add(doc_id, np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4"))
                if len(packer.done) >= 256:
                    yield packer.drain()
        packer.close(powers_of_two(packer.used))
        yield packer.drain()

    tie = F.xxhash64("doc_id")
    return (tokens.withColumn("tie", tie).repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie")
            .select("doc_id", "doc_tokens", "ids").mapInArrow(tidy(run), PIECES))
