"""Quality rules on repetition: characters inside repeated n-grams and lines, measured by rolling hashes in numpy.

``measure`` returns one row per document.  A null text counts as empty: no words, every share zero, ``base_failed``
and not kept.  Repeated rows are measured each on its own; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracespool.llm.textblock import Block, U64, per_doc, repeated, slices

#: Largest share of a text's word characters inside n-grams that stand twice or more in it, by n (words).
GRAM_LIMITS = {5: 0.30, 8: 0.25, 10: 0.20}
LINE_LIMIT = 0.30  #: largest share of characters in lines equal to an earlier line
SYMBOL_LIMIT = 0.10  #: largest number of symbols per word
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _covered(block: Block, word_hash: np.ndarray, n: int) -> np.ndarray:
    """Words inside n-word windows that stand twice or more in their document."""
    words = len(word_hash)
    out = np.zeros(words, bool)
    if words < n:
        return out
    ok = block.word_doc[n - 1:] == block.word_doc[:words - n + 1]
    gram = np.zeros(words - n + 1, U64)
    with np.errstate(over="ignore"):
        for j in range(n):
            gram = gram * U64(0x9E3779B97F4A7C15 | 1) + word_hash[j:words - n + 1 + j]
    at = np.flatnonzero(ok)
    many, _ = repeated(block.word_doc[at], gram[at])
    delta = np.zeros(words + 1, np.int32)
    hit = at[many]
    delta[:words] += np.bincount(hit, minlength=words).astype(np.int32)[:words]
    delta -= np.bincount(hit + n, minlength=words + 1).astype(np.int32)[:words + 1]
    return np.cumsum(delta[:words]) > 0


def measure_block(column: pa.Array, grams: dict[int, float], line_limit: float, symbol_limit: float) -> dict[str, np.ndarray]:
    block = Block(column)
    block.cut_words()
    n_words = np.diff(block.first)
    begins = block.chars()
    letters = np.concatenate([[0], np.cumsum(begins & block.inside)])
    word_len = letters[block.ends] - letters[block.starts]
    word_chars = letters[block.off[1:]] - letters[block.off[:-1]]
    word_hash = block.range_hash(block.starts, block.ends)
    lo, hi, doc = block.lines()
    line_chars = letters[hi] - letters[lo]
    real = line_chars > 0
    lo, hi, doc, line_chars = lo[real], hi[real], doc[real], line_chars[real]
    _, again = repeated(doc, block.range_hash(lo, hi))
    out = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": per_doc(SYMBOLS[block.raw], block.off),
        "n_dup_lines": np.bincount(doc[again], minlength=block.docs),
        "n_repeat_words": per_doc(_covered(block, word_hash, 3), block.first),
    }
    some = np.maximum(word_chars, 1)
    out["dup_line_share"] = np.bincount(doc[again], weights=line_chars[again], minlength=block.docs) / some
    failed = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * n_words)
    bad = (out["dup_line_share"] > line_limit) | (out["n_symbols"] > symbol_limit * n_words)
    for n, limit in grams.items():
        share = per_doc(np.where(_covered(block, word_hash, n), word_len, 0), block.first) / some
        out[f"dup_{n}gram_share"] = share
        bad |= share > limit
    out["base_failed"] = failed
    out["kept"] = ~failed & ~bad
    return out


def measure(docs: DataFrame, grams: dict[int, float] = GRAM_LIMITS, line_limit: float = LINE_LIMIT,
            symbol_limit: float = SYMBOL_LIMIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, repetition shares, base_failed and kept."""
    shares = "".join(f", dup_{n}gram_share double" for n in grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts):
                got = measure_block(texts.slice(lo, hi - lo), grams, line_limit, symbol_limit)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *map(pa.array, got.values())], ["doc_id", *got])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             f"dup_line_share double{shares}, base_failed boolean, kept boolean")
