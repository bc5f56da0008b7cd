"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests cannot tell from random ones.

A token is a maximal run of at least `SHORTEST` letters, digits, `+`, `/`, `-` and `_` (ASCII). Its encoding is the first
of `ENCODINGS` whose alphabet has all its characters; each character is its position in that alphabet. Three
tests ask whether the positions could be uniform and independent:

* chi-squared of the positions in 4, 8 or 16 equal bins (more for longer tokens, so that each expects 4 or more),
* runs above and below the middle of the alphabet (Wald-Wolfowitz),
* serial correlation at lag one.

Their p-values are combined by Fisher's statistic: the lower, the more random. How low is low depends on
encoding and length, since short ordinary strings pass such tests now and then. So ordinary text is tested alike: the
short words of every document, run together and filtered to each alphabet, are cut into windows of the length of each band
of `BANDS` in turn, and the statistics of all windows of all documents are counted. The p-value of a token is the share of
ordinary windows of its encoding and band that look at least as random (statistics in `STEPS` steps). Within each encoding
and band, over the distinct tokens of the table, the Benjamini-Hochberg rule at `RATE` accepts tokens; the accepted ones
outside the fixed patterns are added as spans of kind `random`. A band with few ordinary windows gives no small p-value,
so nothing is added on thin evidence.

One pass reads the texts and writes spans, tokens (as hashes) and counts; what comes to the driver is the counts
per encoding, band and step, a number that the parameters bound.

Defined results: null text is empty. Repeated tokens count once in the rule and are all marked. Tokens and texts of any length are
tested whole. Equal statistics share their p-value. Repeated rows are rows of their own; null ids are kept; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespool.llm.textblock import Block, mix, slices
from tracespool.plans.layout import settle

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HINTS = ("password", "passwd", "secret", "token", "api")  #: every assignment holds one of these, in either case
KINDS = ["assign", "access", "hex", "random"]

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: name, alphabet in order, and whether text is folded to lower or upper case before it is filtered to the alphabet
ENCODINGS = [("decimal", DIGITS, ""), ("hex", DIGITS + "abcdef", "lower"), ("upper hex", DIGITS + "ABCDEF", "upper"),
             ("base32", UPPER + "234567", "upper"), ("lower base36", LOWER + DIGITS, "lower"), ("upper base36", UPPER + DIGITS, "upper"),
             ("base64", UPPER + LOWER + DIGITS + "+/", ""), ("url base64", UPPER + LOWER + DIGITS + "-_", ""),
             ("mixed", UPPER + LOWER + DIGITS + "+/-_", "")]
SHORTEST = 16
BANDS = [16, 20, 24, 32, 40, 48, 64, 96, 128]  #: a token belongs to the last band that is not longer
STEPS, STEP = 64, 0.5  #: statistics are counted in steps of this width, the last open
RATE = 0.01  #: accepted share of false discoveries
DOC = ("row string, doc_id long, n_assign long, n_access long, n_hex long, base array<struct<start: long, kind: int, stop: long>>, "
       "tokens array<struct<start: long, stop: long, cell: int, step: int, hash: long>>, counts array<long>")

CODES = np.full((len(ENCODINGS), 256), -1, np.int64)
FOLDED = np.full((len(ENCODINGS), 256), -1, np.int64)
for _k, (_, _letters, _fold) in enumerate(ENCODINGS):
    CODES[_k, [ord(c) for c in _letters]] = range(len(_letters))
    FOLDED[_k] = CODES[_k]
    for _c in LOWER:
        if _fold:
            FOLDED[_k, [ord(_c), ord(_c.upper())]] = CODES[_k, ord(_c if _fold == "lower" else _c.upper())]
SIZES = np.array([len(letters) for _, letters, _ in ENCODINGS])
OUTSIDE = np.ones(256, bool)
OUTSIDE[[ord(c) for c in LOWER + UPPER + DIGITS + "+/-_"]] = False
NOT_HEX = np.ones(256, bool)
NOT_HEX[[ord(c) for c in DIGITS + "abcdef"]] = False


def normal_tail(z: np.ndarray) -> np.ndarray:
    """Both tails of the normal distribution beyond |z| (rational approximation, error below 1.2e-7 of the value)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = np.zeros_like(t)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = poly * t + c
    return t * np.exp(-x * x - 1.26551223 + t * poly)


def chi_squared_tail(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail of chi-squared (Wilson and Hilferty's cube root)."""
    z = (np.cbrt(x / df) - 1 + 2 / (9 * df)) / np.sqrt(2 / (9 * df))
    return np.where(z > 0, normal_tail(z) / 2, 1 - normal_tail(z) / 2)


def battery(values: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fisher's statistic of the tests for the strings values[off[k]:off[k + 1]] over alphabets of the given sizes."""
    n = np.diff(off)
    if not len(n):
        return np.zeros(0)
    which = np.repeat(np.arange(len(n)), n)
    letters = size[which]
    bins = np.where(n < 32, 4, np.where(n < 64, 8, 16))
    bins = np.where(size < bins, size, bins)
    of = values * bins[which] // letters
    seen = np.bincount(which * 16 + of, minlength=16 * len(n)).reshape(-1, 16)
    edge = np.ceil(np.arange(17)[None] * size[:, None] / bins[:, None]).clip(max=size[:, None])  # letters below each bin
    expected = np.diff(edge, axis=1) / size[:, None] * n[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(expected > 0, (seen - expected) ** 2 / expected, 0).sum(axis=1)
    p_even = chi_squared_tail(chi, bins - 1.0)

    first = np.zeros(len(values), bool)
    first[off[:-1]] = True
    high = (2 * values >= letters).astype(np.int64)
    change = np.ones(len(values), np.int64)
    change[1:] = high[1:] != high[:-1]
    change[first] = 1
    runs, above = np.add.reduceat(change, off[:-1]), np.add.reduceat(high, off[:-1])
    both = 2.0 * above * (n - above)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.sqrt(both * (both - n) / (n * n * (n - 1.0)))
        z = (runs - both / n - 1) / spread
    never = np.exp(-n * math.log(2))  # all on one side
    p_runs = np.where(spread > 0, normal_tail(np.nan_to_num(z)), never)

    centred = values - (np.add.reduceat(values, off[:-1]) / n)[which]
    product = np.zeros(len(values))
    product[1:] = centred[1:] * centred[:-1]
    product[first] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.add.reduceat(product, off[:-1]) / np.add.reduceat(centred * centred, off[:-1])
    p_serial = np.where(np.isfinite(r), normal_tail((np.nan_to_num(r) + 1 / n) * np.sqrt(n)), never)
    least = 1e-300
    return -2 * (np.log(np.maximum(p_even, least)) + np.log(np.maximum(p_runs, least)) + np.log(np.maximum(p_serial, least)))


def band(length: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, length, side="right") - 1


def step(statistic: np.ndarray) -> np.ndarray:
    return np.minimum(statistic / STEP, STEPS - 1).astype(np.int64)


def encodings(letters: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The first encoding that has all characters of each token letters[off[k]:off[k + 1]]."""
    out = np.full(len(off) - 1, len(ENCODINGS) - 1)
    for k in reversed(range(len(ENCODINGS) if len(out) else 0)):
        out[np.minimum.reduceat(CODES[k][letters], off[:-1]) >= 0] = k
    return out


def ordinary(block: Block, short: np.ndarray) -> np.ndarray:
    """Counts of statistics by encoding, band and step over the ordinary characters (``short``) of a block of texts."""
    counts = np.zeros((len(ENCODINGS), len(BANDS), STEPS), np.int64)
    text = block.raw[short]
    cycle = np.cumsum([0, *BANDS])
    for k in range(len(ENCODINGS)):
        values = FOLDED[k][text]
        values = values[values >= 0]
        whole = len(values) // cycle[-1] + 1
        off = (np.arange(whole)[:, None] * cycle[-1] + cycle[None, :-1]).ravel()
        off = np.append(off, whole * cycle[-1])
        full = int(np.searchsorted(off, len(values), side="right")) - 1
        if full > 0:
            off = off[:full + 1]
            found = step(battery(values[:off[-1]], off, np.full(full, SIZES[k])))
            np.add.at(counts[k], (np.arange(full) % len(BANDS), found), 1)
    return counts


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of assignments and access keys."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out


def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind `doc` with spans and tokens, and one of kind `text` per batch with the counts of ordinary strings."""
    schema = pa.schema([
        ("row", pa.string()), ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
        ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))),
        ("tokens", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("cell", pa.int32()), ("step", pa.int32()), ("hash", pa.int64())]))),
        ("counts", pa.list_(pa.int64()))])
    for batch in batches:
        texts, ids = batch.column(1), batch.column(0)
        counts = np.zeros((len(ENCODINGS), len(BANDS), STEPS), np.int64)
        for lo, hi in slices(texts):
            block = Block(texts.slice(lo, hi - lo))
            point = np.concatenate([[0], np.cumsum(block.chars())])
            place = lambda at, doc: point[at] - point[block.off[doc]]
            found: list[list] = [base_spans(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
            block.cut_words(NOT_HEX)
            long = block.ends - block.starts >= 16
            doc = block.word_doc[long]
            for d, a, b in zip(doc.tolist(), place(block.starts[long], doc).tolist(), place(block.ends[long], doc).tolist()):
                found[d].append((a, 2, b))
            block.cut_words(OUTSIDE)
            length = block.ends - block.starts
            long = length >= SHORTEST
            edge = np.zeros(len(block.raw) + 1, np.int64)
            np.add.at(edge, block.starts[~long], 1)
            np.add.at(edge, block.ends[~long], -1)
            counts += ordinary(block, np.cumsum(edge[:-1]) > 0)
            starts, ends, doc = block.starts[long], block.ends[long], block.word_doc[long]
            off = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            letters = block.raw[np.arange(off[-1]) + np.repeat(starts - off[:-1], ends - starts)]
            kind = encodings(letters, off)
            steps = step(battery(CODES[np.repeat(kind, ends - starts), letters], off, SIZES[kind]))
            cells = kind * len(BANDS) + band(ends - starts)
            keys = mix(block.range_hash(starts, ends)).view(np.int64)
            tokens: list[list] = [[] for _ in range(block.docs)]
            for d, a, b, c, s, h in zip(doc.tolist(), place(starts, doc).tolist(), place(ends, doc).tolist(), cells.tolist(), steps.tolist(), keys.tolist()):
                tokens[d].append({"start": a, "stop": b, "cell": c, "step": s, "hash": h})
            rows = [{"row": "doc", "doc_id": i, **{f"n_{KINDS[k]}": sum(s[1] == k for s in spans) for k in range(3)}, "tokens": t,
                     "base": [{"start": a, "kind": k, "stop": b} for a, k, b in sorted(spans)], "counts": None}
                    for i, spans, t in zip(ids.slice(lo, hi - lo).to_pylist(), found, tokens)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        yield pa.RecordBatch.from_pylist([{"row": "text", "counts": counts.ravel().tolist()}], schema=schema)


def accepted(text_counts: np.ndarray, token_counts: np.ndarray, rate: float) -> np.ndarray:
    """The greatest accepted step of each cell, or -1: Benjamini-Hochberg over its distinct tokens."""
    below = np.cumsum(text_counts, axis=1)
    p = (below + 1) / (below[:, -1:] + 1)
    rank, all_tokens = np.cumsum(token_counts, axis=1), token_counts.sum(axis=1, keepdims=True)
    good = (token_counts > 0) & (p * all_tokens <= rate * rank)
    return np.where(good.any(axis=1), good.shape[1] - 1 - np.argmax(good[:, ::-1], axis=1), -1)


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base and spans (arrays of kind, start, stop in order)."""
    cells = len(ENCODINGS) * len(BANDS)
    seen = settle(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(examine, DOC))
    table = seen.where("row = 'text'").select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    text_counts = np.zeros(cells * STEPS, np.int64)
    for at, n in table.collect():  # at most cells * STEPS rows
        text_counts[at] = n
    distinct = seen.where("row = 'doc'").select(F.explode("tokens").alias("t")).select("t.cell", "t.step", "t.hash").distinct()
    token_counts = np.zeros((cells, STEPS), np.int64)
    for cell, at, n in distinct.groupBy("cell", "step").count().collect():
        token_counts[cell, at] = n
    limit = F.array(*[F.lit(int(x)) for x in accepted(text_counts.reshape(cells, STEPS), token_counts, rate)])
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))
    more = F.transform(F.filter("tokens", lambda t: (t["step"] <= F.get(limit, t["cell"])) & free(t)),
                       lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["stop"].alias("stop")))
    out = seen.where("row = 'doc'").withColumn("spans", F.sort_array(F.concat("base", more)))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base", "spans")


def listed(spans: str) -> Column:
    """kind:start:stop of all spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")
