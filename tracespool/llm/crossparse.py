"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of labelled text.  A document is parsed greedily: each
phrase is the longest match that the automaton knows, and the next phrase begins at the character that ended it.  The
language that needs the fewest phrases, times the bits that name one (log2 of the automaton's text), wins.

Texts are read in lower case, with every run of other characters than letters as one space.  They are parsed in
segments of ``SEGMENT`` symbols side by side, so a very long text is as parallel as many short ones; whole texts count.
The automata are dense transition tables, at most ``BUCKETS * WINDOW`` symbols a language and ``MAX_LANGUAGES``, hence
of bounded size to broadcast.

A null text or one without letters is ``und`` with score 0; so is everything if no labelled row exists.  Ties go to
the first language by name.  Labels, sources and ids are not inputs of a prediction.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tracespool.llm.textblock import slices, tidy
from tracespool.plans.layout import settle

BUCKETS = 128  #: labelled documents sampled per language, one per bucket of their hashed ids
WINDOW = 256  #: symbols taken from each
SAMPLE_CHARS = 1024  #: characters of a sampled text that are read
MAX_LANGUAGES = 64
SEGMENT = 512
BLOCK = 4 << 20
SHARPNESS = 2.0  #: bits of difference are multiplied by this in the score
MAX_RATE = 0.6  #: a text that needs more phrases per symbol than this fits no learned language
PAD, OTHER, SPACE = 0, 1, 2
FLAG = 1 << 30


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """At most ``BUCKETS`` texts for each label among rows that are not held out, cut to ``SAMPLE_CHARS``."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picks = settle(rows.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket"))
                   .agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(7))).alias("doc_id")).select("lang", "doc_id"))
    count = picks.count()
    if count > BUCKETS * MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    texts = (rows.join(F.broadcast(picks), ["lang", "doc_id"])  # at most BUCKETS * MAX_LANGUAGES rows
             .groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text")))
    out: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r.lang, r.doc_id)):  # bounded as above
        out.setdefault(r.lang, []).append(r.text)
    return out


def normal(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton: state 0 is the root, every path from it spells a substring."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nxt


class Model:
    """Symbol codes of characters, and for each language a table: next state times the number of symbols, FLAG on a break."""

    def __init__(self, texts: dict[str, list[str]]):
        trained = {lang: " ".join(normal(t)[:WINDOW] for t in some) for lang, some in texts.items()}
        self.langs = sorted(lang for lang, text in trained.items() if text.strip())
        symbols = sorted({c for lang in self.langs for c in trained[lang]} - {" "})
        code = {" ": SPACE} | {c: i + 3 for i, c in enumerate(symbols)}
        self.width = len(symbols) + 3
        self.code = np.full(1 << 16, SPACE, np.uint16)
        for point in range(1 << 16):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                self.code[point] = code.get(low if len(low) == 1 else c, OTHER)
        self.bits, self.tables = [], []
        for lang in self.langs:
            states = automaton(trained[lang])
            first = np.full(self.width, FLAG, np.int32)
            for c, to in states[0].items():
                first[code[c]] = to * self.width + FLAG
            table = np.tile(first, (len(states), 1))
            table[:, PAD] = np.arange(len(states)) * self.width
            for s, edges in enumerate(states):
                for c, to in edges.items():
                    table[s, code[c]] = to * self.width
            self.tables.append(table.ravel())
            self.bits.append(np.log2(len(trained[lang]) + 1))

    def symbols(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the texts without pads or leading and repeated spaces; the doc of each."""
        column = pc.fill_null(column, "")
        size = np.asarray(pc.utf8_length(column), np.int64)
        points = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[np.minimum(points, 0xFFFF)]
        far = np.flatnonzero(points > 0xFFFF)
        if len(far):
            kinds, inverse = np.unique(points[far], return_inverse=True)
            codes[far] = np.array([OTHER if chr(p).isalpha() else SPACE for p in kinds.tolist()], np.uint16)[inverse]
        doc = np.repeat(np.arange(len(size)), size)
        space = codes == SPACE
        before = np.ones(len(codes), bool)
        before[1:] = space[:-1] | (doc[1:] != doc[:-1])
        keep = ~(space & before)
        return codes[keep], doc[keep]

    def breaks(self, codes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Phrases that end within each document, by language."""
        size = np.bincount(doc, minlength=docs)
        first = np.concatenate([[0], np.cumsum(size)])
        n_segments = (size + SEGMENT - 1) // SEGMENT
        base = np.concatenate([[0], np.cumsum(n_segments)])
        owner = np.repeat(np.arange(docs), n_segments)
        start = first[owner] + (np.arange(base[-1]) - base[owner]) * SEGMENT
        length = np.minimum(first[owner + 1] - start, SEGMENT)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        out = np.zeros((len(self.langs), docs), np.int64)
        open_ = np.searchsorted(-length, -np.arange(SEGMENT), side="left") if len(length) else np.zeros(SEGMENT, int)
        steps = int(length[0]) if len(length) else 0
        columns = [codes[start[:open_[t]] + t].astype(np.int32) for t in range(steps)]
        for k, table in enumerate(self.tables):
            state = np.zeros(len(start), np.int32)
            count = np.zeros(len(start), np.int32)
            for t in range(steps):
                n = open_[t]
                to = table[state[:n] + columns[t]]
                count[:n] += to >> 30
                state[:n] = to & (FLAG - 1)
            out[k] = np.bincount(owner, weights=count, minlength=docs).astype(np.int64)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and phrases per symbol of each text."""
        docs = len(column)
        codes, doc = self.symbols(column)
        letters = np.bincount(doc[codes != SPACE], minlength=docs)
        if not self.langs:
            return ["und"] * docs, np.zeros(docs), np.ones(docs)
        size = np.maximum(np.bincount(doc, minlength=docs), 1)
        breaks = self.breaks(codes, doc, docs)
        bits = breaks * np.array(self.bits)[:, None] / size
        best = bits.argmin(axis=0)
        weight = np.exp2(-SHARPNESS * (bits - bits.min(axis=0)))
        score = np.where(letters > 0, 1.0 / weight.sum(axis=0), 0.0)
        rate = breaks[best, np.arange(docs)] / size
        return [self.langs[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)], score, rate


FOUND = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rate", DoubleType())])


def predictor(docs: DataFrame):
    """A column function text -> (lang_pred, score, rate), learned from the labelled rows of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(Model(sample(docs)))

    @F.arrow_udf(FOUND)
    @tidy
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [model.value.predict(column.slice(lo, hi - lo)) for lo, hi in slices(column, BLOCK)] or [([], [], [])]
            yield pa.StructArray.from_arrays([pa.array([x for p in parts for x in p[0]], pa.string()),
                                              pa.array(np.concatenate([p[1] for p in parts]), pa.float64()),
                                              pa.array(np.concatenate([p[2] for p in parts]), pa.float64())], fields=list(_fields()))

    return predict


def _fields() -> Iterator[pa.Field]:
    yield from (pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("rate", pa.float64()))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rate (phrases per symbol) of every row of (doc_id, text, lang)."""
    found = docs.select("doc_id", predictor(docs)("text").alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.*")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in one of the learned languages."""
    found = predictor(docs)("text")
    name = "_found"
    while name in docs.columns:
        name += "_"
    return (docs.withColumn(name, found).where((F.col(name)["lang_pred"] != "und") & (F.col(name)["rate"] <= MAX_RATE))
            .select(*docs.columns))
