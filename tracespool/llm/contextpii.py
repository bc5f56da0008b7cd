"""Personal data: four base kinds by pattern, and more identifiers by bootstrapped contextual extraction.

Bootstrapping: every base match is a seed.  The one or two words before an identifier-like token (with whatever stands
before it inside its own word, such as ``id=``) are a lexical pattern.  Spark scores the graph of patterns and instances
in rounds, until none adds a pattern: a pattern's confidence is the share of *all* its occurrences in the corpus that are followed by
an instance, weighted by the instance's score; an instance scores its best pattern's confidence; seeds score 1.  Patterns, with seeds of their own or not,
that reach ``CONFIDENCE`` with ``SUPPORT`` distinct instances mark the identifier-like tokens behind them (kinds
``found_email`` and so on).  Ordinary words are never marked: a token needs a digit and ``MIN_LENGTH`` characters.

Counts run over all documents.  Only fixed-size data is broadcast: a bitmap of hashed patterns while counting, and the
accepted patterns, checked against ``MAX_PATTERNS``.  Null texts count as empty; repeated rows are read each on its own.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracespool.llm.textblock import slices, tidy
from tracespool.plans.layout import settle

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")  # from the start of a run of digits: a later start fails if that one does
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]")
WORD = re.compile(r"\S+")
CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)  # a word without the marks around it

MIN_LENGTH = 6
RISE = 1e-3  #: of the sum of confidences; rounds that add no pattern and less than this end the search
CONFIDENCE = 0.5
SUPPORT = 3
PRIOR = 2.0  #: occurrences without an instance that every pattern is assumed to have
HELD_PATTERNS = 1 << 16  #: patterns that a task counts before it passes them on
SLICE_BYTES = 4 << 20  #: text whose links are counted together
MAP_BITS = 20
MAX_PATTERNS = 200_000

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """The local part is the longest run before the @ that no earlier match holds; linear in the text."""
    out, last = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost matches of each kind that do not overlap; matches that fail their check are dropped."""
    def digits(m: re.Match) -> str:
        return DIGITS.sub("", m[0])
    return {
        "email": emails(text) if "@" in text else [],
        "ip": [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15] if "+" in text else [],
    }


def contexts(before: list[str], prefix: str) -> list[str]:
    """Patterns of a token: a prefix that names something, then the prefix with the last word and the last two before it."""
    out = [f"{prefix}|"] if any(c.isalpha() for c in prefix) else []
    out += [f"{before[-1]} {prefix}|"] if before else []
    return out + [f"{before[-2]} {before[-1]} {prefix}|"] if len(before) > 1 else out


def tokens(text: str) -> Iterator[tuple[list[str], str, int, int]]:
    """Words with a digit: (two words before in the line, prefix within the word, start, end of the token)."""
    for line in re.finditer(r"[^\n]+", text):
        if not re.search("[0-9]", line[0]):
            continue
        before: list[str] = []
        for m in WORD.finditer(line[0]):
            word = m[0]
            if any("0" <= c <= "9" for c in word):
                cut = max(word.find("="), word.find(":")) + 1
                core = CORE.search(word, cut)
                if core:
                    yield before[-2:], word[:core.start()].lower(), line.start() + m.start() + core.start(), line.start() + m.start() + core.end()
            before = [*before[-1:], word.lower()]


def left(text: str, start: int) -> tuple[list[str], str]:
    """The context of any span, as `tokens` gives it."""
    line = text[max(text.rfind("\n", 0, start) + 1, start - 400):start]
    words = line.lower().split()
    prefix = words.pop() if words and not line[-1].isspace() else ""
    return words[-2:], prefix


def overlaps(spans: list[Span], start: int, end: int) -> bool:
    return any(a < end and start < b for a, b in spans)


def instances(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind or empty, instance, pattern) of every seed and every identifier-like token."""
    base = base_spans(text)
    taken = sorted(s for some in base.values() for s in some)
    for kind, some in base.items():
        for start, end in some:
            for p in contexts(*left(text, start)):
                yield kind, text[start:end].lower(), p
    for before, prefix, start, end in tokens(text):
        if end - start >= MIN_LENGTH and not overlaps(taken, start, end):
            for p in contexts(before, prefix):
                yield "", text[start:end].lower(), p


def _marked(column: pa.Array) -> np.ndarray:
    """Texts that can hold a match at all."""
    return np.asarray(pc.match_substring_regex(pc.fill_null(column, ""), "[0-9@]"))


def graph(docs: DataFrame) -> DataFrame:
    """(kind, instance, pattern, n): how often each instance follows each pattern; an empty kind is unknown."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0), SLICE_BYTES):
                texts, count = batch.column(0).slice(lo, hi - lo), Counter()
                for text in texts.filter(pa.array(_marked(texts))).to_pylist():
                    count.update(instances(text))
                k, i, p = zip(*count, strict=True) if count else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(i, pa.string()), pa.array(p, pa.string()),
                                                  pa.array(list(count.values()), pa.int64())], ["kind", "instance", "pattern", "n"])
    found = docs.select("text").mapInArrow(tidy(run), "kind string, instance string, pattern string, n long")
    return found.groupBy("kind", "instance", "pattern").agg(F.sum("n").alias("n"))


def _slot(pattern: str) -> int:
    return zlib.crc32(pattern.encode()) & ((1 << MAP_BITS) - 1)


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): occurrences in the corpus, before any word, of the patterns that have no prefix.

    A pattern with a prefix is part of an identifier-like word, so its occurrences are those of `graph`.
    """
    slots = F.pmod(F.crc32(F.col("pattern").cast("binary")), F.lit(1 << MAP_BITS))
    bitmap = np.zeros(1 << MAP_BITS, bool)
    bitmap[[r.slot for r in patterns.select(slots.alias("slot")).distinct().collect()]] = True  # at most 2**MAP_BITS
    if not bitmap.any():
        return patterns.select("pattern", F.lit(0).cast("long").alias("total")).limit(0)
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, total = wanted.value, Counter()
        names = ["pattern", "total"]
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                one: Counter = Counter()
                two: Counter = Counter()
                for text in batch.column(0).slice(lo, hi - lo).to_pylist():
                    for line in (text or "").lower().split("\n"):
                        words = line.split()
                        one.update(words[:-1])
                        two.update(zip(words, words[1:-1], strict=False))
                found = {f"{w} |": n for w, n in one.items()} | {f"{a} {b} |": n for (a, b), n in two.items()}
                total.update({p: n for p, n in found.items() if bits[_slot(p)]})
                if len(total) > HELD_PATTERNS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names)
                    total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names)

    counted = docs.select("text").mapInArrow(tidy(run), "pattern string, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
    return counted.join(patterns, "pattern", "left_semi")


def settled(edges: DataFrame, seeds: DataFrame, total: DataFrame) -> DataFrame:
    """(kind, pattern, confidence) of the patterns accepted when rounds add none and raise no confidence by ``RISE``.

    Scores only rise from round to round, so accepted patterns stay accepted.
    """
    scores, last = seeds, (-1, 0.0)
    while True:
        weighed = (edges.join(scores, "instance").groupBy("kind", "pattern")
                   .agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.sum("score").alias("support")).join(total, "pattern"))
        patterns = settle(weighed.select("kind", "pattern", (F.col("mass") / (F.col("total") + PRIOR)).alias("confidence"), "support")
                          .where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("kind", "pattern", "confidence"))
        now = patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        if now[0] == last[0] and now[1] - last[1] < RISE:
            return patterns
        last = now
        found = (edges.where("open").join(patterns, "pattern").groupBy("kind", "instance")
                 .agg(F.least(F.max("confidence"), F.lit(0.999)).alias("score")))
        scores = settle(seeds.union(found.select("kind", "instance", "score")).groupBy("kind", "instance").agg(F.max("score").alias("score")))


def learn(docs: DataFrame) -> dict[str, str]:
    """Accepted patterns and their kinds, from all rows of ``docs`` (text)."""
    links = settle(graph(docs))
    seeds = settle(links.where("kind <> ''").select("kind", "instance", F.lit(1.0).alias("score")).distinct())
    edges = links.groupBy("instance", "pattern").agg(F.sum("n").alias("n"), F.bool_or(F.col("kind") == "").alias("open"))
    seen = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), F.bool_or("open").alias("open"), F.sum("n").alias("total"))
    here = settle(seen.where((F.col("instances") >= SUPPORT) & F.col("open")).select("pattern", "total"))  # the rest marks nothing in any round
    edges = settle(edges.join(here.select("pattern"), "pattern", "left_semi"))
    # Occurrences before identifier-like words are the least a total can be: what they do not accept, no round with the totals does.
    fit = settle(settled(edges, seeds, here).select("pattern").distinct())
    if fit.isEmpty():
        return {}
    edges = settle(edges.join(fit, "pattern", "left_semi"))
    total = settle(here.join(fit, "pattern", "left_semi").join(occurrences(docs, fit).withColumnRenamed("total", "words"), "pattern", "left")
                   .select("pattern", F.greatest("total", F.coalesce("words", F.lit(0))).alias("total")))
    best = settled(edges, seeds, total).groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("top")).select("pattern", "top.kind")
    if best.count() > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} accepted patterns; raise CONFIDENCE or SUPPORT")
    return {r.pattern: r.kind for r in best.collect()}  # bounded by MAX_PATTERNS


def all_spans(text: str, patterns: dict[str, str]) -> dict[str, list[Span]]:
    """Base spans, then tokens behind accepted patterns that no base span touches."""
    out = base_spans(text)
    if patterns:
        taken = [s for some in out.values() for s in some]
        for before, prefix, start, end in tokens(text):
            if end - start >= MIN_LENGTH and not overlaps(taken, start, end):
                kind = next((patterns[p] for p in reversed(contexts(before, prefix)) if p in patterns), None)
                if kind:
                    out.setdefault(f"found_{kind}", []).append((start, end))
    return out


def joined(spans: dict[str, list[Span]]) -> str:
    names = [*KINDS, *(f"found_{k}" for k in KINDS)]
    return ",".join(f"{k}:{a}:{b}" for k in names for a, b in sorted(spans.get(k, [])))


FOUND = StructType([StructField(f"n_{k}", LongType()) for k in KINDS] + [StructField("base", StringType()), StructField("spans", StringType())])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and spans (kind:start:end in code points, comma-joined) of every row."""
    patterns = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.arrow_udf(FOUND)
    @tidy
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            n, base, spans = [[0] * len(column) for _ in KINDS], [""] * len(column), [""] * len(column)
            hit = np.flatnonzero(_marked(column))
            for row, text in zip(hit.tolist(), column.take(pa.array(hit)).to_pylist(), strict=True):
                found = all_spans(text, patterns.value)
                for k, kind in enumerate(KINDS):
                    n[k][row] = len(found[kind])
                base[row] = joined({k: found[k] for k in KINDS})
                spans[row] = joined(found)
            yield pa.StructArray.from_arrays([*(pa.array(x, pa.int64()) for x in n), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                                             [f.name for f in FOUND])

    return docs.select("doc_id", look("text").alias("found")).select("doc_id", "found.*")


def redacted(text: str, patterns: dict[str, str]) -> str:
    """Every span, or run of overlapping ones, replaced by its first kind in brackets."""
    spans = sorted((a, -b, k) for k, some in all_spans(text, patterns).items() for a, b in some)
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.removeprefix('found_').upper()}]"]
        at = max(at, -b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, and ``n_chars`` of changed texts counted anew."""
    patterns = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.arrow_udf(StringType())
    @tidy
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [pa.array([], pa.string())]
            for lo, hi in slices(column, SLICE_BYTES):
                some = column.slice(lo, hi - lo)
                texts = some.to_pylist()
                for row in np.flatnonzero(_marked(some)).tolist():
                    texts[row] = redacted(texts[row], patterns.value)
                parts.append(pa.array(texts, pa.string()))
            yield pa.concat_arrays(parts)

    name = "_clean"
    while name in docs.columns:
        name += "_"
    new = docs.withColumn(name, clean("text"))
    changed = F.coalesce(F.col(name) != F.col("text"), F.lit(False))
    return new.select(*(F.col(name).alias(c) if c == "text" else
                        F.when(changed, F.length(name)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
                        F.col(c) for c in docs.columns))
