import random
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from tests.llm.data import docs
from tracespool.llm import curvepack
from tracespool.llm.catalog import EOS, tokenizer_path


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def slow_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, EOS]


def check_pieces(rows, ids_of, length):
    """Each id in one piece, offsets gapless, sequences full or a power of two long."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids_of.keys()
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids_of[d])
            assert bytes(p.ids) == np.array(ids_of[d][at:at + p.length], "<u4").tobytes()
            at += p.length
        assert at == len(ids_of[d])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length and (at == length or at & (at - 1) == 0)


def test_awkward_documents(spark):
    rows = {r.doc_id: r for r in docs(spark).collect()}
    rows[40] = rows[3].__class__(**rows[3].asDict() | {"doc_id": 40, "text": "it's <|endoftext|> İSTANBUL é x y\x1cz   10 000,5 日本語, [a], ((b)). c'd. «e». ... x…! 5. #?a' ''"})
    table = spark.createDataFrame(list(rows.values()), docs(spark).schema)
    for length in (4096, 64):
        got = curvepack.pack(table, tokenizer_path(), EOS, length).collect()
        check_pieces(got, {i: slow_ids(r.text) for i, r in rows.items()}, length)


def test_special_tokens_in_upper_case_are_plain_text():
    import pyarrow as pa
    texts = ["<|ENDOFTEXT|>", "x <|EndOfText|> y <|endoftext|>", "a<|STARTOFTEXT|>b A<|startoftext|>B", "<|ENDOFTEXT|> <|endoftext|> <|Endoftext|>.", "A<B|C <| |> X<|Y", ""]
    ids, tokens, _ = curvepack.Words(tokenizer_path(), EOS).encode(pa.array(texts))
    got = np.split(ids, np.cumsum(tokens)[:-1])
    assert [x.tolist() for x in got] == [slow_ids(t) for t in texts]


def test_given_documents_and_crc(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = curvepack.pack(table, tokenizer_path(), EOS).withColumn("crc", F.crc32("ids")).collect()
    check_pieces(got, {r.doc_id: slow_ids(r.text) for r in table.collect()}, 4096)
    assert all(r.crc == zlib.crc32(bytes(r.ids)) for r in got)


def test_hilbert_neighbours():
    """The curve visits every cell once and neighbouring positions are neighbouring cells."""
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = curvepack.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_like_texts_lie_together(spark):
    rng = random.Random(2)
    topics = [[f"{t}{w}word" for w in range(8)] for t in ("red", "sea", "tax", "fox")]
    rows = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(60)), None, None, None, i, "w") for i in range(400)]
    got = curvepack.pack(docs(spark, rows), tokenizer_path(), EOS, 4096).collect()
    order = [r.doc_id % 4 for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    changes = sum(a != b for a, b in zip(order, order[1:], strict=False))
    assert changes < 0.5 * 0.75 * len(order)


def test_empty(spark):
    assert curvepack.pack(docs(spark, []), tokenizer_path(), EOS).count() == 0
