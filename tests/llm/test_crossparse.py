import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.data import docs
from tracespool.llm import crossparse


def slow_breaks(text, trained):
    """Greedy parse by substring search, segment by segment."""
    out = 0
    for lo in range(0, len(text), crossparse.SEGMENT):
        phrase = ""
        for c in text[lo:lo + crossparse.SEGMENT]:
            if phrase + c in trained:
                phrase += c
            else:
                out += 1
                phrase = c if c in trained else ""
    return out


def test_breaks_against_substring_search():
    texts = {"en": ["the cat sat on the mat and the dog", "Another DAY, 12 more: things"], "fr": ["le été est là où le chat dort", "encore"], "zz": ["!!"]}
    model = crossparse.Model(texts)
    assert model.langs == ["en", "fr"]
    some = ["the cat", None, "", "Le CHAT-- est là, 42 fois!", "ω ψ the", "the dog " * 400, "𐐨𐐩 the", "...", "été" * 300]
    codes, doc = model.symbols(pa.array(some, pa.string()))
    got = model.breaks(codes, doc, len(some))
    for i, text in enumerate(some):
        plain = crossparse.normal(text or "")
        size = int((doc == i).sum())
        assert size in (len(plain), len(plain) + 1)  # a last space may stay
        plain += " " * (size - len(plain))
        for k, lang in enumerate(model.langs):
            trained = " ".join(crossparse.normal(t)[:crossparse.WINDOW] for t in texts[lang])
            assert got[k, i] == slow_breaks(plain, trained)
    names, score, _ = model.predict(pa.array(some, pa.string()))
    assert [n == "und" for n in names] == [False, True, True, False, False, False, False, True, False]
    assert ((score >= 0) & (score <= 1)).all() and not np.isnan(score).any()


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = crossparse.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got)


def test_labels_of_held_out_rows_do_not_matter(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hidden = table.withColumn("lang", F.when(~crossparse.held_out(F.col("doc_id")), F.col("lang")))
    a, b = (sorted(map(tuple, crossparse.identify(t).collect())) for t in (table, hidden))
    assert a == b


def test_awkward_and_empty(spark):
    table = docs(spark)
    got = crossparse.identify(table).collect()
    assert len(got) == table.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2, 14}
    assert crossparse.keep_known(table).columns == table.columns
    assert crossparse.identify(docs(spark, [])).count() == 0
    blind = crossparse.identify(docs(spark, [(1, "abc", None, None, None, 1, "w")])).collect()
    assert (blind[0].lang_pred, blind[0].score) == ("und", 0.0)
