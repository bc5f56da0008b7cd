import re
from collections import Counter

from tests.llm.data import docs
from tracespool.llm import repetition


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def covered(n):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        return {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(n)}

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, again = set(), []
    for x in lines:
        if x in seen:
            again.append(x)
        seen.add(x)
    chars = sum(map(len, words))
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
           "n_dup_lines": len(again), "n_repeat_words": len(covered(3)),
           "dup_line_share": sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in again) / max(chars, 1)}
    for n in repetition.GRAM_LIMITS:
        out[f"dup_{n}gram_share"] = sum(len(words[i]) for i in covered(n)) / max(chars, 1)
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    out["kept"] = not (out["base_failed"] or out["dup_line_share"] > 0.3 or out["n_symbols"] > 0.1 * len(words)
                       or any(out[f"dup_{n}gram_share"] > x for n, x in repetition.GRAM_LIMITS.items()))
    return out


def test_against_brute_force(spark):
    table = docs(spark)
    got = [r.asDict() for r in repetition.measure(table).collect()]
    want = [{"doc_id": r.doc_id} | slow(r.text) for r in table.collect()]
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(want, key=lambda r: r["doc_id"])


def test_given_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.asDict() for r in repetition.measure(table).collect()}
    assert all(got[r.doc_id] == {"doc_id": r.doc_id} | slow(r.text) for r in table.collect())


def test_empty(spark):
    assert repetition.measure(docs(spark, [])).count() == 0
