import corpus_pipeline
from tests.llm.test_contextpii import slow_base
from tests.llm.test_curvepack import check_pieces, slow_ids
from tests.llm.test_simhash import slow_components, slow_print
from tracespool.llm import contextpii

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    keep = {d for d, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    group = slow_components([(d, slow_print(rows[d].text)) for d in sorted(keep)])
    keep = {d for d in keep if group[d] == d}
    keep = {d for d in keep if not any(t in rows[d].text for t in items)}
    texts = {d: contextpii.redacted(rows[d].text, {}) for d in keep}
    table = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        assert table.columns == docs.columns
    got = {r.doc_id: r for r in table.collect()}
    assert {d: r.text for d, r in got.items()} == texts
    assert all(r.n_chars == len(r.text) for r in got.values()) and not any(slow_base(t)["email"] for t in texts.values())
    check_pieces(corpus_pipeline.run(spark, SF).collect(), {d: slow_ids(t) for d, t in texts.items()}, 4096)


def test_registration(spark):
    from __spark_entry__ import queries
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
