import corpus_pipeline as C
import sentencepiece
from test_decontaminate import slow_matches
from test_secret_scan import slow_base
from test_wide_simhash import slow_links, slow_roots

from tessera.llm import langid, secret_scan


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    taken = {}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, sf)
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
            docs = docs.cache()
            taken[name] = {r.doc_id: r.text for r in docs.collect()}
            assert docs.count() == len(taken[name])
    kept = taken["language_id"]
    assert len(kept) >= 0.99 * len(before) and all(langid.has_letter(t) for t in kept.values())
    first, single = set(slow_roots(sorted(kept), slow_links(kept)).values()), set(taken["near_duplicates"])
    assert first <= single and len(single) <= len(first) + 0.05 * (len(kept) - len(first))
    leaks = {i for i, t in taken["near_duplicates"].items() if any(w.upper() in (t or "").upper() for _, w in items) or slow_matches(t, items[:2])}
    gone = set(taken["near_duplicates"]) - set(taken["decontamination"])
    assert leaks <= gone and all(slow_matches(taken["near_duplicates"][i], items) for i in gone)
    for i, t in taken["decontamination"].items():
        clean = taken["secrets"][i]
        assert (clean == t) == (not secret_scan.find_spans(t)) and not slow_base(clean)
    library = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    got = {r.doc_id: r.ids for r in docs.collect()}
    assert got == dict(zip(taken["secrets"], library.encode(list(taken["secrets"].values()))))
    assert {r.doc_id: r.ids for r in C.run(spark, sf).collect()} == got


def test_rows_with_nulls_and_an_empty_table(spark, sf, tmp_path):
    rows = [(1, None, None, None, None), (2, "the of and to in is that on with for", "en", "s", 36), (None, "the and of a in", None, None, None), (3, "", "en", "s", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, table in (("some", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = {r.doc_id for r in C.run(spark, f"{tmp_path}/{name}").collect()}
        assert got == ({2, None} if name == "some" else set())
