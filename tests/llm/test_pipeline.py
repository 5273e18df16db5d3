"""The pipeline against brute force: each stage is judged on the rows that the one before kept."""

import corpus_pipeline as P
from test_text_ops import components, contamination, spans

from quern.llm import pieces, quality, queries
from quern.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    score = {r.doc_id: r.predicted for r in quality.classify(docs, table(spark, sf_dir, "labels")).collect()}
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {r.doc_id: r.text for r in docs.collect() if score[r.doc_id] == 1}
    groups = {c for _, _, c in components(list(kept.items()))}
    kept = {i: t for i, t in kept.items() if i in groups}
    kept = {i: t for i, t in kept.items() if not contamination(t, items)[4]}
    clean = {}
    for i, t in kept.items():
        out, at = "", 0
        for s, _, e in spans(t):
            if e > at:
                out += t[at:s] + "[secret]" if s >= at else ""
                at = e
        clean[i] = out + t[at:]
    assert any("[secret]" in t for t in clean.values())
    codec = pieces.load(queries.PIECE_MODEL())
    got = {r.doc_id: r.ids for r in P.run(spark, sf_dir).collect()}
    assert got == {i: codec.encode(t)[0].tolist() for i, t in clean.items()}
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns


def test_stages_on_odd_rows_and_names(spark, sf_dir):
    """Nulls in every column, empty and long texts, repeated rows, columns named as the operators' own, and no rows at all."""
    long = "alpha beta gamma delta " * 30000
    rows = [(i, t, None, None, None, i, 0.5, [1], "s", "r", "k") for i, t in ((1, None), (2, ""), (None, None), (None, "free text, no id"), (3, "same words here again"), (3, "same words here again"), (4, "Same words here again"), (5, long), (6, "token = abcdefghijkl0123 tail"))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, hits array<int>, spans string, row string, _row string"
    odd = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, odd, sf_dir).columns == odd.columns
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    assert sorted(r.doc_id or 0 for r in P.near_dedup(spark, odd, sf_dir).collect()) == [0, 1, 3, 5, 6]
    assert P.secret_redaction(spark, odd, sf_dir).where("doc_id = 6").first().text == "[secret] tail"
    assert P.decontamination(spark, odd, sf_dir).count() == len(rows)
    assert P.quality_filter(spark, odd, sf_dir).where("n_chars is not null").count() == 0
    assert P.encoding(spark, odd, sf_dir).count() == len(rows) and P.encoding(spark, odd.limit(0), sf_dir).count() == 0
