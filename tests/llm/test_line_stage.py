"""The line stage on copies of whole texts."""

from corpus_pipeline import lines, near_dedup


def test_copies_of_a_text_keep_their_lines(spark):
    clean = "A first line of clean text\nand a second one\nand a third"
    rows = [(k, clean) for k in range(25)] + [(100 + k, f"text {k} by itself\nA line that stands everywhere") for k in range(12)] + [(200, "A line that stands everywhere"), (201, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = lines(spark, docs, "")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and len(got) == len(rows)
    assert all(got[k].text == clean and got[k].n_chars == len(clean) for k in range(25))
    assert all(got[100 + k].text == f"text {k} by itself" for k in range(12))
    assert got[200].text == "" and got[201].text is None
    assert {r.doc_id for r in near_dedup(spark, out, "").collect() if r.text == clean} == {0}
