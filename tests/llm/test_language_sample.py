"""The training sample where a language is few texts of many copies."""

from orolith.llm.language_id import training_rows


def test_each_language_is_sampled_by_different_texts(spark):
    rows = [(f"text {k} of few", "xx") for k in range(10)] * 300 + [(f"text {k} of many", "yy") for k in range(2000)]
    rows += [("text of both", "xx"), ("text of both", "yy")]
    for per_lang in (5, 600):
        got = training_rows(spark.createDataFrame(rows, "text string, lang string"), per_lang).collect()
        assert len(set(got)) == len(got)
        assert sum(r.lang == "xx" for r in got) == min(11, per_lang)
        assert sum(r.lang == "yy" for r in got) == per_lang
