"""Operators 4 and 7 on texts of a million equal lines or letters."""

import time

from orolith.llm import chat_format, secret_scan


def test_chat_of_very_many_blank_lines_and_quote_marks(spark):
    n = 1_000_000
    texts = ["\n" * n, ">" * n, " >" * (n // 2), "> \n" * (n // 10) + "me", " \t\n" * 1000 + "a\n\n b" + "\n\t" * 1000, "am " + "schrieb " * 50_000 + "\n> x", "\n ", " \n\t", "  ", "", None]
    rows = [(k, 1, "user", t) for k, t in enumerate(texts)]
    began = time.time()
    got = {r.conv_id: r for r in chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert time.time() - began < 90
    assert [got[k].content for k in range(11)] == ["", "", "", "me", "a\n\n b", "am " + "schrieb " * 50_000, " ", "\t", "  ", "", ""]
    assert got[1].n_quoted == 0 and got[3].n_quoted == 0


def test_secrets_beside_very_long_runs():
    took = []
    for n in (250_000, 1_000_000):
        began = time.time()
        for text in ("\n" + "a" * n, "a" * n + "\n", "ab " * (n // 3) + "\n", ("a" * 76 + "\n") * (n // 77), "a" * 15 + "\n" + "-" * n):
            base, every, complete = secret_scan.find_secrets(text)
            assert complete
        took.append(time.time() - began)
    assert took[1] < 60 and took[1] < 12 * took[0]
    wrapped = "x " + "dG9rZW4gPSAiMWViOWM2NTRlNzIxYjRm\n ODEyMDg4OTcwZTY2YTYi" + "==" + " y"
    assert any(kind == 0 for _, kind, _ in secret_scan.find_secrets(wrapped)[1])
