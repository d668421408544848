"""Differences of conversations read every row."""

from palimp.plans import base

ROWS = [
    *[("a", k, ("user", "assistant")[k % 2], f"text {k}") for k in range(8)],
    ("b", 0, "system", "rules"), ("b", 1, "user", "one"), ("b", 2, "assistant", "late"), ("b", 3, "user", "two"), ("b", 4, "user", "three"),
    ("c", 0, "user", "x"), ("c", 0, "user", "y"), ("c", 9, "user", None),
]


def test_every_text_is_in_a_step(spark, tmp_path):
    spark.createDataFrame(ROWS, "conv_id string, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: base.QUERIES[name](spark, str(tmp_path)).collect()
    rows = run("word_diff_summary")
    got = sorted((r["conv_id"], r["documento"], r["secao"], r["html"]) for r in rows)
    assert [x[:3] for x in got] == sorted([*(("a", k, s) for k in (1, 2, 3) for s in ("user", "assistant")), ("b", 1, "system"), ("b", 1, "assistant"), ("b", 1, "user"), ("b", 2, "user"), ("c", 1, "user"), ("c", 2, "user")])
    for conv, _, role, text in ROWS:
        assert any(w in h for w in (text or "").split()[-1:] for c, _, s, h in got if (c, s) == (conv, role)) or text is None, text
    html = {x[:3]: x[3] for x in got}
    assert "<del>rules" in html["b", 1, "system"] and "<ins>late" in html["b", 1, "assistant"] and "<del>y" in html["c", 2, "user"]
    assert {r["conv_id"]: len(r["documentos"]) for r in run("nested_export")} == {"a": 3, "b": 2, "c": 2}
    assert {r["conv_id"]: r["summary"].count("\n") + 1 for r in run("diff_text_summary")} == {"a": 3, "b": 2, "c": 2}
    assert {r["conv_id"]: r["report"].count("<tr>") for r in run("diff_html_report")} == {"a": 6, "b": 4, "c": 2}
