"""Fill-in-middle against a plain Python version and its SQL, and exact restoration."""

import hashlib
import re

import pytest

import __spark_entry__ as entry
from unskew.llm import fim

EDGES = [
    (1, None), (2, ""), (3, "a"), (4, "ab<P>cd ef"), (5, "x <S y> <M z"), (6, "né à\n\n2 you\u0000!? \U0001f642\U0001f642 end"), (7, "<<<>>>" * 5), (8, "word " * 200_000),
    (9, "é" * 70_000), (None, "no id at all"), (None, None), (6, "twice"), (6, "twice"), (10, " lead and trail "), (-11, "negative id, as text"),
]


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "psm", "h") for i, t in rows], "doc_id long, text string, output string, n int, form string, h string")


def test_matches_plain_version_on_edges_and_documents(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = EDGES + texts
    got = fim.transform(frame(spark, rows)).withColumn("back", fim.restored()).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    want = [(i, *plain(i, t), t or "") for i, t in rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_query_matches_plain_version(spark, sf):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry.queries()["op13_fill_in_middle"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, p, m, out = plain(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == sha(out) and r["restored_sha256"] == sha(texts[r["doc_id"]])


def test_empty_table_and_parameters(spark):
    assert fim.transform(frame(spark, []).limit(0)).collect() == []
    rows = frame(spark, [(i, "some words to move about") for i in range(50)])
    forms = lambda **k: {r["form"] for r in fim.transform(rows, **k).select("form").distinct().collect()}
    assert forms(transformed=0) == {"plain"} and forms(transformed=100, suffix_first=0) == {"psm"} and forms(transformed=100, suffix_first=100) == {"spm"}


@pytest.mark.parametrize("most", [1, 10, 10**6])
def test_batches_are_cut_by_bytes(most):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "defgh", "", "i"]})
    parts = list(fim.slices(batch, "text", most))
    assert [t for p in parts for t in p["text"].to_pylist()] == batch["text"].to_pylist()
    assert len(parts) == {1: 4, 10: 1, 10**6: 1}[most]


def test_no_python_rows_in_the_plan(spark, sf, capsys):
    entry.queries()["op13_fill_in_middle"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "BatchEvalPython" not in plan and "Exchange" not in plan
