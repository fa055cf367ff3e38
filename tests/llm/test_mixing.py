"""Mixing against its SQL, a plain Python version and the properties of a mix."""

import hashlib
import itertools
import re
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
from unskew.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, h int, key string, target int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k", 2) for r in rows], SCHEMA)


def plain(rows, weights=(5, 2, 1), share=1.5, most=2):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    h = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((h(i, t), i, size(t)))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(z for _, _, z in by[s]) for s in order}
    w = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    goal, free = {s: 0.0 for s in order}, set(order)
    budget = share * sum(total.values())
    while free:
        spare, all_w = budget - sum(most * total[s] for s in order if s not in free), sum(w[s] for s in free)
        fair = {s: w[s] * spare / all_w for s in free}
        over = {s for s in free if fair[s] > most * total[s]}
        if not over:
            goal.update(fair)
            break
        goal.update({s: float(most * total[s]) for s in over})
        free -= over
    out = []
    for s in order:
        g = int(goal[s] + 0.5)
        copies, rest = divmod(g, total[s]) if total[s] else (0, 0)
        for h_, same in itertools.groupby(sorted(by[s], key=lambda x: x[0]), key=lambda x: x[0]):
            same = list(same)
            words = sum(z for _, _, z in same)
            for _, i, z in same:
                extra = z if words <= rest else 0 if rest <= 0 else min(z, (2 * z * rest + words) // (2 * words))
                out.append((i, z, total[s], round(goal[s], 6), copies * z + extra, s))
            rest -= words
    return out


key = lambda r: tuple((v is None, v) for v in r)


def check(spark, rows, **k):
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], r["source"]) for r in mixing.mix(frame(spark, rows), **k).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, **k), key=key)
    return got


def words(n, start=0):
    return " ".join(f"w{start + i}" for i in range(n))


EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, words(50_000), None), (5, words(9), "b"), (5, words(9), "b"), (5, words(7), "b"), (None, words(3), "b"), (None, None, "ä"),
         (6, words(30), "Z"), (7, words(31), "Z"), (8, words(1), ""), (9, words(2), "="), (10, "a\x0bb\x0cc d", "a")]


def test_edges(spark):
    got = check(spark, EDGES)
    assert all(0 <= r[4] <= 2 * r[1] for r in got)


@pytest.mark.parametrize("k", [{}, {"weights": (1.0,), "share": 0.3}, {"share": 5.0}, {"weights": (100, 1), "share": 1.9, "most": 2}, {"share": 0.0}])
def test_many_rows_and_settings(spark, k):
    rows = [(i, words(1 + i * 7919 % 60, i), f"s{i * i % 11}" if i % 3 else "hot") for i in range(1500)]
    got = check(spark, rows, **k)
    by = defaultdict(lambda: [0, 0.0, 0])
    for _, z, _, t, taken, s in got:
        by[s][0] += taken
        by[s][1] = t
        assert taken <= k.get("most", 2) * z
    assert all(abs(taken - t) <= 1 for taken, t, _ in by.values())


def test_equal_rows_share_evenly(spark):
    got = check(spark, [(1, words(10), "a")] * 8 + [(2, words(1000), "b")], share=0.05, weights=(1,))
    assert len({r[4] for r in got if r[5] == "a"}) == 1


def test_larger_budgets_hold_smaller_ones(spark):
    rows = frame(spark, [(i, words(1 + i % 40, i), "ab"[i % 2]) for i in range(400)])
    small, large = ({r["doc_id"]: r["taken"] for r in mixing.mix(rows, share=s, weights=(1,)).collect()} for s in (0.3, 0.45))
    assert all(small[i] <= large[i] for i in small) and sum(small.values()) < sum(large.values())


def test_several_levels_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 4)
    check(spark, [(i, words(1 + i % 5, i), "one") for i in range(3000)], share=0.37)


def test_empty_table_and_order_of_rows(spark):
    assert mixing.mix(frame(spark, EDGES).limit(0)).collect() == []
    one, two = (sorted((tuple(r) for r in mixing.mix(frame(spark, EDGES).repartition(n)).collect()), key=key) for n in (1, 7))
    assert one == two


def test_query_matches_sql_and_stays_in_the_jvm(spark, sf, capsys):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = entry.queries()["op12_mixing"](spark, sf)
    cur = con.execute(entry.oracle_sql()["op12_mixing"])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    assert sorted(tuple(map(str, r)) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in cur.fetchall())
    df.explain("formatted")
    assert "Python" not in capsys.readouterr().out
