"""The filter audit against going through every document, order and step."""

import re
from itertools import permutations

import duckdb
import numpy as np

from pixelquilt.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows):
    least = {}
    for key, _, text in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    for key, source, text in rows:
        text = text or ""
        words = WORD.findall(text)
        failed = {f for f, fails in zip("ABCD", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), re.search("[#$%&*|]", text))) if fails}
        yield source or "", key, failed | ({"E"} if key is not None and key > least[text] else set())


def plain(rows, labels):
    good, toxic = ({k for k, q, t in labels if k is not None and (q, t)[i] == 1} for i in (0, 1))
    judged, found = list(failures(rows)), {}
    parts = {p for p, _, _ in judged}
    for part in parts:
        mine = [(k, f) for p, k, f in judged if p == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, own in enumerate(order, 1):
                gone = [(k, f) for k, f in left if own in f]
                left = [(k, f) for k, f in left if own not in f]
                shares[own] += len(gone)
                fails = sum(own in f for _, f in mine)
                found[part, order, step] = [len(left), len(gone), fails - len(gone), sum(f == {own} for _, f in mine), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)]
        for (p, order, step), numbers in found.items():
            if p == part:
                numbers.append(shares[order[step - 1]])
    return sorted((*k, *v) for k, v in found.items())


def check(spark, rows, labels):
    df = spark.createDataFrame([(k, s, t, 1, "x") for k, s, t in rows], "doc_id long, source string, text string, `key` int, part string")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(df, marks)
    assert sorted(map(tuple, got.collect())) == plain(rows, labels)


def test_audit_of_odd_rows(spark, odd):
    long = " ".join(f"w{i}" for i in range(220))
    rows = [(r["doc_id"], r["source"], r["text"]) for r in odd.collect()]
    rows += [(20, "s", long), (21, "s", long), (21, None, long), (19, None, long), (19, "s", long), (None, "s", long), (None, None, None), (30, "t", long + " A" * 40), (31, "t", long + " #"), (32, "t", long), (33, "t", "é " * 300), (34, "t", "ß\x85b\xa0c " * 250 + "Ä")]
    labels = [(20, 1, 0), (21, 0, 1), (21, 1, None), (19, None, 1), (None, 1, 1), (3, 1, 1), (999, 1, 1), (30, 0, 1)]
    check(spark, rows, labels)
    check(spark, rows, [])
    check(spark, [], labels)
    check(spark, [(i, "hot", long) for i in range(3000)] + [(5000 + i, "cold", f"{long} {i}") for i in range(300)], [(i, i % 2, int(i % 3 == 0)) for i in range(3000)])


def test_long_texts_go_by_pieces(monkeypatch):
    text = ("Ab  c#d\n" * 3000 + " end").encode()
    whole = filter_audit.failed_by(text)
    monkeypatch.setattr(filter_audit, "PIECE", 7)
    assert filter_audit.failed_by(text) == whole == 0b1110


def test_carry_save_counts():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 4, 100, 1001):
        words, copies = draw.integers(0, 1 << 32, n, dtype=np.uint32), draw.integers(1, 10**6, n)
        want = [(copies * ((words >> np.uint32(b)) & 1)).sum() for b in range(32)]
        assert (filter_audit.positional_counts(words, copies) == want).all()


def test_audit_twin(spark):
    found = duckdb.connect()
    for t in ("documents", "labels"):
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES["op11_filter_audit"](spark, SF)
    want = found.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['op11_filter_audit']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) % 600 == 0
