"""Repeated passages against brute force: every window of 16 words that stands before goes, and nothing else."""

import random
import re

import pytest

from pixelquilt.llm import chunk_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WIDTH = chunk_dedup.MIN_WORDS


def cleaned(rows):
    """Texts by key, from rows in the order of their keys."""
    first, out = {}, {}
    for key, text in rows:
        found = list(WORD.finditer(text or ""))
        gone = set()
        for i in range(len(found) - WIDTH + 1):
            window = text[found[i].start() : found[i + WIDTH - 1].end()]
            owner, at = first.setdefault(window, (key, i))
            if owner != key or i >= at + WIDTH:
                gone.update(range(i, i + WIDTH))
        out[key] = text
        if gone:
            kept, last = "", -1  # a word with the white space before it; what goes takes the white space after it
            for i, m in enumerate(found):
                if i in gone:
                    continue
                kept += (text[found[i - 1].end() if i else 0 : m.start()] if i == 0 or i - 1 not in gone else text[found[last].end() : found[last + 1].start()] if last >= 0 else "") + m.group()
                last = i
            out[key] = kept + text[found[-1].end() :] if kept else ""
    return out


def letters(draw, n, low=2, high=9):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(low, high))) for _ in range(n))


def planted():
    """Passages of 51 to 60, of 16 and of 15 words; texts of one period, whole copies, copies that end elsewhere."""
    draw = random.Random(8)
    rows, key = [], 0
    for n in [15, 16, 17, *range(51, 61)] * 8:
        passage = letters(draw, n)
        for _ in range(3):
            key += 1
            rows.append((key, f"{letters(draw, 20)} {passage}\n{letters(draw, 20)}"))
    whole = letters(draw, 300)
    rows += [(2000, whole), (2001, whole), (2002, f" {whole}\n"), (2003, whole[7:]), (2004, letters(draw, 9) + " " + whole[300:900])]
    rows += [(3000, "la li " * 100), (3001, "la " * 90 + "\n" + "la " * 90), (3002, "x" * 5000), (3003, " \n"), (3004, ""), (3005, None)]
    return rows


@pytest.mark.parametrize("table", ["planted", "documents"])
def test_passages_go_to_their_ends(spark, table):
    df = spark.createDataFrame(planted(), "doc_id long, text string") if table == "planted" else spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect() if r["text"] is not None)
    want = cleaned(rows)
    got = {r["doc_id"]: r["text"] for r in chunk_dedup.remove_repeats(df).collect()}
    assert {k: t for k, t in got.items() if t is not None} == want
    assert len(got) == df.count() and any(want[k] != t for k, t in rows)
