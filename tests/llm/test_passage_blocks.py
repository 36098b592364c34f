"""Windows of many texts at once, and how few of them are compared."""

import random

import numpy as np
import pytest

from pixelquilt.llm import chunk_dedup, common
from tests.llm.test_whole_passages import letters

ODD = [None, "", " \n", "la", "\x00" * 40 + "la " * 40, "é" * 200 + " " + "x" * 300, "la\t\tli  lu " * 30]


def test_texts_of_a_block_do_not_touch():
    draw = random.Random(3)
    texts = [t for x in ODD for t in (x, letters(draw, draw.choice([15, 16, 17, 200])))]
    both = chunk_dedup.Windows(texts, 16)
    alone = [chunk_dedup.Windows(t, 16) for t in texts]
    marks = np.full(common.BITMAP_WORDS, -1).view(np.uint64)
    one, many = both.units(marks), [w.units(marks) for w in alone]
    assert both.owner.tolist() == [i for i, w in enumerate(alone) for _ in range(w.n)]
    for name in ("idx", "anchors"):
        assert getattr(both, name).tolist() == [x for w in alone for x in getattr(w, name).tolist()]
    assert both.chosen().tolist() == [x for w in alone for x in w.chosen().tolist()]
    assert both.idx[one[0]].tolist() == [x for w, u in zip(alone, many) for x in w.idx[u[0]].tolist()]
    for which in (0, 1):
        assert both.digest(which, *one[:2]).tolist() == [x for w, u in zip(alone, many) for x in (w.digest(which, *u[:2]).tolist() if w.n else [])]


def test_anchors_fill_a_bitmap():
    """Bitmaps take six high bits of a hash: of anchors that are least hashes as they are, most of them are zero."""
    anchors = chunk_dedup.Windows(letters(random.Random(4), 20_000), 16).chosen()
    high = np.bincount((anchors.view(np.uint64) >> np.uint64(58)).astype(int), minlength=64)
    assert high.min() > 0 and high.max() < len(anchors) / 32


@pytest.mark.parametrize("members", [0, 3000, 100_000])
def test_bitmaps_grow_with_their_members(spark, monkeypatch, members):
    """A full bitmap lets everything through; the result is the same for any size."""
    monkeypatch.setattr(chunk_dedup, "BITMAP_WORDS", 64)
    sizes, plain = [], chunk_dedup.bitmap_of
    monkeypatch.setattr(chunk_dedup, "bitmap_of", lambda *a, **k: sizes.append(k.get("words")) or plain(*a, **k))
    draw = random.Random(5)
    whole = letters(draw, members // 10)
    df = spark.createDataFrame([(1, whole), (2, whole), (3, letters(draw, 30))], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in chunk_dedup.remove_repeats(df).collect()}
    assert got[1] == whole and got[2] == ""
    assert sizes[0] == 64 if members < 100_000 else sizes[0] >= 256
