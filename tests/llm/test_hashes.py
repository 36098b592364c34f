"""Hashes of words and passages: equal for equal content wherever it stands, apart for texts made to collide."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelquilt.llm import chunk_dedup, hashing, jaccard_join


def thue_morse(length, zero="a", one="b"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(length))


PAIR = (thue_morse(2048), thue_morse(2048, "b", "a"))


def test_products_in_the_field():
    draw = random.Random(1)
    values = [0, 1, 2, hashing.PRIME - 1, 1 << 60, (1 << 61) - 2, *[draw.randrange(hashing.PRIME) for _ in range(500)]]
    a, b = (np.array(x, np.uint64) for x in (values, values[::-1]))
    assert hashing.times(a, b).tolist() == [x * y % hashing.PRIME for x, y in zip(values, values[::-1])]
    assert hashing._powers(12345, 300).tolist() == [pow(12345, i, hashing.PRIME) for i in range(300)]


words = st.one_of(
    st.text(alphabet="abAB\x00é", min_size=1, max_size=20),
    st.integers(1, 12).map(lambda k: thue_morse(1 << k)),
    st.integers(1, 12).map(lambda k: thue_morse(1 << k, "b", "a")),
    st.tuples(st.sampled_from("ab"), st.integers(1, 200)).map(lambda t: t[0] * t[1]),
)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, min_size=2, max_size=30, unique_by=str.lower))
def test_different_words_have_different_hashes(found):
    raw = " ".join(found).encode()
    lowered = [w.encode().lower() for w in " ".join(found).split(" ")]
    hashes = jaccard_join.word_hashes(raw)
    assert len(hashes) == len(lowered)
    assert len(set(hashes.tolist())) == len(set(lowered))
    again = jaccard_join.word_hashes(b"\n\t x " + raw.upper() + b" y")
    assert again[1:-1].tolist() == hashes.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["la", "li", *PAIR]), min_size=6, max_size=40))
def test_windows_are_equal_exactly_where_their_texts_are(found):
    text = " ".join(found) + "\n" + " ".join(reversed(found))
    w = chunk_dedup.Windows(text, 4)
    first, after = np.arange(w.n), np.arange(w.n) + 1
    digests = list(zip(w.digest(0, first, after).tolist(), w.digest(1, first, after).tolist()))
    spans = [w.raw[w.starts[i] : w.ends[i + 3]] for i in range(w.n)]
    seen = {}
    for digest, span in zip(digests, spans):
        assert seen.setdefault(digest, span) == span
    assert len(seen) == len(set(spans))


def test_texts_made_to_collide_stay_apart(spark):
    """Words, and orders of words, whose sums of letters agree modulo every power of two for every odd base."""
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in PAIR)
    c, d = (" ".join("la" if x == "a" else "li" for x in p) for p in PAIR)
    rows = [(1, a), (2, b), (3, c), (4, d + " end"), (5, b.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(df).collect()}
    assert got[1] == 1 and got[2] == 2 and got[5] == 2
    after = {r["doc_id"]: r["text"] for r in chunk_dedup.remove_repeats(df.filter("doc_id < 3")).collect()}
    assert after == {1: a, 2: b}
