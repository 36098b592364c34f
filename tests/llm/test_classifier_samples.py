"""What the classifier's dictionaries are taught: pieces of whole texts, from a bounded number of rows."""

import random

from pixelquilt.llm import classifier


def test_dictionaries_see_whole_texts_of_bounded_rows(spark, monkeypatch):
    draw = random.Random(6)
    words = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    # 8 kB alike for both kinds, then 24 kB that tell them apart.
    rows = [(i, f"{words(1170)} " + ("GOOD " if i % 2 else "POOR ") * 4800) for i in range(120)]
    repeated = [(0, words(20)) for _ in range(300)] + [(1, words(20)) for _ in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    taught = []
    plain = classifier._dictionary
    monkeypatch.setattr(classifier, "_dictionary", lambda samples: taught.append(samples) or plain(samples))
    monkeypatch.setattr(classifier, "DICTIONARY_ROWS", 200)
    classifier.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    good, bad = ([s if isinstance(s, bytes) else s.encode() for s in samples] for samples in taught)
    assert sum(b"GOOD" in s for s in good) > 0.8 * len(good) > 0 and sum(b"POOR" in s for s in bad) > 0.8 * len(bad) > 0
    assert all(len(s) <= classifier.SAMPLE_BYTES for s in good + bad)
    taught.clear()
    classifier.fit(spark.createDataFrame(rows + repeated * 2, "doc_id long, text string"), labels)
    assert len(taught) == 2 and all(len(samples) <= 200 for samples in taught)


def test_samples_are_pieces_in_order():
    text = "".join(f"{i:08d}" for i in range(5000)) + "end"
    assert classifier.sample_of(text[:4000]) == text[:4000].encode() and classifier.sample_of("") == b""
    sample = classifier.sample_of(text)
    assert len(sample) <= classifier.SAMPLE_BYTES and all(sample[i : i + 2048].decode() in text for i in range(0, len(sample), 2048))
