"""Text steps against brute force and the library, on odd rows and on the small tables."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquilt.llm import bpe, chunk_dedup, classifier, jaccard_join, packing, pii, quality_rules, token_counts, token_files
from pixelquilt.llm.encoding import Encoder, load_tokenizer
from pixelquilt.llm.transducer import BpeDecoder, BpeEncoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def whole(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_segments_encode_as_whole_texts(name):
    library, own, draw = load_tokenizer(name), Encoder.of(name), random.Random(3)
    pieces = ["\t", "\n", "\x0b", "\x1c", "\x1f", " ", "\x85", "\xa0", " ", "a", "É", "İ", "Σ", "!", "#", "<|endoftext|>", "it's ", "́", "12", "日本", "😀", "  "]
    for _ in range(400):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 12)))
        assert own.ids(text) == packed(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_transducer_matches_library_with_a_bounded_buffer():
    library, own, draw = load_tokenizer("word_bpe_49k.json"), BpeEncoder.of("word_bpe_49k.json"), random.Random(5)
    for text in ["".join(draw.choice(letters) for _ in range(n)) for letters, n in (("etaoinshr", 9000), ("ab", 5000), ("aeé", 4000), ("İß", 3000))]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert b"".join(own.stream(text)) == packed(ids)
        assert BpeDecoder(own.token_of).feed(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point_encodes_as_in_the_library():
    library, own = load_tokenizer("word_bpe_49k.json"), BpeEncoder.of("word_bpe_49k.json")
    texts = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 97 == 0)]
    for form in ("{}", "a{}b 1{}"):
        lines = [form.replace("{}", t) for t in texts]
        want = [packed(e.ids) for e in library.encode_batch(lines, add_special_tokens=False)]
        off = [t for t, line, ids in zip(texts, lines, want) if b"".join(own.stream(line)) != ids]
        assert not off, [hex(ord(c)) for c in off[:20]]


def test_odd_strings_encode_as_in_the_library():
    library, own, draw = load_tokenizer("word_bpe_49k.json"), BpeEncoder.of("word_bpe_49k.json"), random.Random(7)
    pieces = ["\t", "\n", "\x1c", " ", "\x85", "\xa0", "a", "É", "İ", "Σ", "!", "#", "<|endoftext|>", "<|END", "it's ", "I'LL", "\x01", " \x01 ", "\u0301", "12", "日本", "😀", "  ", "\u088f", "ﬁ"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 12)))
        assert b"".join(own.stream(text)) == packed(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_long_texts_are_cut_and_long_words_emitted_piece_by_piece():
    library, own, draw = load_tokenizer("word_bpe_49k.json"), BpeEncoder.of("word_bpe_49k.json"), random.Random(8)
    text = " ".join("".join(draw.choice("abcdeé,") for _ in range(draw.randint(1, 9))) for _ in range(120_000))
    assert len(text) > 2 * (1 << 18)
    assert b"".join(own.stream(text)) == packed(library.encode(text, add_special_tokens=False).ids)
    other = Encoder.of("byte_bpe_50k.json")
    assert other.ids(text) == packed(load_tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids) and Encoder.of("byte_bpe_50k.json", True).count(text) * 4 == len(other.ids(text))
    word = "".join(draw.choice("etaoin") for _ in range(600_000))
    pieces = list(own.stream(word))
    assert len(pieces) > 500 and max(map(len, pieces)) <= 4 * 2 * own.merges.lookahead * 4
    assert b"".join(pieces) == packed(library.encode(word, add_special_tokens=False).ids)


def test_encoding_keeps_little_memory():
    """A text of 50 MB in windows: what is held besides it does not grow with it."""
    own = BpeEncoder.of("word_bpe_49k.json")
    line = " ".join(f"word{i % 5000}" for i in range(20_000)) + " "
    text = line * (50_000_000 // len(line))
    tracemalloc.start()
    count = sum(len(ids) for ids in own.stream(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count > 4 * 5_000_000 and peak < 60_000_000


def test_round_trip_query(spark, odd):
    library = load_tokenizer("word_bpe_49k.json")
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert whole(bpe.round_trip(odd)) == sorted(want, key=repr) and bpe.round_trip(odd.limit(0)).count() == 0


def test_byte_decoder_holds_back_unfinished_characters():
    library = load_tokenizer("byte_bpe_50k.json")
    ids = library.encode("naïve 😀 日本<|endoftext|>", add_special_tokens=False).ids[:-2]
    machine = BpeDecoder({i: t for t, i in library.get_vocab().items()}, byte_level=True, special=[50256])
    assert "".join(machine.feed([i]) for i in ids) + machine.end() == library.decode(ids, skip_special_tokens=False)


def test_encode_decode(spark, odd):
    library = load_tokenizer("word_bpe_49k.json")
    got = whole(bpe.decode_ids(bpe.encode_texts(odd), digest=True))
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len(ids), hashlib.sha256(packed(ids)).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode_texts(odd.limit(0)).count() == 0


def test_token_counts(odd):
    library = load_tokenizer("byte_bpe_50k.json")
    want = []
    for r in odd.collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(text.encode()), n, n > 1024))
    assert whole(token_counts.count_tokens(odd)) == sorted(want, key=repr)
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_token_files(spark, odd, tmp_path):
    library = load_tokenizer("word_bpe_49k.json")
    path = str(tmp_path / "tokens")
    token_files.write_tokens(odd, path)
    order = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    start, want, every = 0, [], []
    for r in order:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(packed(ids))))
        start, every = start + len(ids), every + ids
    assert whole(token_files.read_documents(spark, path)) == sorted(want, key=repr)
    at = [0, 1, len(every) // 2, len(every) - 1]
    assert whole(token_files.tokens_at(spark, path, at)) == sorted(((p, every[p]) for p in set(at)), key=repr)
    token_files.write_tokens(odd.limit(0), str(tmp_path / "none"))
    assert token_files.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_codes_are_addressable():
    ids = np.random.default_rng(1).integers(0, 1 << 20, 5000)
    codes = token_files.Codes(*token_files.pack(ids))
    at = np.random.default_rng(2).integers(0, 5000, 300)
    assert (codes.at(at) == ids[at]).all() and (codes.slice(700, 3100) == ids[700:3100]).all()


def test_packing(odd, docs):
    library = load_tokenizer("byte_bpe_50k.json")
    for table in (odd, docs.select("doc_id", "text")):
        got = packing.pack_documents(table, ids=True).collect()
        want = sorted(packed([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in table.collect())
        by_doc = collections.defaultdict(list)
        for p in got:
            assert p["length"] * 4 == len(p["ids"]) and p["ids_crc32"] == zlib.crc32(p["ids"])
            by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        assert sum(len(p["ids"]) for p in got) == sum(map(len, want))
        sequences = collections.defaultdict(list)
        for p in got:
            sequences[p["sequence_id"]].append(p)
        for pieces in sequences.values():
            at = 0
            for p in sorted(pieces, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at <= packing.CAPACITY
    padding = 1 - sum(p["length"] for p in got) / (packing.CAPACITY * len(sequences))
    assert padding < 0.05
    assert packing.pack_documents(odd.limit(0)).count() == 0


def statistics_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark, odd, docs):
    for table in (odd, docs):
        judged = quality_rules.judge(table).collect()
        want = sorted(((r["doc_id"], *statistics_of(r["text"])) for r in table.collect()), key=repr)
        assert sorted(((r["doc_id"], *[r[n] for n in quality_rules.STATISTICS]) for r in judged), key=repr) == want
        for r in judged:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
        kept = quality_rules.keep_good(table)
        assert kept.columns == table.columns and kept.count() == sum(r["kept"] for r in judged)
    assert quality_rules.judge(odd.limit(0)).count() == 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    # Labels know nothing of the bounds on length and repetition.
    assert all(r["kept"] == (labels[r["doc_id"]] == 1) for r in judged if r["doc_id"] in labels and not r["base_failed"])


def test_pseudonyms(spark, odd):
    texts = ["2004-02-29 31/12/1999 12.31.2001 jo.Smith99@a-b.co.uk 8.8.8.8 4111 1111 1111 1111 +49 30 1234567", "99/99/2000 1999-13-01 300.1.1.1 4111111111111112", "", None]
    table = spark.createDataFrame([(t, "x") for t in texts], "text string, `n` string")
    got = [r["text"] for r in pii.pseudonymise(table).collect()]
    assert got[1:] == texts[1:]
    old, new = texts[0].split(), got[0].split()
    assert len(old) == len(new) and not set(old[:5]) & set(new[:5])
    assert [re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", x))) for x in old if "." not in x or "@" in x] == [re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", x))) for x in new if "." not in x or "@" in x]
    card = [int(c) for c in "".join(new[5:9])]
    assert sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(card)) % 10 == 0
    again = spark.createDataFrame([(f"mail jo.Smith99@a-b.co.uk on {d}",) for d in ("2004-02-29", "31/12/1999")], "text string")
    other = [r["text"].split() for r in pii.pseudonymise(again).collect()]
    assert [o[1] for o in other] == [new[3]] * 2 and [o[3] for o in other] == new[:2]
    assert pii.pseudonymise(odd).columns == odd.columns


def test_pseudonyms_are_one_to_one(spark):
    values = spark.range(400).select(F.concat(F.lit("1.2."), (F.col("id") / 20).cast("int").cast("string"), F.lit("."), (F.col("id") % 20).cast("string")).alias("v"))
    got = values.select("v", pii.pseudonym(F.col("v"), "k").alias("p")).select("v", "p", pii.pseudonym(F.col("p"), "k", True).alias("b")).collect()
    assert len({r["p"] for r in got}) == 400 and all(r["b"] == r["v"] for r in got)


@pytest.mark.parametrize("century", [1900, 2000])
def test_all_dates_of_a_century_come_back(spark, century):
    """In each form: no two dates share a pseudonym, and each is read the way it was written."""
    days = spark.range(36525).select(F.date_add(F.make_date(F.lit(century), F.lit(1), F.lit(1)), F.col("id").cast("int")).alias("d")).filter(F.year("d") < century + 100)
    forms = F.array(*map(F.lit, ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")))
    values = days.select("d", F.explode(forms).alias("f")).select("f", "d", F.call_function("date_format", "d", "f").alias("v")).select("v").distinct()
    got = values.select("v", pii.pseudonym(F.col("v"), "k").alias("p")).select("v", "p", pii.pseudonym(F.col("p"), "k", True).alias("b"))
    n, distinct, back, same = got.agg(F.count("*"), F.count_distinct("p"), F.sum((F.col("b") == F.col("v")).cast("int")), F.sum((F.col("p") == F.col("v")).cast("int"))).first()
    # A slashed date with both numbers up to 12 stands for itself in two forms.
    assert n == distinct == back and n > 3 * 36524 + 22000 and same < 40


def test_one_date_has_one_pseudonym_in_all_forms(spark):
    texts = ["1955-10-31 31/10/1955 10/31/1955 31.10.1955", "1952-03-04 04/03/1952 04.03.1952"]
    for r in pii.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string"), key="k").collect():
        new = r["text"].split()
        y, m, d = new[0].split("-")
        assert new[1] == f"{d}/{m}/{y}" and new[-1] == f"{d}.{m}.{y}" and (len(new) == 3 or new[2] == f"{m}/{d}/{y}")


def test_identity_numbers(spark):
    rows = [f"{a:03d}-{b:02d}-{c:04d}" for a in (1, 123, 666, 999) for b in (1, 50, 99) for c in (1, 4321, 9999)]
    got = spark.createDataFrame([(v,) for v in [*rows, "000-12-3456", "123-00-4567", "123-45-0000"]], "v string").select("v", pii.pseudonym(F.col("v"), "k").alias("p"))
    got = got.select("v", "p", pii.pseudonym(F.col("p"), "k", True).alias("b")).collect()
    assert all(r["b"] == r["v"] and re.fullmatch(r"\d{3}-\d{2}-\d{4}", r["p"]) for r in got) and len({r["p"] for r in got}) == len(got)
    assert all((r["p"] == r["v"]) == (r["v"] not in rows) for r in got) and not any(re.search("^000|-00-|-0000", r["p"]) for r in got if r["v"] in rows)


def test_the_key_is_the_sessions(spark):
    df = spark.createDataFrame([("1955-10-31 8.8.8.8",)], "text string")
    drawn = pii.pseudonymise(df).first()[0]
    assert drawn == pii.pseudonymise(df).first()[0] == pii.pseudonymise(df, key=pii.session_key(spark)).first()[0]
    spark.conf.set(pii.KEY_SETTING, "other")
    try:
        assert pii.pseudonymise(df).first()[0] == pii.pseudonymise(df, key="other").first()[0] != drawn
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def components_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for key, text in rows:
        w = WORD.findall((text or "").translate(low))
        sets.append((key, frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, a) in enumerate(sets):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(a), least.get(find(i)) if a else key) for i, (key, a) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("frequent", [48, 3])
def test_jaccard_join(spark, odd, frequent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    draw = random.Random(11)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(80)]
    rows = [(i, " ".join(w if draw.random() > 0.01 else f"m{draw.randint(0, 10**6)}" for w in base)) for i in range(60)]
    rows += [(100 + i, " ".join([f"u{draw.randint(0, 10**6)}" for _ in range(40)] + base[:60])) for i in range(30)]
    rows += [(200 + i, rows[i % 7][1].upper()) for i in range(20)] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = whole(jaccard_join.classes(table).drop("text_hash"))
    assert got == components_of(rows)
    assert jaccard_join.keep_one(table).count() == sum(k is None or k == c for k, _, c in got)


def test_template_texts_do_not_meet_pair_by_pair(spark, monkeypatch):
    """Texts on one template that stay below the bound: what they could share is known before they meet. Those of them
    that link are found, over frequent columns alone too."""
    draw = random.Random(12)
    word = lambda: f"w{draw.randint(0, 10**7)}"
    template = [word() for _ in range(160)]
    rows = [(i, " ".join([*template, *[word() for _ in range(40)]])) for i in range(150)]
    rows += [(1000 + i, " ".join([*template[draw.randint(0, 6) : 160 - draw.randint(0, 6)], *[word() for _ in range(4)]])) for i in range(120)]
    seen = []
    plain = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, sets, percent: seen.append(pairs.count()) or plain(pairs, sets, percent))
    got = whole(jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash"))
    assert got == components_of(rows)
    assert sum(seen) < 150 * 149 / 4


def test_chunk_dedup(spark, odd):
    draw = random.Random(4)
    text = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(n))
    passage = text(120)
    rows = [(1, f"{text(90)} {passage} {text(80)}"), (2, f"{text(60)}\n{passage} {text(70)}"), (3, text(150)), (4, None), (5, "")]
    rows += [(None, text(100))] * 2
    table = spark.createDataFrame([(k, t, k) for k, t in rows], "doc_id long, text string, places long")
    got = chunk_dedup.remove_repeats(table)
    assert got.columns == table.columns
    after = {r["doc_id"]: r["text"] for r in got.collect()}
    before = dict(rows)
    assert all(after[k] == before[k] for k in (1, 3, 4, 5, None)) and got.count() == len(rows)
    assert len(before[2]) - len(after[2]) > 0.75 * len(passage) and passage not in after[2]
    assert after[2].startswith(before[2][:300]) and chunk_dedup.remove_repeats(odd).count() == odd.count()
    assert chunk_dedup.remove_repeats(table.limit(0)).count() == 0


def test_cuts_survive_insertions():
    draw = random.Random(9)
    raw = " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(500)).encode()
    moved = b"something new " + raw
    a, b = (set(chunk_dedup.cuts_of(np.frombuffer(x, np.uint8)).tolist()) for x in (raw, moved))
    assert len({x + 14 for x in a} & b) > 0.95 * len(a)


def test_classifier(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id").select(docs["*"])
    got = {r["doc_id"]: r for r in classifier.score(known, classifier.fit(docs, labels)).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k]["held_out"] == (k in set(held)) for k in got)
    assert sum(got[k]["predicted"] == truth[k] for k in held) / len(held) > 0.95
    model = classifier.fit(docs.limit(0), labels)
    scored = classifier.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
