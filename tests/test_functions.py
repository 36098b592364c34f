"""Edge cases and errors of the column expressions."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.functions import geometry, prompts, tags, tokens


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def text(s):
    return F.lit(s) if s is not None else F.lit(None).cast("string")


@pytest.mark.parametrize(
    "url, expected",
    [
        (None, None),
        ("", None),
        (" \t\n", None),
        ("  ", None),
        ("/data/a.png", "/data/a.png"),
        ("/mnt/a.png", "/mnt/a.png"),
        ("a.png", "/img/a.png"),
        (" a.png ", "/img/ a.png "),
    ],
)
@pytest.mark.parametrize("base", ["/img", "/img/"])
def test_resolve_image_ref(spark, url, expected, base):
    assert value(spark, prompts.resolve_image_ref(text(url), base)) == expected
    assert value(spark, prompts.has_image(text(url))) is (expected is not None)


def test_caption_prompt_is_repeatable_and_from_the_list(spark):
    column = prompts.caption_prompt(F.lit("a cat"), F.col("id"), 7)
    rows = [r[0] for r in spark.range(200).select(column).collect()]
    assert rows == [r[0] for r in spark.range(200).repartition(3).sort("id").select(column).collect()]
    heads = {r.split("<|end_header_id|>\n\n")[1].split("<|eot_id|>")[0] for r in rows}
    assert heads <= set(C.CAPTION_INSTRUCTIONS) and len(heads) > 15
    assert all(r.endswith("<|start_header_id|>assistant<|end_header_id|>\n\na cat<|eot_id|>") for r in rows)


def test_conversation_prompt_null_text_passes_through(spark):
    assert value(spark, prompts.conversation_prompt(text(None), text("chat"), F.lit(1), 1)) == "chat"
    assert value(spark, prompts.conversation_prompt(text(None), text(None), F.lit(1), 1)) is None


def test_inference_prompt(spark):
    base = "<|start_header_id|>user<|end_header_id|>\n\n{}<|eot_id|><|start_header_id|>assistant<|end_header_id|>"
    assert value(spark, prompts.inference_prompt(F.lit("q"))) == base.format("q")
    assert value(spark, prompts.inference_prompt(F.lit("q"), "s")) == base.format("s q")
    assert value(spark, prompts.inference_prompt(F.lit("q"), newline=True)) == base.format("q") + "\n\n"


@pytest.mark.parametrize("s, expected", [("x" * 23, "x" * 23), ("a" * 12 + "b" * 12, "a" * 10 + "..." + "b" * 10), ("", "")])
def test_truncate_middle(spark, s, expected):
    assert value(spark, prompts.truncate_middle(F.lit(s))) == expected


# --- tags ---------------------------------------------------------------------------------------


def test_segments(spark):
    def segments(s):
        return [tuple(r) for r in value(spark, tags.segment_tags(tags.tags_to_tokens(F.lit(s))))]

    assert segments("a<box>1, 2, 3, 4</box>b<point>5, 6</point>") == [
        ("a", False), ("1, 2, 3, 4", True), ("b", False), ("5, 6", True),
    ]
    assert segments("<box>1, 2, 3, 4</box>") == [("1, 2, 3, 4", True)]
    # An opening without a close still marks what follows; a close alone does not.
    assert segments("x<box>rest") == [("x", False), ("rest", True)]
    assert segments("x</box>rest") == [("x", False), ("rest", False)]
    assert segments("<box></box>") == []
    assert segments("") == []


def test_scale_tags_rounds_half_to_even(spark):
    point = value(spark, tags.scale_tags(F.lit("1, 3"), 1.0))
    assert point == [C.POINT_OPEN_TOKEN, "0", "2", C.POINT_CLOSE_TOKEN]
    box = value(spark, tags.scale_tags(F.lit("5, 7, 10, -3"), 1.0))
    assert box == [C.BOX_OPEN_TOKEN, "2", "4", "5", "-2", C.BOX_CLOSE_TOKEN]


def test_scale_tags_arity(spark):
    with pytest.raises(PySparkException):
        value(spark, tags.scale_tags(F.lit("1, 2, 3"), 1.0))
    assert value(spark, tags.scale_tags(F.lit("1, 2, 3"), 1.0, strict=False)) is None


def test_tokenize_tagged_has_bos_per_plain_piece(spark):
    ids = value(spark, tags.tokenize_tagged(F.lit("hi<point>2, 4</point>you"), 1.0))
    assert ids.count(C.BOS_ID) == 2
    assert C.SPECIAL_IDS[C.POINT_OPEN_TOKEN] in ids and C.SPECIAL_IDS[C.POINT_CLOSE_TOKEN] in ids


BO, BC, PO, PC = C.BOX_OPEN_TOKEN, C.BOX_CLOSE_TOKEN, C.POINT_OPEN_TOKEN, C.POINT_CLOSE_TOKEN


def restored(spark, words, fn=tags.restore_boxes, size=(100, 100, 336, 336)):
    return value(spark, fn(F.array(*[F.lit(w) for w in words]), *[F.lit(x) for x in size]))


def test_restore_boxes(spark):
    span = [BO, "1", "2", "3", "4", BC]
    good = " <box>2, 4, 6, 8</box>"
    assert restored(spark, span) == [good]
    assert restored(spark, ["a", *span, "b", *span, *span]) == ["a", good, "b", good, good]
    # A malformed pair is left alone, also in front of a good one.
    assert restored(spark, [BO, "1", BC, *span]) == [BO, "1", BC, good]
    assert restored(spark, [BO, "1", "2", "x", "4", BC]) == [BO, "1", "2", "x", "4", BC]
    assert restored(spark, ["a", BO]) == ["a", BO]
    assert restored(spark, ["a"]) == ["a"]
    # Twice the size of the target: coordinates double, cut towards zero.
    assert restored(spark, [BO, "1", "2", "-3", "4", BC], size=(672, 672, 336, 336)) == [" <box>4, 8, -12, 16</box>"]


def test_restore_points(spark):
    assert restored(spark, ["a", PO, "7", "9", PC], tags.restore_points) == ["a", " <point>14, 18</point>"]
    assert restored(spark, [PO, "7", PC], tags.restore_points) == [PO, "7", PC]


# --- geometry -----------------------------------------------------------------------------------


def best_by_hand(w, h, candidates):
    found, most, least = None, 0, float("inf")
    for tw, th in candidates:
        s = min(tw / w, th / h)
        kept = min(int(w * s) * int(h * s), w * h)
        if kept > most or (kept == most and tw * th - kept < least):
            found, most, least = (tw, th), kept, tw * th - kept
    return found


def test_best_resolution(spark):
    sizes = [(1, 1), (336, 336), (50, 50), (10, 4000), (4000, 10), (1, 100000), (672, 672), (335, 1344), (1000, 999)]
    candidates = geometry.middle_candidates()
    df = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(sizes)], "i int, w int, h int")
    got = {r["i"]: tuple(r["b"]) for r in df.select("i", geometry.best_resolution(F.col("w"), F.col("h"), candidates).alias("b")).collect()}
    assert got == {i: best_by_hand(w, h, candidates) for i, (w, h) in enumerate(sizes)}
    # A small image fits every candidate equally well; the first one of equal area wins.
    assert got[2] == (672, 672)


def test_crop_count(spark):
    df = spark.createDataFrame([(0, 10, 4000), (1, 500, 500)], "i int, w int, h int")
    crops = df.select("i", geometry.crop_boxes(F.col("w"), F.col("h")).alias("c")).collect()
    for row in crops:
        assert [c["crop_id"] for c in row["c"]] == list(range(41))
        assert [c["level"] for c in row["c"]] == ["whole"] + ["middle"] * 4 + ["high"] * 36


def test_patch_grid_overhangs(spark):
    boxes = value(spark, geometry.patch_boxes(F.lit(5), F.lit(3), 2))
    assert [tuple(b)[1:] for b in boxes] == [(0, 0, 2, 2), (2, 0, 4, 2), (4, 0, 6, 2), (0, 2, 2, 4), (2, 2, 4, 4), (4, 2, 6, 4)]


# --- tokens -------------------------------------------------------------------------------------


def test_tokenizer_splits_specials(spark):
    assert value(spark, tokens.text_tokens(F.lit("a<|eot_id|>b  c<d\n<"))) == ["a", "<|eot_id|>", "b", "c", "<", "d", "<"]
    ids = value(spark, tokens.tokenize(F.lit("<|eot_id|><|unknown_x|>")))
    assert ids[:2] == [C.BOS_ID, 128009] and 0 <= ids[2] < C.HASHED_IDS
    assert value(spark, tokens.token_count(F.lit("a<|eot_id|>b"))) == 4


def test_encode_text_may_cut_the_marker(spark):
    assert value(spark, tokens.encode_text(F.lit("a b"), 10))[-1] == C.EOS_ID
    assert C.EOS_ID not in value(spark, tokens.encode_text(F.lit("a b"), 3))
    assert len(value(spark, tokens.encode_text(F.lit("a b c d"), 3))) == 3


def test_clip_text(spark):
    ids = F.lit(list(range(10)))
    assert value(spark, tokens.clip_text(ids, 8)) == [0, 1, 2, C.EOS_ID]
    assert value(spark, tokens.clip_text(ids, 9, True)) == [0, 1, 2, C.SPECIAL_IDS[C.END_HEADER]]
    assert value(spark, tokens.clip_text(ids, 100)) == [*range(10), C.EOS_ID]


def test_template(spark):
    ids = value(spark, tokens.template_ids())
    patches = value(spark, tokens.template_patches())
    assert len(ids) == len(patches) == tokens.TEMPLATE_LENGTH == 2098
    assert [p for p in patches if p >= 0] == list(range(2057)) and tokens.PATCH_COUNT == 2057
    assert [i for i, x in enumerate(ids) if x == C.SPECIAL_IDS[C.IMAGE_NEWLINE]] == [i for i, p in enumerate(patches) if p < 0]
    assert patches[577] == -1 and patches[578] == 577


def test_sequence_plan(spark):
    assert tuple(value(spark, tokens.sequence_plan(F.lit(100)))) == (110, False)
    assert tuple(value(spark, tokens.sequence_plan(F.lit(16380)))) == (16384, True)
    with pytest.raises(PySparkException):
        value(spark, tokens.sequence_plan(F.lit(16385)))


def test_label_mask(spark):
    ids = F.lit([5, C.BOS_ID, 6, C.BOS_ID, 7])
    assert value(spark, tokens.label_mask(ids)) == [-100, -100, 6, C.BOS_ID, 7]
    with pytest.raises(PySparkException):
        value(spark, tokens.label_mask(F.lit([1, 2])))


@pytest.mark.parametrize("ids, at", [([C.BOS_ID, 1, C.BOS_ID, 2], 2), ([C.BOS_ID, 1], None), ([1], None), ([C.BOS_ID, C.BOS_ID], 1)])
def test_repeated_bos(spark, ids, at):
    assert value(spark, tokens.repeated_bos_index(F.lit(ids))) == at
    expected = [C.EOS_ID if i == at else x for i, x in enumerate(ids)]
    assert value(spark, tokens.put_at(F.lit(ids), tokens.repeated_bos_index(F.lit(ids)), C.EOS_ID)) == expected


@pytest.mark.parametrize("mask", [[1, 1, 1], [0, 0, 1, 1], [1, 1, 0], [0, 1, 0, 1, 1, 0], [0, 0], [1], [1, 0, 0, 1]])
def test_position_ids(spark, mask):
    total, expected = 0, []
    for m in mask:
        total += m
        expected.append(total - 1 if m else 1)
    assert value(spark, tokens.position_ids(F.lit(mask))) == expected
    assert value(spark, tokens.position_ids(F.lit(mask), True)) == expected[-1:]


def test_strip_placeholders(spark):
    seeded = C.IMAGE_PLACEHOLDER + "a" + C.IMAGE_NEWLINE + C.IMAGE_PLACEHOLDER + "b"
    assert value(spark, prompts.strip_placeholders(F.lit(seeded))) == "ab"


def test_missing_values_stay_missing(spark):
    none, size = F.lit(None).cast("string"), F.lit(None).cast("int")
    ten = F.lit(10)
    for column in (
        tokens.text_length(none, 100),
        tokens.clipped_length(none, 100),
        tokens.encode_text(none, 100),
        tokens.tokenize_clipped(none, 100),
        tokens.reserved_length(size),
        tags.segment_tags(none),
        tags.tokenize_tagged(none, 1.0),
        geometry.best_resolution(ten, size, geometry.middle_candidates()),
        geometry.crop_boxes(size, ten),
        geometry.fit_and_pad(size, ten, 5, 5),
        geometry.fit_scale(ten, size, ten, ten),
        geometry.patch_boxes(ten, size, 3),
        prompts.truncate_middle(none),
        prompts.inference_prompt(none),
    ):
        assert value(spark, column) is None


def test_clipped_tokens_are_the_same(spark):
    text_ = F.lit("one two three four five")
    for limit in (2, 4, 8, 100):
        for boa in (False, True):
            both = F.struct(tokens.tokenize_clipped(text_, limit, boa), tokens.clip_text(tokens.tokenize(text_), limit, boa))
            got = value(spark, both)
            assert got[0] == got[1]
        assert value(spark, tokens.tokenize(text_, limit=limit)) == value(spark, tokens.tokenize(text_))[:limit]
