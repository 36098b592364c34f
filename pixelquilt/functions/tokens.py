"""Token arrays: encoding, clipping, the image template, padding, labels, positions.

All of it stays ``array<int>`` expressions. A token array is bounded by the text cell it came from, so the
per-row array passes here never grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.functions.binding import let, let_all
from pixelquilt.functions.hashing import hash32

IDS = "array<int>"


def capped(value: Column, limit: int) -> Column:
    """At most ``limit``. Unlike ``least`` it keeps a null, so that a missing text has no length."""
    return F.when(value > limit, F.lit(limit)).otherwise(value)


# --- text to ids -------------------------------------------------------------------------------


def text_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(C.TOKEN_PATTERN), F.lit(0))


def token_id(token: Column) -> Column:
    """Special markers by their fixed id, everything else by hash."""
    specials = F.create_map(*[F.lit(x) for pair in C.SPECIAL_IDS.items() for x in pair])
    hashed = (hash32(token) % C.HASHED_IDS).cast("int")
    return F.when(token.startswith("<|"), F.coalesce(F.try_element_at(specials, token), hashed)).otherwise(hashed)


def tokenize(text: Column, bos: bool = True, limit: int | None = None) -> Column:
    """Text to ids. With ``limit`` only the first ids are kept, and only those are looked up."""
    front = 1 if bos else 0
    found = text_tokens(text)
    if limit is not None:
        found = F.slice(found, 1, max(limit - front, 0))
    ids = F.transform(found, token_id)
    if not bos or limit == 0:
        return ids
    return F.concat(F.array(F.lit(C.BOS_ID)), ids)


def token_count(text: Column, bos: bool = True) -> Column:
    """``size(tokenize(text))`` without building the array."""
    return F.regexp_count(text, F.lit(C.TOKEN_PATTERN)) + (1 if bos else 0)


def text_length(text: Column, max_length: int) -> Column:
    """Length of ``encode_text`` from the text alone: BOS, text, end marker, cut to the budget."""
    return capped(token_count(text) + 1, max_length)


def encode_text(text: Column, max_length: int) -> Column:
    """Text-only rows: end marker appended, BOS in front, cut to ``max_length`` (which may cut the marker)."""
    return tokenize(F.concat(text, F.lit(C.END_OF_TEXT)), limit=max_length)


def text_budget(max_length: int) -> int:
    """Image rows give half of the budget to text, at least the closing id."""
    if max_length < 2:
        raise ValueError("The budget leaves no room for text")
    return max_length // 2


def clip_text(ids: Column, max_length: int, boa: bool = False) -> Column:
    """Keep the text budget less one, then close with one id."""
    return F.concat(F.slice(ids, 1, text_budget(max_length) - 1), _closing(boa))


def _closing(boa: bool) -> Column:
    return F.array(F.lit(C.SPECIAL_IDS[C.END_HEADER] if boa else C.EOS_ID))


def tokenize_clipped(text: Column, max_length: int, boa: bool = False) -> Column:
    """``clip_text(tokenize(text))`` without looking up the ids that are clipped."""
    return F.concat(tokenize(text, limit=text_budget(max_length) - 1), _closing(boa))


def clipped_length(text: Column, max_length: int) -> Column:
    return capped(token_count(text), text_budget(max_length) - 1) + 1


# --- the image template ------------------------------------------------------------------------

_LOW = C.LOW_RES_POSITIONS
_HIGH = C.HIGH_RES_POSITIONS
TEMPLATE_LENGTH = C.LOW_RES_IMAGES * (_LOW + 1) + C.HIGH_RES_IMAGES * (_HIGH + 1)
PATCH_COUNT = C.LOW_RES_IMAGES * _LOW + C.HIGH_RES_IMAGES * _HIGH
_RUNS = [_LOW] * C.LOW_RES_IMAGES + [_HIGH] * C.HIGH_RES_IMAGES


def template_ids() -> Column:
    """One low-resolution run and 40 high-resolution runs of placeholders, each closed by a newline id.

    Built of foldable functions only: the optimizer turns it into one constant.
    """
    placeholder = F.lit(C.SPECIAL_IDS[C.IMAGE_PLACEHOLDER])
    newline = F.array(F.lit(C.SPECIAL_IDS[C.IMAGE_NEWLINE]))
    return F.concat(*[part for run in _RUNS for part in (F.array_repeat(placeholder, run), newline)])


def template_patches() -> Column:
    """The patch index under each template position; newlines carry none. Also one constant."""
    none = F.array(F.lit(C.NO_PATCH))
    parts, first = [], 0
    for run in _RUNS:
        parts += [F.sequence(F.lit(first), F.lit(first + run - 1)), none]
        first += run
    return F.concat(*parts)


def reserved_length(length: Column, reserve: int = C.RESERVED_GENERATION, limit: int = C.MAX_POSITIONS) -> Column:
    """Length with the generation slots, as far as the positions reach."""
    return capped(length + reserve, limit)


def sequence_plan(length: Column, reserve: int = C.RESERVED_GENERATION, limit: int = C.MAX_POSITIONS) -> Column:
    """``struct<target, over>``; a prompt that does not fit at all is an error, a short budget is only reported."""
    target = F.when(
        length > limit, F.raise_error(F.lit("Prompt is longer than the sequence length")).cast("int")
    ).otherwise(reserved_length(length, reserve, limit).cast("int"))
    return F.struct(target.alias("target"), (length + reserve > limit).alias("over"))


def image_patch_indices(length: Column) -> Column:
    """The template's patch index, then none up to the reserved length of a row of ``length`` ids."""
    target = reserved_length(length)
    return F.slice(pad_right(template_patches(), target, C.NO_PATCH), 1, target)


# --- padding -----------------------------------------------------------------------------------


def _fill(array: Column, target: Column, value: int) -> Column:
    return F.array_repeat(F.lit(value), (target - F.size(array)).cast("int"))


def pad_right(array: Column, target: Column, value: int) -> Column:
    return F.concat(array, _fill(array, target, value))


def pad_left(array: Column, target: Column, value: int) -> Column:
    return F.concat(_fill(array, target, value), array)


def ones(array: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(array))


def drop_last(array: Column) -> Column:
    """Empty stays empty."""
    return F.slice(array, 1, F.greatest(F.size(array) - 1, F.lit(0)))


# --- labels ------------------------------------------------------------------------------------


def label_mask(ids: Column, bos: int = C.BOS_ID, ignored: int = C.IGNORED_LABEL) -> Column:
    """Everything up to and including the first BOS is ignored, all that follows is a target."""
    at = F.array_position(ids, F.lit(bos)).cast("int")
    missing = F.raise_error(F.lit("No beginning-of-text id in the sequence")).cast(IDS)
    masked = F.concat(F.array_repeat(F.lit(ignored), at), F.slice(ids, at + 1, F.size(ids)))
    return F.when(at == 0, missing).otherwise(masked)


def repeated_bos_index(ids: Column, bos: int = C.BOS_ID) -> Column:
    """Zero-based place of the last BOS where there is more than one, else null."""
    first = F.array_position(ids, F.lit(bos)).cast("int")
    last = F.size(ids) - F.array_position(F.reverse(ids), F.lit(bos)).cast("int") + 1
    return F.when((first > 0) & (last > first), last - 1)


def put_at(array: Column, index: Column, value: int) -> Column:
    """``array`` with ``value`` at a zero-based place; a null place leaves it alone."""
    return F.when(index.isNull(), array).otherwise(
        F.concat(
            F.slice(array, 1, index),
            F.array(F.lit(value)),
            F.slice(array, index + 2, F.size(array)),
        )
    )


# --- positions ---------------------------------------------------------------------------------


def position_ids(mask: Column, last_only: bool = False) -> Column:
    """``cumsum(mask) - 1``, and 1 where masked out.

    A mask with one run of ones (any padding side) has a closed form. Only a row with holes inside the run
    counts the masked-out places before each position, so padded batches stay linear.
    """

    def positions(v: Column) -> Column:
        whole = (v["first"] >= 0) & (v["last"] - v["first"] + 1 == v["ones"])
        closed = F.transform(v["mask"], lambda m, i: F.when(m == 0, F.lit(1)).otherwise(i - v["first"]))
        holes = F.filter(F.sequence(F.lit(0), F.size(v["mask"]) - 1), lambda i: F.get(v["mask"], i) == 0)
        counted = let(
            holes,
            lambda h: F.transform(
                v["mask"],
                lambda m, i: F.when(m == 0, F.lit(1)).otherwise(i - F.size(F.filter(h, lambda x: x < i))),
            ),
        )
        return F.when(F.size(v["mask"]) == 0, F.array().cast(IDS)).otherwise(F.when(whole, closed).otherwise(counted))

    def bound(m: Column) -> Column:
        return let_all(
            {
                "mask": m,
                "first": F.array_position(m, F.lit(1)).cast("int") - 1,
                "last": F.size(m) - F.array_position(F.reverse(m), F.lit(1)).cast("int"),
                "ones": F.aggregate(m, F.lit(0), lambda acc, x: acc + x),
            },
            positions,
        )

    result = let(mask, bound)
    return F.slice(result, -1, 1) if last_only else result
