"""Box and point annotations: from tagged text to tokens and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.functions.binding import let, let_all
from pixelquilt.functions.geometry import fit_scale
from pixelquilt.functions.tokens import IDS, token_id, tokenize

TAG_TOKENS = {
    C.POINT_OPEN_TAG: C.POINT_OPEN_TOKEN,
    C.POINT_CLOSE_TAG: C.POINT_CLOSE_TOKEN,
    C.BOX_OPEN_TAG: C.BOX_OPEN_TOKEN,
    C.BOX_CLOSE_TAG: C.BOX_CLOSE_TOKEN,
}
DELIMITERS = list(TAG_TOKENS.values())
OPENING = [C.BOX_OPEN_TOKEN, C.POINT_OPEN_TOKEN]
_DELIMITER_PATTERN = r"<\|reserved_special_token_[2-5]\|>"
# Cuts before and after every delimiter and keeps the delimiters.
_AROUND_DELIMITERS = f"(?={_DELIMITER_PATTERN})|(?<={_DELIMITER_PATTERN})"


def tags_to_tokens(text: Column) -> Column:
    for tag, token in TAG_TOKENS.items():
        text = F.replace(text, F.lit(tag), F.lit(token))
    return text


def segment_tags(text: Column) -> Column:
    """The pieces between delimiters as ``array<struct<text, is_location>>``.

    A piece is a location when an opening delimiter stands right before it.
    """

    def labelled(pieces: Column) -> Column:
        def label(piece: Column, i: Column) -> Column:
            opened = F.coalesce(F.get(pieces, i - 1).isin(OPENING), F.lit(False))
            return F.struct(piece.alias("text"), opened.alias("is_location"))

        return F.filter(F.transform(pieces, label), lambda s: ~s["text"].isin(DELIMITERS))

    return let(F.filter(F.split(text, _AROUND_DELIMITERS), lambda p: p != ""), labelled)


def scale_tags(location: Column, scale: Column | float, strict: bool = True) -> Column:
    """``"x, y"`` or ``"top, left, bottom, right"`` as ``[open, scaled numbers…, close]``.

    Coordinates are halved, scaled and rounded half to even. Any other count of numbers is an error, or null
    when ``strict`` is off.
    """
    scale = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale

    def scaled(parts: Column) -> Column:
        count = F.size(parts)
        numbers = F.transform(
            parts, lambda p: F.rint(F.trim(p).cast("double") / 2 * scale).cast("int").cast("string")
        )
        otherwise = F.lit(None).cast("array<string>")
        if strict:
            message = F.concat(F.lit("Invalid number of coordinates: "), count.cast("string"))
            otherwise = F.raise_error(message).cast("array<string>")
        point = F.concat(F.array(F.lit(C.POINT_OPEN_TOKEN)), numbers, F.array(F.lit(C.POINT_CLOSE_TOKEN)))
        box = F.concat(F.array(F.lit(C.BOX_OPEN_TOKEN)), numbers, F.array(F.lit(C.BOX_CLOSE_TOKEN)))
        return F.when(count == 2, point).when(count == 4, box).otherwise(otherwise)

    return let(F.split(location, ","), scaled)


def tokenize_tagged(text: Column, scale: Column | float) -> Column:
    """Tagged text as ids: plain pieces tokenised with BOS each, locations as scaled coordinates."""
    segments = segment_tags(tags_to_tokens(text))
    return F.flatten(
        F.transform(
            segments,
            lambda s: F.when(s["is_location"], F.transform(scale_tags(s["text"], scale), token_id)).otherwise(
                tokenize(s["text"])
            ),
        )
    ).cast(IDS)


def _restore(tokens: Column, n: int, opening: str, closing: str, tags: tuple[str, str], scale: Column) -> Column:
    """Replace every well-formed ``open, n numbers, close`` span by one string; all else stays as it is.

    The starts are found in one pass, then the array is cut around them; a row without an opening token is
    returned as it came.
    """

    def number(x: Column, i: Column) -> Column:
        return F.get(x, i).try_cast("double")

    def starts(x: Column, i: Column) -> Column:
        here = (F.get(x, i) == opening) & (F.get(x, i + n + 1) == closing)
        for k in range(1, n + 1):
            here = here & number(x, i + k).isNotNull()
        return F.coalesce(here, F.lit(False))

    def text(v: Column, i: Column) -> Column:
        values = [((number(v["x"], i + k) / v["scale"]).cast("bigint") * 2).cast("string") for k in range(1, n + 1)]
        return F.concat(F.lit(f" {tags[0]}"), F.concat_ws(", ", *values), F.lit(tags[1]))

    def rewritten(v: Column) -> Column:
        def piece(at: Column, j: Column) -> Column:
            behind = F.coalesce(F.when(j > 0, F.get(v["at"], j - 1) + (n + 2)), F.lit(0))
            return F.concat(
                let(behind, lambda b: F.slice(v["x"], b + 1, at - b)),
                F.array(text(v, at)),
            )

        tail = F.element_at(v["at"], -1) + (n + 2)
        cut = F.concat(F.flatten(F.transform(v["at"], piece)), F.slice(v["x"], tail + 1, F.size(v["x"])))
        return F.when(F.size(v["at"]) == 0, v["x"]).otherwise(cut)

    def located(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: starts(x, i))
        return let_all({"x": x, "at": at, "scale": scale}, rewritten)

    return let(tokens, lambda x: F.when(F.array_contains(x, opening), located(x)).otherwise(x))


def restore_boxes(tokens: Column, height: Column, width: Column, th: Column, tw: Column) -> Column:
    scale = fit_scale(height, width, th, tw)
    return _restore(tokens, 4, C.BOX_OPEN_TOKEN, C.BOX_CLOSE_TOKEN, (C.BOX_OPEN_TAG, C.BOX_CLOSE_TAG), scale)


def restore_points(tokens: Column, height: Column, width: Column, th: Column, tw: Column) -> Column:
    scale = fit_scale(height, width, th, tw)
    return _restore(tokens, 2, C.POINT_OPEN_TOKEN, C.POINT_CLOSE_TOKEN, (C.POINT_OPEN_TAG, C.POINT_CLOSE_TAG), scale)
