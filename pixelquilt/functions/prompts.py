"""Prompt text and image references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.functions.hashing import hash60

# What Python's str.strip removes.
_NOT_BLANK = "[^\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def header(role: Column | str) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.concat(F.lit(C.START_HEADER), role, F.lit(C.END_HEADER))


def message(role: Column | str, text: Column) -> Column:
    """One closed chat turn."""
    return F.concat(header(role), F.lit("\n\n"), text, F.lit(C.END_OF_TURN))


def caption_prompt(text: Column, key: Column, seed: int) -> Column:
    """A caption as a user instruction (drawn by ``(seed, key)``) and the assistant's answer."""
    choices = F.array(*[F.lit(line) for line in C.CAPTION_INSTRUCTIONS])
    pick = (hash60(F.lit(seed), key) % len(C.CAPTION_INSTRUCTIONS)).cast("int")
    return F.concat(message("user", F.get(choices, pick)), message("assistant", text))


def conversation_prompt(text: Column, conversations: Column, key: Column, seed: int) -> Column:
    """Caption rows are rendered; rows without a caption pass their chat through."""
    return F.when(text.isNotNull(), caption_prompt(text, key, seed)).otherwise(conversations)


def inference_prompt(text: Column, system: Column | str | None = None, newline: bool = False) -> Column:
    """A question ready for generation; a non-empty system prompt goes in front of it."""
    system = F.lit(system or "") if system is None or isinstance(system, str) else F.coalesce(system, F.lit(""))
    body = F.when(system != "", F.concat(system, F.lit(" "), text)).otherwise(text)
    closing = F.lit("\n\n" if newline else "")
    return F.concat(message("user", body), header("assistant"), closing)


def append_end(text: Column) -> Column:
    return F.concat(text, F.lit(C.END_OF_TEXT))


def strip_placeholders(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(C.IMAGE_PLACEHOLDER), F.lit("")), F.lit(C.IMAGE_NEWLINE), F.lit(""))


def truncate_middle(text: Column, start: int = 10, end: int = 10, to: str = "...") -> Column:
    """Keep both ends of a string that is longer than the ends and the filler together."""
    # A zero-length tail keeps the whole string, as a slice from -0 does.
    tail = F.right(text, F.lit(end)) if end else text
    cut = F.concat(F.substring(text, 1, start), F.lit(to), tail)
    return F.when(F.length(text) > start + end + len(to), cut).otherwise(text)


def has_image(url: Column) -> Column:
    """True for a reference that is present and not blank; never null."""
    return F.coalesce(url.rlike(_NOT_BLANK), F.lit(False))


def resolve_image_ref(url: Column, image_dir: str) -> Column:
    """Null for no image; absolute paths unchanged; anything else below ``image_dir``."""
    base = image_dir if image_dir == "" or image_dir.endswith("/") else image_dir + "/"
    rooted = url.startswith(C.ROOTED_IMAGE_PREFIX) | url.startswith("/")
    return F.when(has_image(url), F.when(rooted, url).otherwise(F.concat(F.lit(base), url)))
