"""Encoding whole texts with a public tokenizer, one remembered segment at a time.

A segment is a run of white space and the text after it up to the next white space. No token of the supported
tokenizers crosses from text into white space, so segments encode on their own exactly as they do in place, and a
long text may be cut at any of their boundaries. Whole columns of texts are cut by the byte and each different segment
is looked up once; there a mark of punctuation after a letter begins a segment too, as it begins a word of its own in
the patterns of the supported tokenizers and stands in none of their special strings.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Unicode's white space, as the tokenizers' patterns see it.
GAP = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENT = re.compile(f"[{GAP}]*[^{GAP}]+|[{GAP}]+$")
_BREAK = re.compile(f"[^{GAP}][{GAP}]")

#: Results that a worker remembers in each of two generations, and the longest key it does (in characters).
REMEMBERED = 250_000
LONGEST_REMEMBERED = 64
#: Characters of a long text that are encoded at a time.
WINDOW = 1 << 18
#: Bytes of texts whose different segments are looked up at a time.
BLOCK_BYTES = 1 << 23
#: Segments that the library encodes as one batch, whose encodings are held together.
BATCH_SEGMENTS = 1 << 12


_UNUSUAL = re.compile(f"[{GAP.replace(' ', '', 1)}]".replace("\t-\r", "\t\x0b-\r"))
_RUNS = ("  ", "\n\n", " \n", "\n ", "\0")


def segments(text: str) -> list[str]:
    """The segments of a text. Texts whose gaps are single blanks and line ends are split without the pattern."""
    if text[-1:] in " \n" or _UNUSUAL.search(text) or any(run in text for run in _RUNS):
        return SEGMENT.findall(text)
    found = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return found if found[0] else found[1:]


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """Cut a long text where a segment ends; pieces have about ``size`` characters, a longer segment stays whole."""
    at, end = 0, len(text)
    while end - at > size:
        found = _BREAK.search(text, at + size)
        if not found:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 1
    if at < end:
        yield text[at:]


def _marks(bytes_: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(bytes_)] = True
    return found


_BLANK = _marks(b"\t\n\x0b\x0c\r ")
_LETTER = _marks(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_PUNCTUATION = _marks(b".,;:!?")
#: The white space of two and three bytes in UTF-8.
_WIDE = [[int.from_bytes(c.encode(), "big") for c in map(chr, range(0x80, 0x3001)) if c.isspace() and len(c.encode()) == n] for n in (2, 3)]


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the segments of texts begin and end that lie one after the other in UTF-8, ``bounds`` included: before
    ASCII white space that follows other than white space, and before punctuation that follows a letter."""
    at = np.zeros(len(data) + 1, bool)
    blank = _BLANK[data]
    at[1:-1] = (blank[1:] & ~blank[:-1]) | (_PUNCTUATION[data[1:]] & _LETTER[data[:-1]])
    wide = np.flatnonzero(at[1:-1] & (data[:-1] > 0x7F)) + 1
    if len(wide):
        last = [data[np.maximum(wide - i, 0)].astype(np.int64) for i in (1, 2, 3)]
        two = last[1] << 8 | last[0]
        at[wide[np.isin(two, _WIDE[0]) | np.isin(last[2] << 16 | two, _WIDE[1])]] = False
    at[bounds] = True
    return np.flatnonzero(at)


def load_tokenizer(name: str):
    """The library's tokenizer for a vocabulary file, without truncation and padding. Tasks load their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name) if os.sep not in name else name)
    found.no_truncation()
    found.no_padding()
    return found


class Memory:
    """Remembered results by key, in two generations: what was not asked for while one filled up is forgotten.
    ``make`` gets the unknown keys of a call as one batch."""

    def __init__(self, make, size: int = REMEMBERED):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def of(self, keys: list) -> list:
        young, old = self.young, self.old
        missing = [k for k in set(keys) if k not in young]
        if missing:
            unknown = [k for k in missing if k not in old]
            young.update((k, old[k]) for k in missing if k in old)
            young.update(zip(unknown, self.make(unknown), strict=True))
        found = [young[k] for k in keys]
        for k in missing:
            if len(k) > LONGEST_REMEMBERED:
                del young[k]
        if len(young) > self.size:
            self.old, self.young = young, {}
        return found


def _packed(encoded) -> bytes:
    ids = array("I", encoded.ids)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, or their number."""

    _made: dict[tuple[str, bool, int], "Encoder"] = {}

    def __init__(self, name: str, lengths_only: bool = False, remembered: int = REMEMBERED):
        tokenizer, result = load_tokenizer(name), len if lengths_only else _packed
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        batches = lambda unknown: (unknown[at : at + BATCH_SEGMENTS] for at in range(0, len(unknown), BATCH_SEGMENTS))
        self.memory = Memory(lambda unknown: [result(e) for batch in batches(unknown) for e in encode(batch, add_special_tokens=False)], remembered)

    @classmethod
    def of(cls, name: str, lengths_only: bool = False, remembered: int = REMEMBERED) -> "Encoder":
        """One for each worker process."""
        made = (name, lengths_only, remembered)
        if made not in cls._made:
            cls._made[made] = cls(*made)
        return cls._made[made]

    def ids(self, text: str | None) -> bytes:
        return b"".join(b"".join(self.memory.of(segments(w))) for w in windows(text or ""))

    def column(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text of an Arrow column; a null text is an empty one."""
        if not len(texts):
            return []
        texts = texts.cast(pa.string()).fill_null("")
        _, offsets, raw = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset :][: len(texts) + 1]
        data, found = np.frombuffer(raw or b"", np.uint8), []
        while len(found) < len(texts):
            at = len(found)
            upto = int(np.searchsorted(bounds, int(bounds[at]) + BLOCK_BYTES, "right")) - 1
            if upto > at:
                found += self._block(data[bounds[at] : bounds[upto]], bounds[at : upto + 1] - bounds[at])
            else:
                found.append(self.ids(texts[at].as_py()))
        return found

    def _block(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        if not len(data):
            return [b""] * (len(bounds) - 1)
        at = cuts(data, bounds)
        coded = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        ids = pa.array(self.memory.of(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        _, offsets, raw = ids.buffers()
        ends = np.frombuffer(offsets, np.int32)[np.searchsorted(at, bounds)].tolist()
        view = memoryview(raw)
        return [bytes(view[a:b]) for a, b in zip(ends, ends[1:])]

    def count(self, text: str | None) -> int:
        return sum(sum(self.memory.of(segments(w))) for w in windows(text or ""))
