"""BPE encoding and decoding as streaming machines that keep a bounded buffer.

The merge list fixes how far to the right of a token a change can still come from (``lookahead``): a token (u, v) can
be undone only by an earlier rule (v, w), whose w lies to the right and must itself be formed, which later text may in
turn prevent by a still earlier rule, and so on. Chains only go to earlier rules, so one pass over the list gives the
longest. The encoder merges its buffer and emits every token that ends at least that far from the buffer's end; a
token edge that no merge crosses splits the work, so the rest of the buffer goes on as if the text began there. The
decoder turns tokens back into text and holds back no more than an unfinished character.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from pixelquilt.llm.encoding import LONGEST_REMEMBERED, REMEMBERED, WINDOW, Memory, load_tokenizer, segments, windows


#: Symbols up to which a scan over all pairs finds the next rule, and the rank of a pair without one.
SCANNED, NEVER = 32, 1 << 60


def byte_letters() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the
    other bytes follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Merges:
    """A vocabulary and its merge list, with symbols as ids."""

    def __init__(self, vocabulary: dict[str, int], merges: list, word_end: str = ""):
        self.id_of, self.word_end = vocabulary, word_end
        self.text_of = {i: t for t, i in vocabulary.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        for order, (left, right) in enumerate(pairs):
            self.rank[vocabulary[left], vocabulary[right]] = (order, vocabulary[left + right])
        self.order = {pair: order for pair, (order, _) in self.rank.items()}
        self.made = {order: made for order, made in self.rank.values()}
        self.lookahead = self._lookahead(pairs)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Symbols to the right of a token that can still undo it, at most."""
        length = lambda t: len(t.removesuffix(self.word_end)) if self.word_end else len(t)
        forming: dict[str, int] = {}
        undoing: dict[str, int] = {}
        longest = 1
        for left, right in pairs:
            undone = undoing.get(right, 0)
            made = left + right
            forming[made] = max(forming.get(made, 0), forming.get(right, 0), undone)
            undoing[left] = max(undoing.get(left, 0), length(right) + max(forming.get(right, 0), undone))
            longest = max(longest, length(made))
        return longest + max([0, *forming.values(), *undoing.values()])

    def _scan(self, ids: list[int]) -> list[int]:
        """``merge`` for few symbols: looking through all ranks costs less than a heap of them."""
        order, made = self.order.get, self.made
        ranks = [order(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            ids[i : i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = order((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = order((ids[i], ids[i + 1]), NEVER)
        return ids

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the rules by rank, leftmost first, to symbols that lie together."""
        n = len(symbols)
        if n <= SCANNED:
            return self._scan(list(symbols))
        rank, ids = self.rank, list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(found[0], i, found[1], ids[i], ids[i + 1]) for i in range(n - 1) if (found := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(waiting)
        while waiting:
            _, i, made, left, right = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if found := rank.get((made, ids[after[i]])):
                    heapq.heappush(waiting, (found[0], i, found[1], made, ids[after[i]]))
            if (k := before[i]) >= 0 and (found := rank.get((ids[k], made))):
                heapq.heappush(waiting, (found[0], k, found[1], ids[k], made))
        return [i for i in ids if i >= 0]


class Transducer:
    """Encodes the symbols of one word as they come and gives ids once later symbols cannot change them. After ``end``
    it is ready for the next word."""

    def __init__(self, merges: Merges):
        self.merges, self.buffer = merges, []
        self.of_byte = [merges.id_of[c] for c in byte_letters()].__getitem__
        self.last = {merges.id_of[c]: merges.id_of[c + merges.word_end] for c in byte_letters()}
        self.room = 4 * merges.lookahead

    def feed(self, data: bytes) -> list[int]:
        """``data``: the next bytes of the word, of which at least one more must follow or ``end`` be called."""
        found = []
        for at in range(0, len(data), self.room):
            self.buffer.extend(map(self.of_byte, data[at : at + self.room]))
            # The last symbol may turn out to be the word's end, which is another symbol.
            if len(self.buffer) > self.room:
                found += self._stable()
        return found

    def _stable(self) -> list[int]:
        limit, used, found = len(self.buffer) - 1 - self.merges.lookahead, 0, []
        for token in self.merges.merge(self.buffer[:-1]):
            size = len(self.merges.text_of[token])
            if used + size > limit:
                break
            used += size
            found.append(token)
        del self.buffer[:used]
        return found

    def end(self) -> list[int]:
        symbols, self.buffer = self.buffer, []
        if symbols:
            symbols[-1] = self.last[symbols[-1]]
        return self.merges.merge(symbols)


#: A word of its own that stands between parts; parts that hold it are split alone.
_BETWEEN = "\x01"


class BpeEncoder:
    """A word-level BPE vocabulary file as a chain of small machines: segments, special strings, words, merges.

    Where words begin and end, and which letters are small ones, is up to the library's own normalizer and splitter, whose
    character tables are of another Unicode version than Python's. Plain ASCII is split here, by the file's pattern.
    """

    _made: dict[str, "BpeEncoder"] = {}

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a lower-casing word vocabulary")
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.machine = Transducer(self.merges)
        self.library = load_tokenizer(path)
        self.words = re.compile(_ascii_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), re.ASCII)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.token_of = {**self.merges.text_of, **{i: s for s, i in self.special.items()}}
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.letter_between = byte_letters()[ord(_BETWEEN)]
        self.marks = {s[:2] for s in self.special}
        self.word_ids = lru_cache(REMEMBERED)(lambda word: b"".join(self._word(word)))
        self.memory = Memory(self._segments)

    @classmethod
    def of(cls, name: str) -> "BpeEncoder":
        """One for each worker process; ``name`` is a path or a public vocabulary's file name."""
        if name not in cls._made:
            import public_tokenizers

            cls._made[name] = cls(name if os.sep in name else public_tokenizers.path(name))
        return cls._made[name]

    def _word(self, word: bytes) -> Iterator[bytes]:
        """The machine's ids of one word, as it emits them."""
        machine = self.machine
        for at in range(0, len(word), machine.room):
            if found := machine.feed(word[at : at + machine.room]):
                yield array("I", found).tobytes()
        yield array("I", machine.end()).tobytes()

    def _split(self, part: str) -> list[bytes]:
        if part.isascii():
            return [w.encode() for w in self.words.findall(part.lower())]
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(map(self.byte_of.__getitem__, letters)) for letters, _ in found]

    def _split_together(self, parts: list[str]) -> list[list[bytes]]:
        """The library's words of many parts by one call, told apart by a word between them that no part holds."""
        if not parts:
            return []
        text, groups, between = f" {_BETWEEN} ".join(parts), [[]], self.letter_between
        for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            if letters == between:
                groups.append([])
            else:
                groups[-1].append(bytes(map(self.byte_of.__getitem__, letters)))
        return groups

    def _segments(self, unknown: list[str]) -> list[bytes]:
        together = [s for s in unknown if not s.isascii() and len(s) <= LONGEST_REMEMBERED and _BETWEEN not in s and not any(m in s for m in self.marks)]
        words = dict(zip(together, self._split_together(together), strict=True))
        return [b"".join(map(self.word_ids, words[s])) if s in words else b"".join(self._segment(s)) for s in unknown]

    def _segment(self, segment: str) -> Iterator[bytes]:
        for part in self.cut.split(segment) if any(m in segment for m in self.marks) else (segment,):
            if part in self.special:
                yield np.array([self.special[part]], dtype="<u4").tobytes()
            elif part:
                words = self._split(part)
                if len(part) > LONGEST_REMEMBERED:
                    for word in words:
                        yield from self._word(word)
                else:
                    yield from map(self.word_ids, words)

    def stream(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit bytes, window by window, and piece by piece in words that outlast one."""
        for window in windows(text or ""):
            if len(window) > 2 * WINDOW:
                for segment in segments(window):
                    yield from self._segment(segment)
            else:
                yield b"".join(self.memory.of(segments(window)))


def _ascii_pattern(pattern: str) -> str:
    """The word pattern for plain ASCII text, where letters and digits are these."""
    return pattern.replace(r"[\p{L}]", "[A-Za-z]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]")


class BpeDecoder:
    """Ids to text, piece by piece. ``byte_level``: tokens stand for bytes, of which an unfinished character waits for
    the rest; otherwise tokens are shown as the vocabulary has them, with a blank between."""

    def __init__(self, token_of: dict[int, str], byte_level: bool = False, special: Iterable[int] = ()):
        self.token_of, self.byte_level, self.begun = token_of, byte_level, False
        self.special = frozenset(special)
        if byte_level:
            self.byte_of = {c: b for b, c in enumerate(byte_letters())}
            self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if not self.byte_level:
            text = " ".join(map(self.token_of.__getitem__, ids))
            text, self.begun = (" " + text if self.begun else text), True
            return text
        data = b"".join(self.token_of[i].encode() if i in self.special else bytes(map(self.byte_of.__getitem__, self.token_of[i])) for i in ids)
        return self.state.decode(data)

    def end(self) -> str:
        return self.state.decode(b"", final=True) if self.byte_level else ""


