"""Text in the form that terms are matched in: letters only, with disguises undone.

Every character is folded by itself (compatibility form, no combining marks, lower case). Runs of letters
and digits are taken together; a run without any letter is dropped. In a run, digits stand for letters,
Latin stretches are transliterated to Cyrillic unless they are look-alikes throughout, and each output
letter is replaced by its visual prototype. Every output letter knows the source character that it came
from, so a match can be checked against the words of the source and mapped back to it.

The prototypes are a small part of Unicode's confusables. What matters is that terms and texts go
through the same function.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

# Digits read as letters.
LEET = {"0": "o", "1": "i", "3": "з", "4": "ч", "6": "б", "7": "т", "8": "в"}
# Latin letters that look like Cyrillic ones.
LOOKALIKE = frozenset("aceopxy")
# Transliteration, groups of letters first and in this order.
GROUPS = {
    "shch": "щ", "sch": "щ", "zh": "ж", "kh": "х", "ch": "ч", "sh": "ш", "ts": "ц", "yu": "ю", "ya": "я", "yo": "ё", "ye": "е",
    "iy": "ий", "ay": "ай", "oy": "ой", "ey": "ей",
}
LETTERS = {
    "a": "а", "b": "б", "c": "ц", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "ж", "k": "к", "l": "л", "m": "м",
    "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс", "y": "ы", "z": "з",
}
# Visual prototypes (Cyrillic and Greek letters that look Latin).
PROTOTYPES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
}
# Blocks of combining marks.
COMBINING = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20F0), (0xFE20, 0xFE2F))

_TRANSLIT = re.compile("|".join([*GROUPS, *LETTERS]))
_TO = GROUPS | LETTERS
_RUNS = re.compile(r"[a-z]+|[^a-z]+")


def is_combining(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in COMBINING)


@lru_cache(maxsize=65_536)
def folded(c: str) -> str:
    """One character in compatibility form, without combining marks, in lower case."""
    return "".join(x.lower() for x in unicodedata.normalize("NFKC", c) if not is_combining(x))


@lru_cache(maxsize=65_536)
def prototype(c: str) -> str:
    return "".join(PROTOTYPES.get(x, x) for x in unicodedata.normalize("NFD", c))


def transliterated(latin: str) -> str:
    return _TRANSLIT.sub(lambda m: _TO[m[0]], latin)


def is_alphanumeric(c: str) -> bool:
    """Letters and numbers, and the combining letters that Unicode counts as alphabetic."""
    return c.isalpha() or unicodedata.category(c)[0] == "N"


@dataclass
class Normalized:
    text: str
    #: For each letter of ``text``, its source character's place.
    source: list[int]
    #: Whether a word starts at a source character.
    starts: list[bool]
    #: The length of the white-space word around a source character; 0 for white space.
    word_length: list[int] = field(default_factory=list)

    def starts_word(self, at: int) -> bool:
        return at < len(self.source) and self.source[at] < len(self.starts) and self.starts[self.source[at]]

    def one_word(self, start: int, end: int) -> bool:
        """Whether a one-word term may lie there: it crosses no white space, or only letter-spaced words."""
        if end <= start or end > len(self.source):
            return False
        lengths = self.word_length[self.source[start] : self.source[end - 1] + 1]
        return 0 not in lengths or all(n <= 1 for n in lengths)

    def surface(self, start: int, end: int) -> tuple[int, int]:
        return self.source[start], self.source[end - 1] + 1


def normalize(raw: str) -> Normalized:
    solid = [is_alphanumeric(c) for c in raw]
    starts = [s and not (k and solid[k - 1]) for k, s in enumerate(solid)]
    lengths = [0] * len(raw)
    for m in re.finditer(r"\S+", raw):
        lengths[m.start() : m.end()] = [min(m.end() - m.start(), 0xFFFF)] * (m.end() - m.start())
    out: list[str] = []
    source: list[int] = []

    def put(c: str, at: int) -> None:
        for x in prototype(c):
            out.append(x)
            source.append(at)

    def close(run: list[tuple[str, int]]) -> None:
        if not any(c.isalpha() for c, _ in run):
            return
        letters = "".join(LEET.get(c, c) for c, _ in run)
        for stretch in _RUNS.finditer(letters):
            a, segment = stretch.start(), stretch[0]
            if "a" <= segment[0] <= "z" and not LOOKALIKE.issuperset(segment):
                into = transliterated(segment)
                for k, c in enumerate(into):  # places are spread in proportion
                    put(c, run[a + k * len(segment) // len(into)][1])
            else:
                for k, c in enumerate(segment):
                    if c.isalpha():
                        put(c, run[a + k][1])

    run: list[tuple[str, int]] = []
    for at, c in enumerate(raw):
        for x in folded(c):
            if is_alphanumeric(x):
                run.append((x, at))
            elif run:
                close(run)
                run = []
    close(run)
    return Normalized("".join(out), source, starts, lengths)
