"""Cutting texts by a tokenizer's pattern with the letter and number classes of that tokenizer's library.

Libraries know different versions of Unicode. Where a library and ``regex`` disagree on a code point, a stand-in of the
library's class takes its place while the pattern is matched; pieces are cut from the text itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import regex

NEWER = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
"""Everything but Latin letters and common punctuation, on which all versions of Unicode agree."""
STAND_INS = {"L": "ɐ", "N": "²", "": ""}


def code_points() -> Iterator[str]:
    return (chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def tiktoken_class(ids: dict[bytes, int]) -> Callable[[str], set[str]]:
    """Members of a character class as tiktoken has them."""
    import tiktoken

    def members(name: str) -> set[str]:
        only = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=ids, special_tokens={})
        return set(only.decode(only.encode_ordinary(" ".join(code_points()))))

    return members


def tokenizers_class(name: str) -> set[str]:
    """Members of a character class as the tokenizers library has them."""
    from tokenizers import Regex, pre_tokenizers

    rest = pre_tokenizers.Split(Regex(name), "removed").pre_tokenize_str(" ".join(code_points()))
    return set(code_points()) - set("".join(part for part, _ in rest)) - {" "}


def latin(pattern: str) -> str | None:
    """The pattern for texts of Latin-1 in the syntax of ``re``, which is faster; None if it has other classes."""
    chars = list(map(chr, range(256)))
    members = {k: "".join(re.escape(c) for c in chars if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, at = [], False, 0
    while at < len(pattern):
        found = next((k for k in members if pattern.startswith(k, at)), None)
        if found:
            out.append(members[found] if inside else f"[{members[found]}]")
            at += len(found)
        elif pattern.startswith(r"\S", at) and not inside:
            out.append(f"[^{members[chr(92) + 's']}]")
            at += 2
        elif pattern[at] == "\\":
            return None
        else:
            inside = (inside or pattern[at] == "[") and pattern[at] != "]"
            out.append(pattern[at])
            at += 1
    return "".join(out)


class Splitter:
    """Pieces of a text. ``members`` gives a class of the library; it is asked only when a text leaves Latin script."""

    def __init__(self, pattern: str, members: Callable[[str], set[str]]) -> None:
        self.pattern, self.members = regex.compile(pattern), members
        latin_1 = latin(pattern)
        self.latin = re.compile(latin_1) if latin_1 is not None else self.pattern
        self._stand_ins: dict[int, str] | None = None

    def _odd(self) -> dict[int, str]:
        if self._stand_ins is None:
            found = {}
            classes = {k: self.members(rf"\p{{{k}}}") for k in ("L", "N")}
            own = {k: regex.compile(rf"\p{{{k}}}").match for k in ("L", "N")}
            for char in code_points():
                theirs = next((k for k in classes if char in classes[k]), "")
                if theirs != next((k for k in own if own[k](char)), ""):
                    found[ord(char)] = STAND_INS[theirs]
            self._stand_ins = found
            self._find = re.compile(f"[{''.join(map(re.escape, map(chr, found)))}]" if found else r"(?!)")
        return self._stand_ins

    def _stood_in(self, text: str) -> str:
        if NEWER.search(text):
            odd = self._odd()
            if self._find.search(text):
                return text.translate(odd)
        return text

    def pieces(self, text: str) -> list[str]:
        if is_latin(text):
            return self.latin.findall(text)
        same = self._stood_in(text)
        if same is text:
            return self.pattern.findall(text)
        return [text[slice(*m.span())] for m in self.pattern.finditer(same)]

    def stream(self, text: str) -> Iterator[str]:
        if is_latin(text):
            return (m.group() for m in self.latin.finditer(text))
        same = self._stood_in(text)
        return (text[slice(*m.span())] for m in self.pattern.finditer(same))


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
