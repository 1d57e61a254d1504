"""Splitting of texts, shared by the operators of this package."""

from __future__ import annotations

import re
from itertools import islice

#: Words before whose full stop no sentence ends.
ABBREVIATIONS = ("rs", "no", "mr", "mrs", "ms", "dr", "smt", "sri", "shri", "st", "vs", "nos", "viz", "etc", "approx", "ref", "govt", "ltd", "pvt")
_END = re.compile(r"[.!?।॥]+[\"'”’)\]]*(?=\s|$)")
_TAIL = re.compile(r"(\w+)\.?$", re.UNICODE)
_LETTERS = re.compile(r"[^\W\d_](?:[^\W\d_]|[ऀ-෿])+", re.UNICODE)


def sentences(text: str | None, words: int = 3) -> list[tuple[int, int]]:
    """(start, end) of the whole sentences of a text: what ends with a terminal mark and holds at least `words` words.

    A full stop ends nothing after an abbreviation or a single letter. An empty line ends a passage without terminal
    mark, which then is no whole sentence (headings, table rows, greetings, closing words).
    """
    if not text:
        return []
    out, start = [], 0
    for m in _END.finditer(text):
        if m[0] == ".":
            before = _TAIL.search(text[max(0, m.start() - 14) : m.start()])
            if before and (before[1].lower() in ABBREVIATIONS or (len(before[1]) == 1 and before[1].isalpha() and before[1].isupper())):
                continue
        a, b = start, m.end()
        start = b
        cut = text.rfind("\n\n", a, b)
        if cut >= 0:
            a = cut
        while a < b and text[a].isspace():
            a += 1
        if sum(1 for _ in islice(_LETTERS.finditer(text, a, b), words)) == words:
            out.append((a, b))
    return out
