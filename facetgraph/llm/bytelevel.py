"""Cutting texts where a byte-level tokenizer's tokens can't cross.

The pre-tokenizer of byte-level BPE starts a token at each single blank that
stands between two characters that aren't white space, and makes each single line
feed between such characters a token of its own; what follows doesn't depend on what
stood before. So a text may be cut there, and each piece be tokenized alone, with the
same tokens. Pieces repeat, whole texts don't: the result by piece is kept in a table
of bounded size, which changes speed only.
"""

from __future__ import annotations

import re

#: White space as Unicode has it (fixed values); Python's \s has four control characters more.
SPACE = r"\t-\r \x85\xa0  -     　"
CUT = re.compile(f"(?<![{SPACE}])(?: (?![{SPACE}])|(?=\n[^{SPACE}]))")
#: What keeps a text from being cut by blanks and line feeds alone: two in a row, or white space of another kind.
PAIRS = ("  ", " \n", "\n ", "\n\n")
OTHERS = "\t\x0b\x0c\r\x85\xa0                　"
#: The pre-tokenizer's pattern (a fixed value), with white space spelled out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    f"| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def plain(text: str) -> bool:
    """Whether all white space of a text is single blanks and line feeds: then none is inside its pieces."""
    return not (any(p in text for p in PAIRS) or any(c in text for c in OTHERS))


def pieces(text: str) -> list[str]:
    """The text in pieces. All but the first start with a line feed or, if they don't, with a blank that isn't shown."""
    return text.replace("\n", " \n").split(" ") if plain(text) else CUT.split(text)


def spelled(piece: str) -> str:
    """A piece that isn't its text's first, with the blank that it starts with."""
    return piece if piece.startswith("\n") else " " + piece
