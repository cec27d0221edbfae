"""Tokenizers of the text models: word-end byte pairs with a fixed length, and word pieces."""

from __future__ import annotations

import re

#: Fixed ids of the image-text model's tokenizer.
BEGIN, END, PAD, LENGTH = 49406, 49407, 0, 77
#: What the same tokenizer takes for words (a fixed value).
WORDS = re.compile(r"[a-z0-9]+|[^a-z0-9\s]+")


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair merging: the leftmost pair of the lowest rank first."""
    while len(symbols) > 1:
        rank, at = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
        if rank == 1 << 60:
            break
        symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
    return symbols


def encode_words(text: str, vocabulary: dict[str, int], ranks: dict[tuple[str, str], int], length: int = LENGTH) -> list[int]:
    """Ids between BEGIN and END, padded to length; unknown pieces are left out."""
    ids = [BEGIN]
    for word in WORDS.findall(text.lower()):
        pieces = merge([*word[:-1], word[-1] + "</w>"], ranks)
        ids += [vocabulary[p] for p in pieces if p in vocabulary]
    ids = [*ids[: length - 1], END]
    return ids + [PAD] * (length - len(ids))


def basic_words(text: str) -> list[str]:
    """Words and single punctuation marks of a lowered text."""
    return re.findall(r"[^\W_]+|[^\w\s]|_", text.lower(), re.ASCII)


def word_pieces(word: str, vocabulary: dict[str, int], unknown: str = "[UNK]") -> list[str]:
    """The longest known start, then the longest known continuations; what is found before an unknown rest stays."""
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = word[at:end] if at == 0 else "##" + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            out.append(unknown)
            break
    return out


def encode_pieces(text: str, vocabulary: dict[str, int], length: int = 32) -> dict[str, list[int]]:
    """ids, mask and word_ids (-1 outside words) of a query, cut to length with the end mark kept."""
    tokens, word_ids = ["[CLS]"], [-1]
    for i, word in enumerate(basic_words(text)):
        pieces = word_pieces(word, vocabulary)
        tokens += pieces
        word_ids += [i] * len(pieces)
    tokens, word_ids = [*tokens[: length - 1], "[SEP]"], [*word_ids[: length - 1], -1]
    spare = length - len(tokens)
    ids = [vocabulary.get(t, vocabulary.get("[UNK]", 0)) for t in tokens]
    return {"ids": ids + [vocabulary.get("[PAD]", 0)] * spare, "mask": [1] * len(ids) + [0] * spare, "word_ids": word_ids + [-1] * spare}
