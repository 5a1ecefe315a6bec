"""Viterbi decoding of disguised words under a character model.

A token is a lattice: each run of one character stands for one or two copies of a letter, digits
and signs stand for the letters they look like, separators stand for nothing or for a space. The
most probable path under a character trigram model is the restored text.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np

#: Symbols of the character model: a space, the letters a to z, and the letters from U+00DF to U+00FF.
LETTERS = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(0xDF, 0x100))]
SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)}
SIZE = len(LETTERS) + 1
# The letters that digits and signs stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c",
}
SUBSTITUTED, DROPPED, COLLAPSED, SPACED, JOINED = -1.0, -6.0, -0.7, -1.0, -0.2
#: Signs that look like letters which a token without letters needs to be decoded at all.
LEAST_SIGNS = 3
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#%&~`^=-_/\\"
_SEPARATED = re.compile(r"[^\W_](?:[ .\-_*·][^\W_])+")
SPACED_OUT = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*·][^\W_]){2,}(?![^\W_])")
_RUN = re.compile(r"([^\W\d_])\1\1")
_DOUBLE = re.compile(r"([^\W\d_])\1+")
_LETTERS = re.compile(r"[^\W\d_]+")
_LOOK = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of (symbol, symbol, symbol) as a flat array; anything but a letter counts as space."""
    codes = np.frombuffer(" ".join(["", *texts, ""]).lower().encode("utf-32-le", "replace"), np.uint32)
    table = np.zeros(0x100, np.int64)
    for c, i in SYMBOL.items():
        table[ord(c)] = i
    symbols = np.where(codes < 0x100, table[np.minimum(codes, 0xFF)], 0)
    # Runs of spaces are one.
    symbols = symbols[(symbols > 0) | (np.concatenate([[1], symbols[:-1]]) > 0)]
    if len(symbols) < 3:
        return np.zeros(SIZE ** 3, np.int64)
    return np.bincount((symbols[:-2] * SIZE + symbols[1:-1]) * SIZE + symbols[2:], minlength=SIZE ** 3)


def log_model(counts: np.ndarray, words: list[str], share: float = 0.3) -> list[float]:
    """Log probabilities of a symbol after two, from the corpus and, with ``share``, from ``words``."""
    def conditional(c: np.ndarray) -> np.ndarray:
        c = c.reshape(SIZE, SIZE, SIZE).astype(float)
        pair = c.sum(0) + 0.1  # the same symbol after one
        pair /= pair.sum(1, keepdims=True)
        return (c + 2.0 * pair[None]) / (c.sum(2, keepdims=True) + 2.0)

    own = conditional(trigram_counts(words))
    return np.log((1 - share) * conditional(counts) + share * own).ravel().tolist()


def viterbi(token: str, model: list[float]) -> str:
    """The most probable text behind a lower-case token, words apart by one space."""
    # State: the last two symbols; value: log probability and text so far.
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for char, run in groupby(token):
        n = len(list(run))
        if char in SYMBOL:
            options = [(char, 0.0 if n == 1 else COLLAPSED)]
            if n > 1:
                options.append((char * 2, 0.0 if n == 2 else COLLAPSED))
        elif char in LOOKALIKES:
            options = [("", DROPPED)]
            for letter in LOOKALIKES[char]:
                options.append((letter, SUBSTITUTED + (COLLAPSED if n > 1 else 0.0)))
                if n > 1:
                    options.append((letter * 2, 2 * SUBSTITUTED))
        else:
            options = [("", JOINED), (" ", SPACED)]
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for letters, cost in options:
                x, y, total = a, b, score + cost
                for c in letters:
                    z = SYMBOL.get(c, 0)
                    if z or y:
                        total += model[(x * SIZE + y) * SIZE + z]
                        x, y = y, z
                if (x, y) not in after or after[x, y][0] < total:
                    after[x, y] = (total, text + letters)
        states = after
    best = max(states.items(), key=lambda s: (s[1][0] + model[(s[0][0] * SIZE + s[0][1]) * SIZE], s[1][1]))
    return best[1][1]


def restored(token: str, model: list[float], known: frozenset[str]) -> list[str]:
    """Words of a lower-case token without spaces; only disguised parts are decoded.

    A doubled letter is decoded where the word with single letters is one of ``known``. A token without
    any letter, mostly a number, counts as a word only if it decodes to one of ``known``.
    """
    word = token.strip(PUNCTUATION)
    if word.isalpha():
        if _RUN.search(word) or (_DOUBLE.search(word) and _DOUBLE.sub(r"\1", word) in known):
            return viterbi(word, model).split()
        return [word]
    if not any(c.isalpha() for c in token):
        if len(_LOOK.findall(token)) < LEAST_SIGNS:
            return []
        return [w for w in viterbi(token, model).split() if w in known]
    if _SEPARATED.fullmatch(word):
        return viterbi(word, model).split()
    if _LOOK.search(word):
        whole = token.lstrip(PUNCTUATION.translate({ord(c): None for c in LOOKALIKES}))
        return viterbi(word if word[0] == whole[0] else whole, model).split()
    return _LETTERS.findall(word)


