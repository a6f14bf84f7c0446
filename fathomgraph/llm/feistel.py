"""Keyed permutations of numbers and letters within their format."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable


def _round(key: bytes, i: int, size: int, half: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{i}:{size}:{half}".encode(), key=key, digest_size=16).digest(), "big")


def permute(value: int, size: int, key: bytes, rounds: int = 8) -> int:
    """A keyed permutation of range(size): an alternating Feistel network over range(a) x range(b) with a * b >= size,
    walked until it lands inside again."""
    if size <= 1:
        return value
    a = max(2, int(size**0.5))
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for i in range(rounds):
            if i % 2 == 0:
                left = (left + _round(key, i, size, right)) % a
            else:
                right = (right + _round(key, i, size, left)) % b
        value = left * b + right
        if value < size:
            return value


def pseudonym(text: str, key: bytes, keep: int = 0, valid: Callable[[str], bool] | None = None) -> str:
    """text with its digits, and its capital letters, permuted as two numbers; everything else stays.

    The first `keep` digits stay as they are. Equal digits and letters give equal pseudonyms, however they are spaced. Where all
    digits of text are valid, so are those of the pseudonym: the permutation walks on until they are, which keeps it one to one.
    """
    for chars, digits in (("[0-9]", "0123456789"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        every = [m.start() for m in re.finditer(chars, text)]
        at = every[keep if digits[0] == "0" else 0 :]
        base, number = len(digits), 0
        for i in at:
            number = number * base + digits.index(text[i])
        walks = digits[0] == "0" and valid is not None and valid("".join(text[i] for i in every))
        while True:
            number = permute(number, base ** len(at), key)
            out, left = list(text), number
            for i in reversed(at):
                left, d = divmod(left, base)
                out[i] = digits[d]
            if not walks or valid("".join(out[i] for i in every)):
                break
        text = "".join(out)
    return text
