"""String comparison shared by the operators of this package."""

from __future__ import annotations

import unicodedata
from functools import lru_cache


def plain(text: str) -> str:
    """Lower case without combining marks."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with the bonus for up to four common first letters."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    used = bytearray(lb)
    left = []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), i + reach + 1)
        while j >= 0 and used[j]:
            j = b.find(c, j + 1, i + reach + 1)
        if j >= 0:
            used[j] = 1
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(lb) if used[j]]
    t = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / la + m / lb + (m - t) / m) / 3
    p = 0
    while p < min(4, la, lb) and a[p] == b[p]:
        p += 1
    return jaro + 0.1 * p * (1 - jaro)


@lru_cache(maxsize=1 << 18)
def letters(a: str) -> int:
    """Bit set of the characters of a string; one edit changes at most two of its bits."""
    out = 0
    for c in a:
        out |= 1 << (ord(c) & 63)
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two strings; ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or (letters(a) ^ letters(b)).bit_count() > 2 * most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


@lru_cache(maxsize=1 << 16)
def phonetic(token: str) -> str:
    """Sound code of a lower-case token without accents: consonant classes in order, vowels only at the start."""
    t = token.replace("ch", "C").replace("ph", "f").replace("qu", "k").replace("ll", "y").replace("h", "")
    out = []
    for i, c in enumerate(t):
        nxt = t[i + 1] if i + 1 < len(t) else ""
        if c in "aeiou":
            c = c if not i else ""
        elif c == "c":
            c = "s" if nxt in "ei" and nxt else "k"
        elif c == "g" and nxt and nxt in "ei":
            c = "j"
        else:
            c = {"z": "s", "x": "s", "v": "b", "w": "b", "ñ": "n", "y": "y", "q": "k"}.get(c, c)
        if c and (not out or out[-1] != c):
            out.append(c)
    return "".join(out)
