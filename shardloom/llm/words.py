"""Words of damaged multilingual text, in a form that survives case, accents, punctuation and line breaks."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np

_MARKS = re.compile("[̀-ͯ­​-‏﻿]+")
_LINE_END = re.compile("[-‐‑][ \t]*\r?\n[ \t]*(?=[^\\W\\d_])")
_SIGNS = re.compile("[¡-©«-´¶-¹»-¿×÷‐-⁯₠-₿←-⯿　-〃〈-】]+")
#: Bytes that separate words: ASCII other than letters and digits.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: UTF-8 read as Windows-1252: a lead byte's character and the characters of bytes 0x80 to 0xbf after it.
_LATE = "".join(sorted({bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xC0)} | {chr(b) for b in range(0x80, 0xC0)}))
_MISREAD = re.compile(f"[Â-ô][{re.escape(_LATE)}]{{1,3}}")


def _reread(m: re.Match) -> str:
    raw = bytearray()
    for ch in m[0]:
        try:
            raw += ch.encode("cp1252")
        except UnicodeEncodeError:
            raw.append(ord(ch))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def repaired(text: str) -> str:
    """Undo UTF-8 that was read as Windows-1252 or Latin-1, where the bytes are valid UTF-8."""
    return _MISREAD.sub(_reread, text) if "Ã" in text or "Â" in text or "â€" in text else text


def spelled(text: str) -> bytes:
    """Case-folded words without accents, as UTF-8 between spaces; digits count as words."""
    if not text.isascii():
        text = _SIGNS.sub(" ", _MARKS.sub("", unicodedata.normalize("NFKD", repaired(text))))
    if "-" in text:
        text = _LINE_END.sub("", text)
    return text.casefold().encode("utf-8", "replace").translate(_TABLE)


def words(text: str | None) -> list[bytes]:
    """The words of a text; null and empty text give none."""
    return spelled(text).split() if text else []


#: Base of the polynomial over a word's bytes, its inverse modulo 2^64, and the multiplier that mixes the sum.
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at once.
_PIECE = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, _INVERSE):
            x = np.full(2 * _PIECE, base, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers


def _hashes(b: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables()
    if len(b) > len(power):  # one word longer than a piece: hashed byte by byte
        raw = b.tobytes().split()
        return np.array([int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "little") or 1 for w in raw], np.uint32)
    letter = np.zeros(len(b) + 2, np.int8)
    letter[1:-1] = b != 32
    edge = np.diff(letter)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b.astype(np.uint64) * power[: len(b)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    h = ((h ^ (h >> np.uint64(32))) * _MIX) >> np.uint64(32)
    return np.maximum(h, 1).astype(np.uint32)


def word_hashes(text: str | None) -> np.ndarray:
    """``words`` as 32-bit hashes, none of them 0: a polynomial over the bytes, for all words of a text at once."""
    b = np.frombuffer(spelled(text), np.uint8) if text else np.zeros(0, np.uint8)
    if len(b) <= _PIECE:
        return _hashes(b)
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + _PIECE)
        if end < len(b) and b[end - 1] != 32:  # on to the end of the word
            space = np.flatnonzero(b[end : end + _PIECE // 2] == 32)
            while not len(space) and end < len(b):
                end = min(len(b), end + _PIECE // 2)
                space = np.flatnonzero(b[end : end + _PIECE // 2] == 32)
            end += int(space[0]) if len(space) else 0
        out.append(_hashes(b[at:end]))
        at = end
    return np.concatenate(out)
