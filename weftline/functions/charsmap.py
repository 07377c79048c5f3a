"""Precompiled character maps: a size, a double-array trie, and replacements that end in NUL.

A grapheme cluster of fewer than six bytes is looked up whole, else its
characters one by one; the shortest entry that is a prefix of what is looked up
wins.
"""

from __future__ import annotations

import re
import struct


def graphemes(text: str) -> list[str]:
    try:
        import regex
    except ImportError:  # a base character and the marks after it
        return re.findall(r"\r\n|.[̀-ͯ‍️\U0001f3fb-\U0001f3ff]*", text, re.S)
    return regex.findall(r"\X", text)


class Charsmap:
    def __init__(self, blob: bytes):
        if len(blob) < 4:
            raise ValueError("a charsmap has at least four bytes")
        (size,) = struct.unpack_from("<I", blob)
        if size % 4 or 4 + size > len(blob):
            raise ValueError("the charsmap's trie is cut short")
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size :]
        self.seen: dict[str, str | None] = {}

    def _lookup(self, key: bytes) -> str | None:
        units, node = self.units, 0
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node ^= offset(units[0])
        for byte in key:
            if byte == 0:
                return None
            node ^= byte
            if node >= len(units) or units[node] & ((1 << 31) | 0xFF) != byte:
                return None
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & ((1 << 31) - 1)
                end = self.texts.find(b"\0", start)
                return self.texts[start : end if end >= 0 else None].decode()
        return None

    def lookup(self, part: str) -> str | None:
        if part not in self.seen:
            self.seen[part] = self._lookup(part.encode())
        return self.seen[part]

    def apply(self, text: str) -> str:
        out = []
        for g in graphemes(text):
            whole = self.lookup(g) if len(g.encode()) < 6 else None
            if whole is not None:
                out.append(whole)
                continue
            for c in g:
                to = self.lookup(c)
                out.append(c if to is None else to)
        return "".join(out)
