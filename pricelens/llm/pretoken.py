"""Splitting texts into pre-tokens, and compact lists of integers."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import regex

# Fixed value: the published pattern that splits text before byte-level merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same splits by the standard library, about twice as fast, for texts of ASCII and of
# Latin letters up to U+024F only; any other character sends the text to the pattern itself.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BEYOND = re.compile("[^\\x00-\\x1b\\x20-\\x7eÀ-ÖØ-öø-ɏ]")


@functools.lru_cache(maxsize=8)
def splitter(pattern: str = BYTE_LEVEL_PATTERN) -> Callable[[str], list[str]]:
    """``text -> pre-tokens`` by ``pattern`` (without groups)."""
    whole = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL_PATTERN:
        return whole
    latin, beyond = _LATIN.findall, _BEYOND.search
    return lambda text: whole(text) if beyond(text) else latin(text)


def pack_ints(values, pack: Callable[[bytes], bytes]) -> bytes:
    """Integers from 0 below 2**32, seven bits a byte, each byte position compressed on its
    own: first bytes, then the second bytes of those numbers that have one, and so on."""
    v, out = np.asarray(values, np.uint32), []
    while True:
        more = v >= 128
        out.append(pack(((v & 127) | more * np.uint32(128)).astype(np.uint8).tobytes()))
        if not more.any():
            return join_parts(out)
        v = v[more] >> 7


def unpack_ints(data: bytes, unpack: Callable[[bytes], bytes]) -> np.ndarray:
    planes = [np.frombuffer(unpack(p), np.uint8) for p in split_parts(data)]
    v = planes.pop().astype(np.int64)
    for p in reversed(planes):
        low = (p & 127).astype(np.int64)
        low[p >= 128] |= v << 7
        v = low
    return v


def join_parts(parts: list[bytes]) -> bytes:
    """Byte strings behind their lengths."""
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at:at + 4], "little")
        out.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return out


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices ``pool[start:start + size]`` one after another."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
