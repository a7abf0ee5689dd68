"""Splitting of Arrow texts into words and pieces with numpy, without an object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes as they are, but white space as spaces; with A-Z lower-cased besides.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[9:14] = 32
FOLDED = SPACED.copy()
FOLDED[65:91] += 32


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each text begins and the last one ends) of strings without nulls."""
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)) if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64) - int(at[0])


def packed(raw: np.ndarray, starts: np.ndarray, kind=None) -> pa.Array:
    """The binary array of the strings that begin at these places and follow each other without gaps."""
    offsets = np.append(starts, len(raw)).astype(np.int32)
    return pa.Array.from_buffers(kind or pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def split_words(texts: pa.Array, table: np.ndarray = FOLDED) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, one after the other, bytes changed by table; words of each text)."""
    raw, at = bytes_of(texts)
    raw = table[raw]
    solid = raw != 32
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    first = at[:-1][at[:-1] < len(raw)]
    begin[first] = solid[first]
    starts = np.flatnonzero(begin)
    counts = np.diff(np.searchsorted(starts, at))
    place = np.cumsum(solid, dtype=np.int32)
    return packed(raw[solid], place[starts] - 1), counts


#: Bytes by kind: white space, ASCII marks, ASCII letters, first and second bytes of accented Latin letters, all others.
SPACE, MARK, LETTER, LATIN, OTHER = 1, 2, 4, 8, 16
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[9, 10, 13, 32]] = SPACE
KINDS[[k for k in range(33, 127) if not chr(k).isalnum()]] = MARK
KINDS[[k for k in range(128) if chr(k).isalpha()]] = LETTER
KINDS[0xC3] = LATIN


def split_pieces(texts: pa.Array, whole: np.ndarray, keep_space: bool) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts, pieces of each).

    Texts are cut before white space that follows something else, and where ASCII
    marks end a word of unaccented and accented Latin letters.  whole: texts that
    stay uncut.  Without keep_space white space is left out of the others.
    """
    raw, at = bytes_of(texts)
    kind = KINDS[raw]
    latin = np.flatnonzero(kind[:-1] == LATIN)
    second = raw[latin + 1]
    good = (second & 0xC0 == 0x80) & (second != 0x97) & (second != 0xB7)
    kind[latin] = kind[latin + 1] = OTHER
    kind[latin[good]] = kind[latin[good] + 1] = LETTER
    if len(kind) and kind[-1] == LATIN:
        kind[-1] = OTHER
    uncut = np.zeros(len(raw), bool)
    for k in np.flatnonzero(whole).tolist():
        uncut[at[k] : at[k + 1]] = True
    space = (kind == SPACE) & ~uncut
    first = at[:-1][at[:-1] < len(raw)]
    begin = space.copy() if keep_space else ~space
    begin[1:] &= ~space[:-1] if keep_space else space[:-1]
    begin[first] = True if keep_space else ~space[first]
    if not keep_space:
        raw, kind, uncut, begin, rank = raw[~space], kind[~space], uncut[~space], begin[~space], np.append(0, np.cumsum(~space, dtype=np.int32))
        at = rank[at]
    starts = np.flatnonzero(begin)
    # marks at the end of a word: the one place in the piece where marks begin, and nothing but letters before
    mark = kind == MARK
    turn = mark.copy()
    turn[1:] &= ~mark[:-1]
    if len(starts):
        ends = np.append(starts[1:], len(raw)) - 1
        odd = np.add.reduceat((kind == OTHER) | uncut, starts, dtype=np.int32)
        turns = np.add.reduceat(turn, starts, dtype=np.int32)
        fit = np.repeat((odd == 0) & (turns == 1) & mark[ends] & ~mark[starts], np.diff(np.append(starts, len(raw))))
        turn &= fit
        turn[1:] &= kind[:-1] == LETTER
        begin |= turn
        starts = np.flatnonzero(begin)
    return packed(raw, starts, pa.string()), np.diff(np.searchsorted(starts, at))


def distinct(values: pa.Array) -> tuple[np.ndarray, list]:
    """(number of each value among the distinct ones, the distinct ones)."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def chunks(texts: pa.Array, size: int):
    """(first, last) of runs of texts of about size bytes."""
    _, at = bytes_of(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield a, b
        a = b
