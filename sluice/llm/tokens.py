"""Exact tokenisation through public tokenizer files.

``tokenizers`` spends microseconds a word.  Texts are therefore cut, many at once,
where its pre-tokeniser always cuts (before white space that follows something else,
and before the marks that end a word); each distinct piece is encoded once, many
joined by a special token that stands apart; and a document's ids are the joined ids
of its pieces.  Texts with unusual white space are encoded as they are.
"""

from __future__ import annotations

import os
import re
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from .common import worker_state
from .words import distinct, split_pieces

#: White space other than space, tab, newline and carriage return.
UNUSUAL = re.compile("[\x00\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def as_it_is(text: str) -> str:
    return text


def lowered(text: str) -> str:
    """The text as a tokenizer that composes, lower-cases and drops white space may be given it.

    Lower-casing here makes pieces alike; it is left to the tokenizer where the
    order of composing and lower-casing, or a final sigma, could matter, and where
    special tokens may occur, which are found before letters are lowered.
    """
    if "<|" in text:
        return text
    low = text.lower()
    if not text.isascii() and ("\u03a3" in text or not (is_normalized("NFC", text) and is_normalized("NFC", low))):
        return text
    return low


class PieceEncoder:
    """Texts to little-endian ids, two bytes each if the vocabulary allows, else four."""

    def __init__(self, path: str, pieces: str, plain: bool = False, limit: int | None = None):
        """plain: special tokens' strings in a text are ordinary text, so their ids mark nothing else; limit: pieces that are kept."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = plain
        self.prepared, self.keeps_space = {"byte": (as_it_is, True), "word": (lowered, False)}[pieces]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        specials = [(k, t.content) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark, self.between = min(specials, default=(-1, ""))
        self.limit = limit or {"byte": 300_000, "word": 200_000}[pieces]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_encode`` of distinct pieces, those known from before looked up; beyond limit all are forgotten."""
        if len(self.known) > self.limit:
            self._forget()
        at = np.fromiter((self.known.get(p, -1) for p in pieces), np.int64, len(pieces))
        strange = np.flatnonzero(at < 0)
        if len(strange):
            new = [pieces[k] for k in strange.tolist()]
            ids, starts, sizes = self._encode(new)
            at[strange] = first = np.arange(len(self.held[1]), len(self.held[1]) + len(new))
            self.held = np.concatenate([self.held[0], ids]), np.concatenate([self.held[1], starts + len(self.held[0])]), np.concatenate([self.held[2], sizes])
            self.known.update((p, k) for p, k in zip(new, first.tolist()) if len(p) <= 100)
        return self.held[0], self.held[1][at], self.held[2][at]

    def _encode(self, pieces: list[str], size: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece's ids begin, how many there are) of distinct pieces."""
        alone = [k for k, p in enumerate(pieces) if not self.between or "<|" in p or len(p) > 1000]
        there = set(alone)
        joined = [p for k, p in enumerate(pieces) if k not in there] if alone else pieces
        self.tokenizer.encode_special_tokens = not self.between and self.plain
        parts, close = [np.zeros(0, self.dtype)], np.array([self.mark if self.between else 0], self.dtype)
        for k in range(0, len(joined), 100 * size):
            groups = [self.between.join(joined[j : j + size]) for j in range(k, min(k + 100 * size, len(joined)), size)]
            for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False):
                parts += [np.array(e.ids, self.dtype), close]
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == close[0]) if joined else np.zeros(0, np.int64)
        starts = np.append(0, ends[:-1] + 1)[: len(ends)]
        sizes = ends - starts
        if alone:
            self.tokenizer.encode_special_tokens = self.plain
            own = [np.array(e.ids, self.dtype) for k in range(0, len(alone), 1000) for e in self.tokenizer.encode_batch_fast([pieces[j] for j in alone[k : k + 1000]], add_special_tokens=False)]
            n = np.array([len(x) for x in own], np.int64)
            rest = np.setdiff1d(np.arange(len(pieces)), alone)
            every = np.zeros((2, len(pieces)), np.int64)
            every[:, rest] = starts, sizes
            every[:, alone] = len(ids) + np.cumsum(n) - n, n
            ids, (starts, sizes) = np.concatenate([ids, *own]), every
        return ids, starts, sizes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        prepared = [self.prepared(t) if t else "" for t in texts]
        whole = np.fromiter((bool(UNUSUAL.search(t)) for t in prepared), bool, len(prepared))
        prepared = [t if not w else o for t, w, o in zip(prepared, whole.tolist(), texts)]
        pieces, counts = split_pieces(pa.array(prepared, pa.string()), whole, self.keeps_space)
        codes, values = distinct(pieces)
        data, starts, sizes = self._ids(values)
        width = self.dtype.itemsize
        own = sizes[codes]
        after = np.cumsum(own)
        place = np.repeat((starts[codes] - after + own).astype(np.int32), own)
        place += np.arange(len(place), dtype=np.int32)
        ids = data[place].tobytes()
        ends = np.append(0, after)[np.append(0, np.cumsum(counts))] * width
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def release() -> None:
    """Forget the worker's encoders, whose pieces would take memory from the stages that follow."""
    state = worker_state()
    for key in [k for k in state if isinstance(k, tuple) and k[0] == "encoder"]:
        del state[key]


def encoder(path: str, pieces: str, plain: bool = False, limit: int | None = None) -> PieceEncoder:
    """The worker's encoder of this file; limit: pieces that it keeps."""
    state, key = worker_state(), ("encoder", path, plain, limit)
    if key not in state:
        state[key] = PieceEncoder(path, pieces, plain=plain, limit=limit)
    return state[key]


def encoded(batches, path: str, pieces: str, end_id: int, plain: bool = False, chars: int = 5_000_000, limit: int | None = None):
    """(doc_id, ids with the end id) of each row (doc_id, text) of Arrow batches, in order."""
    enc = encoder(path, pieces, plain, limit)
    end = np.array([end_id], enc.dtype).tobytes()
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        k = 0
        while k < len(keys):
            some, size, first = [], 0, k
            while k < len(keys) and size < chars:
                some.append(texts[k].as_py())
                size += len(some[-1] or "")
                k += 1
            for key, ids in zip(keys[first:k], enc.encode(some)):
                yield key, ids + end
