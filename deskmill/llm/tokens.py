"""Token ids of whole texts by the tokenizers library, a batch of texts at a time.

A byte-level BPE encodes each pre-token on its own.  So the bytes of a batch are cut in numpy at places that
are pre-token borders in every context, Arrow finds the distinct pieces, and only pieces that a bounded
cache lacks go to the library; the ids of all occurrences are then gathered in numpy.  A text that
holds an added token (``<|endoftext|>``), and every text of a vocabulary of another kind, goes to the library whole.

Cases: null and empty texts have no ids; a very long text is worked as one slice of its own.
"""

from __future__ import annotations

import os
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Vocabulary file by default; a parameter of every operator that needs ids.
VOCAB = "byte_bpe_50k.json"
_ASCII = [chr(b) for b in range(128)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.array([c.isalpha() for c in _ASCII] + [False] * 128)
_MARK = np.array([0x20 < ord(c) < 0x7F and not c.isalnum() for c in _ASCII] + [False] * 128)
_MARKS = bytes(np.flatnonzero(_MARK).tolist())
#: 1 for white space, 2 for marks.
_KIND = _SPACE + 2 * _MARK.astype(np.uint8)
#: Unicode white space beyond ASCII, which would prolong a run of spaces (fixed values, in UTF-8).
_WIDE = [c.encode() for c in "\x85\xa0 ᠎               　"]
_WIDE_FIRST, _WIDE_LAST = ({c[i] for c in _WIDE} | {0x1C, 0x1D, 0x1E, 0x1F} for i in (0, -1))
_IS_FIRST, _IS_LAST = (np.isin(np.arange(256), list(x)) for x in (_WIDE_FIRST, _WIDE_LAST))
#: Letters below this are of long-settled Unicode categories.
_SETTLED = "԰"


def vocab_path(name: str = VOCAB) -> str:
    """Where a public vocabulary lies on this machine; a path is returned as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def cut_places(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte places where pieces begin, and the end; texts are data[bounds[i]:bounds[i + 1]].

    A run of ASCII white space begins a piece; when a character follows, the run's last one does too, and,
    unless it is a space (which joins what follows), so does the character.  Runs next to other
    white space are left alone.  A letter and an ASCII mark after it are apart.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    cut = edge.copy()
    cut[[0, n]] = True
    if not n:
        return np.zeros(1, np.int64)
    kind = _KIND[data]
    space = np.flatnonzero(kind == 1)
    first, last = np.ones(len(space), bool), np.ones(len(space), bool)
    first[1:] = (space[1:] - space[:-1] > 1) | edge[space[1:]]
    last[:-1] = first[1:]
    a, b = space[first], space[last] + 1
    at_end = edge[b]
    clean = np.ones(len(a), bool)
    before = np.flatnonzero(~edge[a] & _IS_LAST[data[a - 1]])
    after = np.flatnonzero(~at_end & _IS_FIRST[data[np.minimum(b, n - 1)]])
    for i in before.tolist():
        end = int(a[i])
        clean[i] = data[end - 1] >= 0x80 and not any(data[max(0, end - len(c)) : end].tobytes() == c for c in _WIDE)
    for i in after.tolist():
        begin = int(b[i])
        clean[i] &= data[begin] >= 0x80 and not any(data[begin : begin + len(c)].tobytes() == c for c in _WIDE)
    cut[a[clean]] = True
    b = b[clean & ~at_end]
    cut[b - 1] = True
    cut[b[data[b - 1] != 0x20]] = True
    mark = np.flatnonzero(kind == 2)
    left, lead = data[mark - 1], data[mark - 2]
    cut[mark[_LETTER[left] | (lead == 0xC3) & (left >= 0x80) & (left != 0x97) & (left != 0xB7)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """``encode(column)`` gives the ids of all texts and how many each has."""

    def __init__(self, vocab: str = VOCAB, cache_pieces: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self._tokenizer = t = Tokenizer.from_file(vocab_path(vocab))
        self._added = [x.content for x in t.get_added_tokens_decoder().values()]
        self._by_piece = isinstance(t.model, models.BPE) and t.normalizer is None and isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) and t.pre_tokenizer.use_regex and not t.pre_tokenizer.add_prefix_space
        self._model, self._room = t.model, cache_pieces
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in printable]
        alphabet = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}  # the public byte alphabet
        self._chars = np.array([alphabet[b] for b in range(255)] + [ord("\n")], "<u4")  # byte 255 is in no text and parts pieces
        self._forget()

    def _forget(self) -> None:
        """Make room: what was met in several batches stays, if that leaves half of the cache free."""
        old = getattr(self, "_cache", {})
        kept = [p for p, i in old.items() if self._met[i] > 2]
        if 2 * len(kept) > self._room:
            kept = []
        places = [old[p] for p in kept]
        ids = [self._flat[self._start[i] : self._start[i] + self._size[i]] for i in places]
        self._cache: dict[bytes, int] = {}
        self._flat = np.empty(1 << 16, np.uint32)
        self._start, self._size, self._met = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self._used = 0
        if kept:
            self._store(kept, np.array([len(x) for x in ids]), np.concatenate(ids))

    def _one_pre_token(self, piece: bytes) -> bool:
        body = piece[1:] if piece[:1] == b" " else piece
        if body.isalpha() or body.isdigit():
            return True
        if body.isascii():
            return bool(body) and not body.strip(_MARKS)
        word = body.decode()
        return word.isalpha() and max(word) < _SETTLED

    def _learn(self, pieces: list[bytes]) -> None:
        """Put the ids of new pieces into the cache."""
        chars = self._chars[np.frombuffer(b"\xff".join(pieces), np.uint8)].tobytes().decode("utf-32-le").split("\n")
        tokenize, ids, rest = self._model.tokenize, [], []
        for i, (piece, c) in enumerate(zip(pieces, chars, strict=True)):
            if self._one_pre_token(piece):
                ids.append([t.id for t in tokenize(c)])
            else:
                ids.append(None)
                rest.append(i)
        if rest:
            found = self._tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False)
            for i, x in zip(rest, found, strict=True):
                ids[i] = x.ids
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self._store(pieces, size, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())))

    def _store(self, pieces: list[bytes], size: np.ndarray, flat: np.ndarray) -> None:
        known = len(self._cache)
        while len(self._start) < known + len(pieces):
            self._start, self._size, self._met = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._size, self._met))
        while len(self._flat) < self._used + len(flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[self._used : self._used + len(flat)] = flat
        self._size[known : known + len(pieces)] = size
        self._start[known : known + len(pieces)] = self._used + np.cumsum(size) - size
        self._used += len(flat)
        self._cache.update(zip(pieces, range(known, known + len(pieces)), strict=True))

    def _encode_pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
        bounds = offsets - offsets[0]
        places = cut_places(data, bounds)
        found = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        joined, ends = found.dictionary.buffers()[2], np.frombuffer(found.dictionary.buffers()[1], np.int64)[: len(found.dictionary) + 1].tolist()
        joined = joined.to_pybytes() if joined is not None else b""
        distinct = [joined[i:j] for i, j in pairwise(ends)]
        if len(self._cache) > self._room:
            self._forget()
        if new := [p for p in distinct if p not in self._cache]:
            self._learn(new)
        entry = np.fromiter(map(self._cache.__getitem__, distinct), np.int32, len(distinct))
        self._met[entry] += 1
        entry = entry[found.indices.to_numpy()]
        size = self._size[entry]
        before = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ids = self._flat[np.repeat(self._start[entry] - before[:-1], size) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(places, bounds)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        column = column.cast(pa.large_string()).fill_null("")
        if not len(column):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        whole = np.full(len(column), not self._by_piece)
        for token in self._added:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode_pieces(column)
        ids, counts = self._encode_pieces(pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), column))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(whole).tolist():
            parts[i] = np.array(self._tokenizer.encode_batch_fast([column[i].as_py()], add_special_tokens=False)[0].ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode_ended(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with ``end_id`` after each text."""
        ids, counts = self.encode(column)
        return np.insert(ids, np.cumsum(counts), end_id), counts + 1


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(vocab: str = VOCAB, cache_pieces: int = 400_000) -> Encoder:
    """The Python worker's encoder; made once per process."""
    if (vocab, cache_pieces) not in _ENCODERS:
        _ENCODERS[vocab, cache_pieces] = Encoder(vocab, cache_pieces)
    return _ENCODERS[vocab, cache_pieces]
