"""Token ids of whole texts, by the tokenizers library, fast enough for large corpora.

A byte-level BPE splits a text into pieces (words with their leading space, numbers, signs, white space)
and encodes each piece by itself.  The pieces are cut in numpy, each different piece is encoded once per
worker by the library's model, and the ids are put together by piece number.  Texts that hold a special
token's string, or a character above ``PLAIN``, go to the library whole, so every text gets exactly the
ids of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex

from .common import mix, prefix_hash, span_hash, utf8

#: Below this code point the classes of characters are as fixed as the table here takes them.
PLAIN = 0x2000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(PLAIN + 1, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        out[[m.start() for m in regex.finditer(pattern, "".join(map(chr, range(PLAIN))))]] = kind
    return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts under one tokenizer file; one per worker process, by ``encoder(path)``."""

    #: Different pieces that a worker keeps; with more it begins anew.
    MOST = 3_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the printable stand-ins for bytes of byte-level vocabularies
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.table = {b: chr(b if b in printable else next(rest)) for b in range(256)}
        self._clear()

    def _clear(self):
        self.bits = 16
        self.size, self.keys, self.slots = 0, np.zeros(1 << 12, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.begin, self.length, self.ids, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32), 0
        self.seen: set[int] = set()

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers by hash, -1 for unknown: linear probing."""
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at = self.slots[slot]
        wrong = np.flatnonzero((at >= 0) & (self.keys[at] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & mask
            at[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(at[wrong] >= 0) & (self.keys[at[wrong]] != h[wrong])]
        return at

    def _grow(self, new: int):
        while self.size + new > len(self.keys):
            self.keys, self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.begin, self.length))
        if 2 * (self.size + new) > 1 << self.bits:
            while 2 * (self.size + new) > 1 << self.bits:
                self.bits += 1
            self.slots = np.full(1 << self.bits, -1, np.int32)
            self._place(np.arange(self.size, dtype=np.int32))

    def _place(self, numbers: np.ndarray):
        mask = (1 << self.bits) - 1
        slot = (self.keys[numbers] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & mask

    def _learn(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, data: bytes):
        h, first = np.unique(h, return_index=True)
        self._grow(len(h))
        found = [self.model.tokenize(data[a:b].decode("latin-1").translate(self.table)) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        n = np.array([len(x) for x in found], np.int32)
        ids = np.array([t.id for x in found for t in x], np.uint32)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = slice(self.size, self.size + len(h))
        self.keys[at], self.length[at], self.begin[at] = h, n, self.used + np.cumsum(n) - n
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.size += len(h)
        self._place(np.arange(at.start, at.stop, dtype=np.int32))

    def _pieces(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, as bytes; texts of plain characters only, one after the other."""
        lead = (raw & 0xC0) != 0x80
        at = np.flatnonzero(lead)  # of each character its first byte
        code = raw[at].astype(np.int32)
        two = code >= 0xC0
        where = at[two]
        code[two] = ((code[two] & 0x1F) << 6) | (raw[where + 1] & 0x3F)
        three = np.flatnonzero(raw[at] >= 0xE0)
        if len(three):
            b = at[three]
            code[three] = ((raw[b].astype(np.int32) & 0x0F) << 12) | ((raw[b + 1].astype(np.int32) & 0x3F) << 6) | (raw[b + 2] & 0x3F)
        n = len(code)
        kind = _classes()[np.minimum(code, PLAIN)]
        begins = np.zeros(n + 1, bool)  # of texts
        begins[np.searchsorted(at, offs)] = True
        begins = begins[:-1]
        new = begins.copy()
        new[1:] |= kind[1:] != kind[:-1]
        # the last white space before something else: a blank goes to what follows, another stands alone
        ends = np.append(new[1:], True)
        last = np.flatnonzero((kind == SPACE) & ends)
        last = last[last < n - 1]
        last = last[~begins[last + 1]]
        new[last] = True
        blank = last[code[last] == 32]
        new[blank + 1] = False
        # 's 't 'm 'd 're 've 'll are pieces where an apostrophe starts one
        quote = np.flatnonzero((code == 39) & new & np.append(new[1:], True))
        if len(quote):
            for q in quote.tolist():
                if q + 1 >= n or begins[q + 1] or kind[q + 1] != LETTER:
                    continue
                second = chr(code[q + 1])
                if second in "stmd":
                    size = 1
                elif q + 2 < n and not begins[q + 2] and second + chr(code[q + 2]) in ("re", "ve", "ll"):
                    size = 2
                else:
                    continue
                new[q + 1] = False
                if q + 1 + size < n:
                    new[q + 1 + size] = True
        start = at[new]
        return start, np.append(start[1:], len(raw))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of each text's ids."""
        raw, offs = utf8(column)
        data = raw.tobytes()
        odd = np.zeros(len(offs) - 1, bool)
        high = np.flatnonzero(raw >= 0xE2)
        if len(high):
            odd[np.searchsorted(offs, high, "right") - 1] = True
        for s in self.special:
            s = s.encode()
            k = data.find(s)
            while k >= 0:
                odd[np.searchsorted(offs, k, "right") - 1] = True
                k = data.find(s, k + 1)
        if odd.any():
            plain = column.filter(pa.array(~odd))
            ids, begin = self._plain(*utf8(plain))
            whole = [e.ids for e in self.tokenizer.encode_batch(column.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
            n = np.zeros(len(odd), np.int64)
            n[~odd], n[odd] = np.diff(begin), [len(x) for x in whole]
            parts, whole = iter(np.split(ids, begin[1:-1]) if len(begin) > 1 else ()), iter(whole)
            ids = np.concatenate([np.array(next(whole), np.uint32) if o else next(parts) for o in odd])
            return ids, np.concatenate([[0], np.cumsum(n)])
        return self._plain(raw, offs, data)

    def _plain(self, raw: np.ndarray, offs: np.ndarray, data: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        start, end = self._pieces(raw, offs)
        h = span_hash(prefix_hash(raw), start, end)
        number = self._find(h)
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            if self.size + len(unknown) > self.MOST and self.size:
                self._clear()
                unknown = np.arange(len(h))
            self._learn(h[unknown], start[unknown], end[unknown], data if data is not None else raw.tobytes())
            number = self._find(h)
        n = self.length[number].astype(np.int64)
        to = np.cumsum(n)
        ids = self.ids[np.arange(to[-1]) + np.repeat(self.begin[number] - (to - n), n)]
        before = np.concatenate([[0], to])
        return ids, before[np.searchsorted(start, offs)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
