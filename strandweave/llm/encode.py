"""Token ids of whole texts by the tokenizers library, with a cache of the pieces that repeat.

Byte-pair merges never cross the borders that a tokenizer's own pre-splitting draws, so a text may be cut at borders
that the pre-splitting is certain to draw, and the ids of each cut looked up or encoded once:

* `drop` tokenizers lose white space: every white-space run is a border;
* `lead` tokenizers keep a single blank with the word after it: a border stands before a blank, and around a line
  feed, where no white space touches other white space.

Both draw a border between a letter or digit and the marks after it, so a word and its last ASCII marks are pieces of their own.
`drop` tokenizers lower-case texts; ASCII letters are put in lower case first, but for those before another kind of letter or mark,
which may be composed with it.

Texts are cut as blocks of bytes, and each different piece of a block is looked up once. Texts for which the borders aren't
certain (special-token marks, other or doubled white space) go through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from strandweave.functions.blocks import column_of

WORD_BPE, BYTE_BPE, END_ID = "word_bpe_49k.json", "byte_bpe_50k.json", 2
#: Cached pieces per worker of two generations: when the younger is full it becomes the older, whose pieces move over as they
#: are used again.
CACHE = 200_000
BLOCK, TOGETHER = 1 << 20, 200  # letters of texts that are cut at once, and pieces that are encoded in one call
_UNSURE = {"drop": re.compile("[\x1c-\x1f]|<\\|"), "lead": re.compile(r"\s\s|[^\S \n]|<\|")}
_OTHER_BLANKS = re.compile(r"[^\S\x00-\x7f]")


def _bytes(*ranges: range | bytes) -> np.ndarray:
    """A table of the bytes in the ranges."""
    out = np.zeros(256, dtype=bool)
    out[list(chain(*ranges))] = True
    return out


BLANK, CONTROL, UPPER = _bytes(range(9, 14), b" "), _bytes(range(9, 14), range(28, 33)), _bytes(range(65, 91))
ALNUM = _bytes(range(48, 58), range(65, 91), range(97, 123))
MARK = _bytes(range(33, 127)) & ~ALNUM
LATIN = _bytes(range(0x80, 0xC0)) & ~_bytes(b"\x97\xb7")  # after 0xC3: letters, but for the signs of multiplication and division
#: First and second bytes of all white space that isn't ASCII.
STRANGE, STRANGE_NEXT = _bytes(b"\xc2\xe1\xe2\xe3"), _bytes(b"\x80\x81\x85\x9a\xa0")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str, blanks: str, room: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.inner, self.blanks, self.cache = Tokenizer.from_file(path), blanks, {}
        self.older: dict[str, bytes] = {}
        self.room = room
        self.unsure = _UNSURE[blanks].search
        self.vocab_size = self.inner.get_vocab_size()
        self.line_feed = self._whole(["\n"])[0]
        self.token_bytes = np.zeros(self.vocab_size, dtype=np.int64)  # byte-level tokens have a character for each byte
        for token, i in self.inner.get_vocab().items():
            self.token_bytes[i] = len(token.removesuffix("</w>") if blanks == "drop" else token)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode pieces, many in one call, parted by line feeds; the bytes that tokens stand for tell where each ends.

        A piece has the white space before it, which a `lead` tokenizer takes if it is a blank, and others don't.
        """
        lead, put = self.blanks == "lead", self.cache.__setitem__
        texts = [p.removeprefix("\n" if lead else " ") for p in new]
        for at in range(0, len(new), TOGETHER):
            keys, some = new[at : at + TOGETHER], texts[at : at + TOGETHER]
            raw = self._whole(["\n".join(some)])[0]
            if lead:
                sizes = [len(p.encode()) + 1 for p in some]  # with the line feed, but for the last
                sizes[-1] -= 1
            else:
                sizes = [len(p.encode()) if p.isascii() else len(unicodedata.normalize("NFC", p).lower().encode()) for p in some]
            ends, upto = np.cumsum(self.token_bytes[np.frombuffer(raw, dtype="<u4")]), np.cumsum(sizes)
            cuts = np.searchsorted(ends, upto)
            if all(some) and not any(p.isspace() for p in some) and cuts[-1] == len(ends) - 1 and (ends[cuts] == upto).all():
                stops = (4 * cuts + 4).tolist()
                less = 4 * lead
                for key, first, stop in zip(keys, [0, *stops], stops, strict=False):
                    put(key, raw[first : stop - less])
                put(keys[-1], raw[stops[-2] if len(stops) > 1 else 0 :])
            else:  # a blank of its own, or a letter that libraries lower-case in different ways
                self.cache.update(zip(keys, self._whole(some), strict=True))

    def _doubtful(self, data: np.ndarray) -> np.ndarray:
        """Places of all bytes that may make a text unsure, or be white space that isn't ASCII, and of some others."""
        odd = CONTROL[data]
        if self.blanks == "drop":
            odd &= ~BLANK[data]
        else:
            twice = odd[:-1] & odd[1:]
            odd &= (data != 32) & (data != 10)
            odd[:-1] |= twice
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124) | STRANGE[data[:-1]] & STRANGE_NEXT[data[1:]]
        return np.flatnonzero(odd)

    @staticmethod
    def _cut(data: np.ndarray) -> np.ndarray:
        """Where the pieces of texts start, which come one after another with white space before each: at all white space, and at the
        marks that end a word."""
        starts = np.flatnonzero(BLANK[data])
        ends = np.append(starts[1:], len(data))
        body = np.flatnonzero(~MARK[data])
        upto = body[np.searchsorted(body, ends) - 1] + 1  # where a piece has nothing but marks any more
        last = data[upto - 1]
        marks = upto[(upto < ends) & (ALNUM[last] | LATIN[last] & (data[upto - 2] == 0xC3))]
        return np.sort(np.concatenate([starts, marks]), kind="stable")

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces; those that aren't in the cache are put there."""
        if len(self.cache) > self.room:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        if new := [p for p in pieces if p not in cache]:
            if older:
                cache |= {p: older[p] for p in new if p in older}
                new = [p for p in new if p not in cache]
            self._learn(new)
        return list(map(cache.__getitem__, pieces))

    def _block(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are not empty."""
        data, upto = self._joined(texts)
        doubtful = np.unique(np.searchsorted(upto, self._doubtful(data), side="right")).tolist()
        if whole := {i: raw for i in doubtful if self.unsure(texts[i]) for raw in self._whole([texts[i]])}:
            rest = iter(self._block(left) if (left := [t for i, t in enumerate(texts) if i not in whole]) else [])
            return [whole[i] if i in whole else next(rest) for i in range(len(texts))]
        if self.blanks == "drop":
            if doubtful:
                data, upto = self._joined([_OTHER_BLANKS.sub(" ", t) for t in texts])
            plain = np.append(data[1:], data[:1]) < 128
            data = np.where(UPPER[data] & plain, data | 32, np.where(BLANK[data], 32, data)).astype(np.uint8)
        starts = self._cut(data)
        codes = column_of(data, np.append(starts, len(data)), pa.string()).dictionary_encode()
        pieces = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        known, which = self._known(pieces), codes.indices.to_numpy(zero_copy_only=False)
        if self.blanks == "lead":  # a line's first piece has its line feed with it
            known = [self.line_feed + raw if p[0] == "\n" else raw for p, raw in zip(pieces, known, strict=True)]
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        sizes = np.array([len(raw) for raw in known], dtype=np.int64) // 4
        n, first = sizes[which], (np.cumsum(sizes) - sizes)[which]
        stops = np.cumsum(n)
        raw = flat[np.arange(stops[-1]) + np.repeat(first - stops + n, n)].tobytes()
        borders = np.append(0, np.append(0, stops)[np.searchsorted(starts, upto)] * 4).tolist()
        skip = 4 * (self.blanks == "lead")  # a text has no line feed before it
        return [raw[lo + skip : hi] for lo, hi in zip(borders, borders[1:], strict=False)]

    @staticmethod
    def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts, each with a line feed before it, and where each ends."""
        sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
        return np.frombuffer(("\n" + "\n".join(texts)).encode(), dtype=np.uint8), np.cumsum(sizes) + np.arange(1, len(texts) + 1)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers; a null text has none."""
        out, some, size = [], [], 0
        for text in [t for t in texts if t]:
            some.append(text)
            size += len(text)
            if size > BLOCK:
                out += self._block(some)
                some, size = [], 0
        if some:
            out += self._block(some)
        ids = iter(out)
        return [next(ids) if text else b"" for text in texts]


@lru_cache(maxsize=4)
def encoder(path: str, blanks: str, room: int = CACHE) -> Encoder:
    """One encoder per worker and vocabulary, kept from task to task."""
    return Encoder(path, blanks, room)
