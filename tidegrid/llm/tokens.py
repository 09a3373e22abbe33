"""Whole texts to token ids, with a table of what was encoded before."""

from __future__ import annotations

import contextlib
import ctypes
import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Where a text may be cut without changing its ids: before a single space (or any of the six white-space characters)
#: that follows something else.  Texts with other white space, or with special tokens' names, are encoded in one piece.
_ODD = [*map(chr, [0, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]), "<|"]
_RUN = re.compile(r"[\x20\x09-\x0D]{2}")
#: Marks and letters of which every tokenizer here makes one word each, letters before marks.  Letters are those up to
#: U+00FF but for three signs.
_MARKS, _SIGNS = "".join(chr(k) for k in range(33, 127) if not chr(k).isalnum() and chr(k) != "'"), frozenset("\xaa\xb5\xba")
_PIECE = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


class _Kept(dict):
    """What was encoded; encodes what wasn't when it is asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = self.encode(piece)
        return found


def released() -> None:
    """Gives back to the system what earlier steps of this process have freed, but Arrow and the allocator hold on to."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


_WORKERS: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts as the file's tokenizer does, without its special tokens.

    Both kinds of file split a text into words before they merge, and no word reaches over a change from other
    characters to white space.  So the ids of a text are those of its pieces, and pieces recur: each is encoded once
    for as long as it is kept.  ``spaces``: white space makes tokens (else it only parts words).
    """

    def __init__(self, path: str, *, spaces: bool, most: int = 700_000):
        self.tokenizer, self.spaces, self.most = Tokenizer.from_file(path), spaces, most
        self.model, self.words, self.others = self.tokenizer.model, {}, {}
        self.normal, self.parts = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        letters = [chr(i) for i in range(33, 256) if chr(i) in _MARKS or chr(i).isalpha() and chr(i) not in _SIGNS]
        self.bytes = str.maketrans({x: self.parts.pre_tokenize_str(x)[0][0] for x in letters} | {" ": self.parts.pre_tokenize_str("\n ")[-1][0][-1] if spaces else ""})
        self.kept = _Kept(self._piece)
        self.dtype = np.dtype("<u4" if self.wide else "<u2")

    def _pieces(self, text: str) -> list[str]:
        if not self.spaces:
            return text.split()
        if _RUN.search(text) is None:
            return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return _PIECE.findall(text)

    def _piece(self, piece: str) -> bytes:
        """The tokenizer's steps one by one, so that the words inside a piece are kept as well: plain ones as they stand in
        the text, which often is the piece itself, others as the tokenizer spells them."""
        letters = piece.rstrip(_MARKS)
        bare = letters[1:] if self.spaces and letters[:1] == " " else letters
        if bare.isalpha() and (bare.isascii() or max(bare) <= "\xff" and _SIGNS.isdisjoint(bare)):
            if len(self.words) > self.most:
                self.words.clear()
            word = letters if self.spaces else letters.lower()
            got = self.words.get(word)
            if got is None:
                got = self.words[word] = self._word(word.translate(self.bytes) if self.spaces or not word.isascii() else word)
            marks = piece[len(letters) :]
            return got + self._other(marks) if marks else got
        return b"".join([self._other(word) for word, _ in self.parts.pre_tokenize_str(self.normal.normalize_str(piece) if self.normal else piece)])

    def _word(self, word: str) -> bytes:
        return array("I" if self.wide else "H", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _other(self, word: str) -> bytes:
        got = self.others.get(word)
        if got is None:
            if len(self.others) > self.most // 8:
                self.others.clear()
            got = self.others[word] = self._word(word)
        return got

    def raw(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of ``dtype``; null texts have none."""
        out, kept = [], self.kept
        for text in texts:
            if not text:
                out.append(b"")
            elif any(x in text for x in _ODD):
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.array(found, dtype=self.dtype).tobytes())
            else:
                if len(kept) > self.most:
                    kept.clear()
                out.append(b"".join(map(kept.__getitem__, self._pieces(text))))
        return out

    @classmethod
    def of(cls, path: str, *, spaces: bool) -> Encoder:
        """The worker's own, kept from task to task."""
        if path not in _WORKERS:
            _WORKERS.clear()  # a worker's memory holds one
            released()
            _WORKERS[path] = cls(path, spaces=spaces, most=350_000 if spaces else 700_000)
        return _WORKERS[path]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype=self.dtype) for x in self.raw(texts)]
