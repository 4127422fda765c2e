"""Token ids of whole texts, as packed bytes, by the tokenizers library.

A text is cut at blanks before it is encoded. The pre-tokenizer of the byte-level vocabularies starts
a new piece at every blank that a visible character follows, so no merge crosses such a place and
each stretch can be encoded alone; so can a line break between visible characters. Stretches repeat
a lot: Arrow numbers the distinct ones of a batch, each is looked up once, and Arrow lays their ids
out by text. A bounded cache keeps ids between batches. Texts with other white space take a slower
cut.
"""

from __future__ import annotations

import functools
import re
import string
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Stretches per generation of the cache; two generations take about 120 MB in a worker.
CACHED_STRETCHES = 260_000
ID_BYTES = 4
_CUT = re.compile(r" (?=\S)")
# Places where white space is more than a single blank or line break between visible characters.
_ODD = (
    r"\A[ \n]|[ \n]\z|  |\n\n| \n|\n |[\t\r\v\f\x1c-\x1f\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _byte_letters() -> dict[str, str]:
    """Latin-1 characters as byte-level vocabularies write their UTF-8: visible bytes as themselves.

    These characters are letters, digits or neither alike in every Unicode version; a text with
    others is left to the library's own pre-tokenizer.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {chr(c): "".join(byte[b] for b in chr(c).encode()) for c in range(256)}


class TextEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, one bytes object per text."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = [token.content for token in added]
        self._tokens = self._tokenizer.model.tokenize
        self._pieces = regex.compile(public_tokenizers.PATTERN).findall
        self._letters = _byte_letters()
        self._blank = self._letters[" "]
        self._packed = [_packed([i]) for i in range(max(self._tokenizer.get_vocab().values()) + 1)]
        self._newline = self._whole("\n")
        self._ids = _Cache(self._stretch)
        self._piece = _Cache(self._merged)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.large_string())).to_pylist()

    def encode_array(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text, with ``end`` behind them, as a binary array; a null text is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        # The library itself cuts out the strings of added tokens.
        added = np.zeros(len(texts), bool)
        for content in self._added:
            added |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) & ~added
        usual = ~(added | odd)
        ids = [
            self._usual(texts.filter(pa.array(usual))),
            _binary([self._odd(text) for text in texts.filter(pa.array(odd)).to_pylist()]),
            _binary([self._whole(text) for text in texts.filter(pa.array(added)).to_pylist()]),
        ]
        self._ids.turn()
        self._piece.turn()
        if usual.all():
            ids = ids[0]
        else:
            rows = np.concatenate([np.flatnonzero(own) for own in (usual, odd, added)])
            ids = pa.concat_arrays(ids).take(pa.array(np.argsort(rows)))
        if end:
            ids = pc.binary_join_element_wise(ids, pa.scalar(end, pa.large_binary()), _NOTHING)
        return ids.cast(pa.binary())

    def _usual(self, texts: pa.Array) -> pa.Array:
        if not len(texts):
            return _binary([])
        # Stretches follow a blank, or begin with a line break; the first of a text does neither.
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = parts.offsets.to_numpy()
        distinct = parts.values.dictionary_encode()
        names, numbers = distinct.dictionary, distinct.indices.to_numpy().copy()
        of_first = numbers[bounds[:-1]]
        uses = np.bincount(numbers, minlength=len(names))
        uses -= np.bincount(of_first, minlength=len(names))
        firsts = [self._split(first) for first in names.take(pa.array(of_first)).to_pylist()]
        place = np.cumsum(uses > 0) - 1
        numbers = place[numbers]
        numbers[bounds[:-1]] = (uses > 0).sum() + np.arange(len(texts))
        ids = self._stretches(names.filter(pa.array(uses > 0)))
        laid = pa.concat_arrays([ids, _binary(firsts)]).take(pa.array(numbers))
        # One behind the other as they are, only bounded by text.
        ends = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1)[bounds]
        buffers = [None, pa.py_buffer(ends), laid.buffers()[2]]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), buffers)

    def _odd(self, text: str) -> bytes:
        first, *rest = _CUT.split(text)
        return self._split(first) + b"".join([self._split(" " + s) for s in rest])

    def _stretches(self, stretches: pa.Array) -> pa.Array:
        """The ids of distinct stretches: a word's and those of the marks behind it, which are one piece."""
        words = pc.utf8_rtrim(stretches, characters=string.punctuation)
        marks = pc.utf8_ltrim(stretches, characters=_LETTERS)
        size, of_words, of_marks = map(pc.binary_length, (stretches, words, marks))
        plain = pc.and_(pc.greater(of_words, 0), pc.equal(pc.add(of_words, of_marks), size))
        words = pc.if_else(plain, words, stretches).dictionary_encode()
        marks = pc.if_else(plain, marks, "").dictionary_encode()
        of_words = self._ids.of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        of_marks = [self._piece[m] if m else b"" for m in marks.dictionary.to_pylist()]
        return pc.binary_join_element_wise(
            _binary(of_words).take(words.indices), _binary(of_marks).take(marks.indices), _NOTHING
        )

    def _stretch(self, stretch: str) -> bytes:
        if stretch.isalpha():
            if stretch.isascii():
                return self._tokens_of(self._blank + stretch)
            return self._merged(" " + stretch)
        if stretch[0] == "\n":
            return self._newline + self._split(stretch[1:])
        return self._split(" " + stretch)

    def _split(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(text)
        piece = self._piece
        return b"".join([piece[p] for p in self._pieces(text)])

    def _merged(self, piece: str) -> bytes:
        try:
            letters = "".join(map(self._letters.__getitem__, piece))
        except KeyError:
            return self._whole(piece)
        return self._tokens_of(letters)

    def _tokens_of(self, letters: str) -> bytes:
        packed = self._packed
        return b"".join([packed[t.id] for t in self._tokens(letters)])

    def _whole(self, text: str) -> bytes:
        return _packed(self._tokenizer.encode(text, add_special_tokens=False).ids)


class _Cache(dict):
    """Ids by stretch; when full it becomes the older generation, whose hits move up again."""

    def __init__(self, encode):
        super().__init__()
        self._encode, self._older = encode, {}

    def __missing__(self, stretch: str) -> bytes:
        ids = self._older.get(stretch)
        if ids is None:
            ids = self._encode(stretch)
        self[stretch] = ids
        return ids

    def of(self, stretches: list[str]) -> list[bytes]:
        """The ids of distinct stretches."""
        found, older, encode = list(map(self.get, stretches)), self._older.get, self._encode
        for i, ids in enumerate(found):
            if ids is None:
                stretch = stretches[i]
                self[stretch] = found[i] = older(stretch) or encode(stretch)
        return found

    def turn(self) -> None:
        if len(self) > CACHED_STRETCHES:
            self._older = dict(self)
            self.clear()


# Letters of Latin-1.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_NOTHING = pa.scalar(b"", pa.large_binary())


def _binary(ids: list[bytes]) -> pa.Array:
    return pa.array(ids, pa.large_binary())


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> TextEncoder:
    """One encoder and its cache per worker process."""
    return TextEncoder(vocabulary)


def release_encoders() -> None:
    """Free the caches: for work of another kind, in a worker that has encoded before."""
    encoder.cache_clear()
