"""Whole-text encoding with a public byte-level tokenizer, remembering words.

The tokenizer file cuts a text with a fixed pattern before it merges bytes, so
the ids of a text are the ids of its pre-tokens in a row.  Each distinct
pre-token goes through the tokenizers library once per Python worker; repeats
come from a bounded dictionary.  Texts are cut at single spaces first (a space
between two non-blanks always starts a new pre-token); a text holding a blank
after a space goes to the library whole.

Edge cases: a null text is the empty text and has no ids.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

# Fixed value: the pre-token pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "byte_bpe_50k.json"
REMEMBERED = 150_000
_AFTER_SPACE = re.compile(r"^ | (?=\s|$)")
#: Marks that often end a word.
_ENDS = list(".,;:!?")
_PAIRS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c", " \x1c", " \x1d", " \x1e", " \x1f")
#: Blanks beyond ASCII.
_BLANKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The vocabulary file writes bytes as letters: printable ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: 256 + n for n, b in enumerate(hidden)}


class Remembered:
    """A dictionary of two generations: what is not asked for again goes."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def values(self, keys: list[str], make) -> list[bytes]:
        """The value of every key; make() gives those that are not remembered."""
        if len(self.now) > self.most:
            self.old, self.now = self.now, {}
        now, old = self.now, self.old
        found = list(map(now.get, keys))
        for i, v in enumerate(found):
            if v is None:
                k = keys[i]
                v = old.get(k)
                if v is None:
                    v = make(k)
                found[i] = now[k] = v
        return found


class WordEncoder:
    """ids of texts as little-endian unsigned 16-bit bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("this encoder holds vocabularies of at most 65,536 ids")
        self.merge = self.library.model.tokenize
        self.letters = _byte_letters()
        self.cut = regex.compile(PATTERN).findall
        self.words = Remembered(remembered)
        self.others = Remembered(remembered // 4)
        self.bits: dict[str, bytes] = {}
        self.ends = [self._piece(c) for c in _ENDS]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u2").tobytes() for x in found]

    def _piece(self, piece: str) -> bytes:
        """One pre-token through the library's merge model."""
        if piece.isascii() and piece.isprintable():
            letters = "Ġ" + piece[1:] if piece[0] == " " else piece
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("H", [x.id for x in self.merge(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        """A word after a space."""
        return self._piece(" " + word)

    def _other(self, chunk: str) -> bytes:
        """Whatever else stands after a space."""
        return b"".join([self._bit(p) for p in self.cut(" " + chunk)])

    def _bit(self, piece: str) -> bytes:
        """A pre-token, remembered."""
        got = self.words.now.get(piece[1:]) if piece[0] == " " else self.bits.get(piece)
        if got is None:
            got = self._piece(piece)
            if piece[0] != " ":
                if len(self.bits) > self.others.most:
                    self.bits.clear()
                self.bits[piece] = got
        return got

    @staticmethod
    def _splits(text: str) -> bool:
        """Whether every space of a text stands before a non-blank and after the start."""
        if text[0] == " " or text[-1] == " " or "<|endoftext|>" in text:
            return False
        if any(pair in text for pair in _PAIRS):
            return False
        return text.isascii() or not any(c in text for c in _BLANKS) or not _AFTER_SPACE.search(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One bytes object of ids (2 bytes each) per text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[bytes] = [b""] * len(texts)
        split = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self._splits(text):
                split.append(i)
            else:
                out[i] = self.whole([text])[0]
        if not split:
            return out
        lists = pc.split_pattern(pa.array([texts[i] for i in split], pa.string()), " ")
        begins = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        codes, chunks = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # a chunk is a word, a word and one mark, or something else
        marks = pc.index_in(pc.utf8_slice_codeunits(chunks, -1, None), pa.array(_ENDS)).to_numpy(zero_copy_only=False)
        marked = ~np.isnan(marks)
        words = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        plain = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        unique = words.filter(pa.array(plain)).dictionary_encode()
        known = self.words.values(unique.dictionary.to_pylist(), self._word)
        other = np.flatnonzero(~plain)
        rest = self.others.values(chunks.take(pa.array(other)).to_pylist(), self._other)
        firsts = chunks.take(pa.array(codes[begins])).to_pylist()
        heads = [b"".join([self._bit(p) for p in self.cut(c)]) for c in firsts]  # no space stands before the first chunk
        # each chunk as two values: itself or its word, and its mark or nothing
        values = [b"", *self.ends, *known, *rest, *heads]
        one, two = np.zeros(len(chunks) + len(heads), np.int64), np.zeros(len(chunks) + len(heads), np.int64)
        at = 1 + len(self.ends)
        one[np.flatnonzero(plain)] = at + unique.indices.to_numpy()
        one[other] = at + len(known) + np.arange(len(other))
        one[len(chunks):] = at + len(known) + len(rest) + np.arange(len(heads))
        two[:len(chunks)] = np.where(marked & plain, np.nan_to_num(marks) + 1, 0).astype(np.int64)
        codes[begins] = np.arange(len(chunks), len(chunks) + len(heads))
        codes = np.stack([one[codes], two[codes]], 1).ravel()
        begins = begins.astype(np.int64) * 2
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 2
        flat = np.frombuffer(b"".join(values), "<u2")
        starts = np.cumsum(sizes) - sizes
        own = sizes[codes]
        ends = np.cumsum(own)
        ids = flat[np.arange(int(ends[-1])) + np.repeat(starts[codes] - (ends - own), own)]
        cuts = np.append(ends[begins] - own[begins], ends[-1]) * 2
        raw = ids.tobytes()
        for i, lo, hi in zip(split, cuts[:-1].tolist(), cuts[1:].tolist()):
            out[i] = raw[lo:hi]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path)
