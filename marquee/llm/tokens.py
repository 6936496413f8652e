"""Token ids of whole texts with a public tokenizer file (inside Spark tasks)."""

from __future__ import annotations

import functools
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marquee.llm.shingles import slices

# A single space between two characters that are not white space always starts a
# new pre-token in the tokenizers used here, so a text may be encoded piece by piece.
_PIECES = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
# Where not every single space is a cut (for Arrow's expressions, which have no look-around).
_UNEVEN = "\\A | \\z| [ {0}]|[{0}] ".format("".join(f"\\x{{{ord(c):x}}}" for c in _OTHER_SPACE))
_LINE = re.compile(r"(?<=[A-Za-z.,;:!?])\n(?=[A-Za-z])")
_LINE_AROUND = r"([A-Za-z.,;:!?])\n([A-Za-z])"
BYTES_AT_ONCE = 8 << 20
CACHE_LIMIT = 400_000  # words used of late that one Python worker remembers; up to as many older ones


def split_pieces(text: str) -> list[str]:
    """The pieces of ``text`` between its cuts, without the spaces there."""
    pieces = text.split(" ")
    even = "" not in pieces and not any(c in text and (f" {c}" in text or f"{c} " in text) for c in _OTHER_SPACE)
    return pieces if even else _PIECES.split(text)


class _Pieces(dict):
    """piece -> little-endian unsigned 32-bit ids, encoded when first seen."""

    def __init__(self, tokenizer, prefix: str, head: _Pieces | None = None):
        super().__init__()
        self.tokenizer, self.prefix, self.model = tokenizer, prefix, tokenizer.model
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.pre_tokenize = tokenizer.pre_tokenizer.pre_tokenize_str
        # How the prefix is written before a word of ASCII letters, and whether case counts.
        letter = self.normalize(prefix + "A")
        self.written, self.folds = self.pre_tokenize(letter)[0][0][:-1], letter.endswith("a")
        self.old: dict[str, bytes] = {}
        self.marks = self._marks()
        self.letters = self._letters()
        plain = f"[A-Za-z{''.join(map(chr, self.letters))}]"
        self.plain = re.compile(f"{plain}+").fullmatch
        self.marked = rf"\A(?P<word>(?s:.*){plain})(?P<run>[{re.escape(self.marks)}]+)\z"
        # Between two other characters a line break is a pre-token of its own, or none, and no word after it has a prefix.
        self.head = self if head is None else head
        whole = tokenizer.encode("a\nb", add_special_tokens=False).ids
        self.line = array("I", whole[1:-1]).tobytes() if len(whole) in (2, 3) else None

    def _marks(self) -> str:
        """Marks of which any run after a letter is split from it, and is in no special token."""
        special = {c for token in self.tokenizer.get_added_tokens_decoder().values() for c in token.content}

        def parts(text):
            return [part for part, _ in self.pre_tokenize(self.normalize(text))]

        marks = [c for c in string.punctuation if c != "'" and c not in special]
        return "".join(c for c in marks if parts(f"a{c}") == parts("a") + parts(c))

    def _letters(self) -> dict[int, str]:
        """Accented Latin letters that are written alike in any word, and how (with the capitals that are folded)."""
        out = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} if self.folds else {}
        for c in filter(str.isalpha, map(chr, range(0xC0, 0x250))):
            word = self.pre_tokenize(self.normalize(f"a{c}b"))
            if len(word) == 1 and (within := re.fullmatch("a(.+)b", word[0][0])):
                first = self.pre_tokenize(self.normalize(f"{self.prefix}{c}b"))
                if len(first) == 1 and first[0][0] == f"{self.written}{within[1]}b":
                    out[ord(c)] = within[1]
        return out

    def _ids(self, parts: list[str]) -> bytes:
        return array("I", [token.id for part in parts for token in self.model.tokenize(part)]).tobytes()

    def _encode(self, piece: str) -> bytes:
        """The tokenizer's own steps without the record of offsets that a whole
        call makes; special tokens (``<...>``) are left to the whole call."""
        if self.plain(piece):
            return self._ids([self.written + piece.translate(self.letters)])
        if "<" in piece:
            return array("I", self.tokenizer.encode(self.prefix + piece, add_special_tokens=False).ids).tobytes()
        return self._ids([part for part, _ in self.pre_tokenize(self.normalize(self.prefix + piece))])

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece.isascii() and piece.isalpha():
                word = self.written + (piece.lower() if self.folds else piece)
                ids = array("I", [token.id for token in self.model.tokenize(word)]).tobytes()
            elif (word := piece.rstrip(self.marks)) != piece and self.plain(word[-1:]):
                return self[word] + self.head[piece[len(word) :]]
            elif self.line is not None and "\n" in piece and "<" not in piece and _LINE.search(piece):
                first, *lines = _LINE.split(piece)
                return self.line.join([self[first], *map(self.head.__getitem__, lines)])
            else:
                ids = self._encode(piece)
        if len(self) >= CACHE_LIMIT:
            self.old = dict(self)
            self.clear()
        if len(piece) < 100:
            self[piece] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def all_of(self, pieces: pa.Array) -> pa.Array:
        """The ids of many pieces, each word of them looked up once."""
        cut = pc.extract_regex(pieces, self.marked)
        words = pc.coalesce(pc.struct_field(cut, "word"), pieces).dictionary_encode()
        runs = pc.fill_null(pc.struct_field(cut, "run"), "").dictionary_encode()
        return pc.binary_join_element_wise(_taken(self, words), _taken(self.head, runs), pa.scalar(b"", pa.large_binary()))


def _taken(known: _Pieces, coded: pa.DictionaryArray) -> pa.Array:
    pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return pa.array([*map(known.__getitem__, pieces)], pa.large_binary()).take(coded.indices)


class Encoder:
    """Exactly the ids that the tokenizer gives for a whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.head = _Pieces(tokenizer, "")
        self.tail = _Pieces(tokenizer, " ", self.head)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        pieces = split_pieces(text)
        return self.head[pieces[0]] + b"".join(map(self.tail.__getitem__, pieces[1:]))

    def forget(self) -> None:
        """Drop the memory of words; Spark keeps a worker, and what it holds, for later tasks of any kind."""
        self.tail.forget()
        self.head.forget()
        pa.default_memory_pool().release_unused()

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of every text (null: empty) in order; a word is looked up once in some megabytes of text."""
        for a, b in slices(texts, BYTES_AT_ONCE):
            part = pc.fill_null(texts.slice(a, b - a), "")
            odd = pc.match_substring_regex(part, _UNEVEN)
            even = pc.if_else(odd, "", part)
            if self.tail.line is not None:
                # A piece that begins with a line break is a word after it: no space of an even text is beside one.
                lines = pc.replace_substring_regex(even, _LINE_AROUND, "\\1 \n\\2")
                even = pc.if_else(pc.match_substring(even, "<"), even, lines)
            pieces = pc.split_pattern(even, " ")
            starts = pieces.offsets.to_numpy()
            coded = pieces.flatten().dictionary_encode()
            index, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            # Each text's first piece has no space before it, neither has one after a line break.
            heads = distinct.take(pa.array(index[starts[:-1]]))
            index[starts[:-1]] = len(distinct) + np.arange(b - a)
            breaks = pc.starts_with(distinct, "\n")
            after = self.head.all_of(pc.utf8_slice_codeunits(distinct.filter(breaks), 1))
            after = pc.binary_join_element_wise(
                pa.scalar(self.tail.line or b"", pa.large_binary()), after, pa.scalar(b"", pa.large_binary()))
            rows = np.argsort(breaks.to_numpy(zero_copy_only=False), kind="stable")
            known = pa.concat_arrays([self.tail.all_of(distinct.filter(pc.invert(breaks))), after])
            known = known.take(pa.array(np.argsort(rows)))
            ids = pa.concat_arrays([known, self.head.all_of(heads)]).take(pa.array(index))
            _, ends, data = ids.buffers()
            ends = np.frombuffer(ends, np.int64)[starts].tolist()
            data = memoryview(b"" if data is None else data)
            for i, uneven in enumerate(odd.to_pylist()):
                yield self.encode(part[i].as_py()) if uneven else bytes(data[ends[i] : ends[i + 1]])


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file; a task that is done lets it ``forget`` its words."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
