"""Substring de-duplication by sliding sentence spans.

Around every sentence the shortest runs of consecutive sentences that are long
enough to matter are hashed, forwards from it and backwards to it; so a repeated
passage is covered whichever sentences stand around it.  Spans whose hash occurs more
than once are joined globally; sentences covered by any span that is not the first of its
kind are removed.

Spans of a text that lie as far from their first copies, word for word, make up one copied
region.  A passage that begins and ends inside sentences is found word by word around them: every
window of ``RUN_WORDS`` words that occurred before goes.  Windows inside a copied region go with
their sentences and are never first of their kind, so none of them is hashed.  The others are told
by the least hash of their short word runs, which equal windows share; only where that least
hash occurs more than once are the windows themselves hashed and joined, so none is missed.

Texts are taken apart many at once, character class by character class (numpy); ``sentences``
says what a sentence is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import written, written_by
from marquee.llm.shingles import slices

LEAST_SENTENCES, LEAST_WORDS = 2, 24  # a span has at least so many of both,
ALONE_WORDS = 40  # or so many words in one sentence
RUN_WORDS, SEED_WORDS = 50, 20  # a repeated run wherever it begins has so many words; words of a short run
BYTES_AT_ONCE = 1 << 20  # texts of so many bytes are taken apart together; a longer one comes alone

# A sentence, or a clause of one, ends after its marks and the white space that
# follows, or at a line's end.  Clauses keep the parts short, so that little of a passage
# is lost where it begins and ends within a sentence.
# Full-width marks end it wherever they stand: no white space follows them.
_MARKS, _FULL_WIDTH, _CLOSERS = ".!?…,;:", "。！？，、；：．｡､", "」』）】》〉”’"
_SENTENCE = re.compile(
    rf"[^\n{_MARKS}{_FULL_WIDTH}]*"
    rf"(?:[{_MARKS}]*[{_FULL_WIDTH}][{_MARKS}{_FULL_WIDTH}{_CLOSERS}]*|[{_MARKS}]+(?=\s|$)|[{_MARKS}]|\n|$)\s*"
)
# Where words are written without spaces between them, a character is a word: Thai to
# Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORDS = re.compile(rf"(?=\w)[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_CLOSED = re.compile(rf"[{_FULL_WIDTH}][{_MARKS}{_FULL_WIDTH}{_CLOSERS}]*$")


def sentences(text: str) -> list[str]:
    """Consecutive parts of ``text`` that together are all of it."""
    out, held = [], ""
    for m in _SENTENCE.finditer(text):
        part = held + m.group()
        # A mark inside a word or number does not end a sentence, but a full-width one does.
        if part and (part[-1].isspace() or m.end() == len(text) or _CLOSED.search(m.group())):
            out.append(part)
            held = ""
        else:
            held = part
    return out + [held] if held else out


_LETTER, _ALONE, _SPACE, _NEWLINE, _MARK, _FULL, _CLOSER, _WALL = range(1, 9)
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point (itself, where that is not one character)."""
    points = "".join(map(chr, range(0x110000)))
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for pattern, value in ((r"\w+", _LETTER), (rf"(?:(?=\w)[{_UNSPACED}])+", _ALONE), (r"\s+", _SPACE)):
        for m in re.finditer(pattern, points):
            kind[m.start() : m.end()] = value
    for characters, value in (("\n", _NEWLINE), (_MARKS, _MARK), (_FULL_WIDTH, _FULL), (_CLOSERS, _CLOSER)):
        kind[[ord(c) for c in characters]] = value
    for c in points:
        small = c.lower()
        if small != c and len(small) == 1:
            lower[ord(c)] = ord(small)
    return kind, lower


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _joined(x: np.ndarray, n: int, join) -> np.ndarray:
    """``join`` over every ``n`` neighbours, made of runs of doubling length."""
    out, held, size = None, 0, 1
    while True:
        if n & size:
            if out is None:
                out = x
            else:
                out = join(out[: max(len(out) - size, 0)], x[held : held + max(len(out) - size, 0)])
            held += size
        if held == n:
            return out
        x = join(x[: max(len(x) - size, 0)], x[size:])
        size *= 2


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of true values."""
    steps = np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def _holds(mask: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which stretches have a true value."""
    places = np.flatnonzero(mask)
    return np.searchsorted(places, end) > np.searchsorted(places, begin)


@dataclass
class _Parsed:
    """Words and sentences of several texts, as if they stood one after the other.

    Text ``r`` begins at character ``starts[r]``; it has the words ``word_rows[r]`` to ``word_rows[r + 1]``
    (hashed case aside, character by character) and the sentences ``sentence_rows[r]`` to ``sentence_rows[r + 1]``.
    """

    starts: np.ndarray
    begin: np.ndarray  # first character of each word,
    end: np.ndarray  # the one after it,
    words: np.ndarray  # and its hash
    word_rows: np.ndarray
    sentence_ends: np.ndarray
    sentence_rows: np.ndarray

    @cached_property
    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.words)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * np.cumprod(np.full(n, _BASE)), out=sums[1:])
        return sums, np.cumprod(np.full(n + 1, _INVERSE))

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words ``a`` to ``b`` (exclusive)."""
        sums, inverse = self._sums
        return _mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))


def _parse(texts: list[str]) -> _Parsed:
    kinds, lower = _characters()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[points]
    kind[starts[1:-1] - 1] = _WALL
    alone = kind == _ALONE
    begin, end = _stretches(kind == _LETTER)
    if alone.any():
        begin = np.sort(np.concatenate([begin, np.flatnonzero(alone)]))
        end = np.sort(np.concatenate([end, np.flatnonzero(alone) + 1]))
    sizes = end - begin
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)
    letters = lower[points[place + np.repeat(begin, sizes)]].astype(np.uint64)
    letters = _mixed((letters << _U(32)) + place.astype(np.uint64) + _U(1))
    words = _mixed(np.add.reduceat(letters, first)) if len(first) else np.zeros(0, np.uint64)
    # White space ends a sentence if a mark stands before it or a line ends in it.  Marks with a
    # full-width one among them end it by themselves.
    tail, tail_end = _stretches((kind == _MARK) | (kind == _FULL) | (kind == _CLOSER))
    tail_end = tail_end[_holds(kind == _FULL, tail, tail_end)]
    newline = kind == _NEWLINE
    space, space_end = _stretches(newline | (kind == _SPACE))
    after_mark = (kind[np.maximum(space - 1, 0)] == _MARK) & (space > 0)
    ends = space_end[_holds(newline, space, space_end) | after_mark | np.isin(space, tail_end)]
    ends = np.unique(np.concatenate([ends, tail_end[~np.isin(tail_end, space)], (starts[:-1] + lengths)[lengths > 0]]))
    return _Parsed(starts, begin, end, words, np.searchsorted(begin, starts), ends, np.searchsorted(ends, starts, side="right"))


def _found_spans(p: _Parsed, least_sentences: int, least_words: int, alone_words: int) -> tuple[np.ndarray, ...]:
    """row, first sentence, last sentence, first word, words (all within their text), hash of every span."""
    counts = np.diff(np.searchsorted(p.begin, p.sentence_ends), prepend=0)
    full = np.flatnonzero(counts)  # sentences without a word don't count
    at = np.concatenate([[0], np.cumsum(counts[full])])
    rows = np.searchsorted(full, p.sentence_rows)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    k = np.arange(len(full))
    several = np.minimum(k + least_sentences - 1, np.searchsorted(at, at[:-1] + alone_words) - 1)
    last = np.maximum(np.searchsorted(at, at[:-1] + least_words) - 1, several)
    forward = last < rows[row + 1]
    several = np.maximum(k - least_sentences + 1, np.searchsorted(at, at[1:] - alone_words, side="right") - 1)
    first = np.minimum(np.searchsorted(at, at[1:] - least_words, side="right") - 1, several)
    backward = first >= rows[row]
    n = len(full) + 1
    i, j = np.divmod(np.unique(np.concatenate([k[forward] * n + last[forward], first[backward] * n + k[backward]])), n)
    own = row[i] if len(i) else i
    return (own, full[i] - p.sentence_rows[own], full[j] - p.sentence_rows[own], at[i] - p.word_rows[own],
            at[j + 1] - at[i], p.hashes(at[i], at[j + 1]).view(np.int64))


def spans(text: str, least_sentences: int, least_words: int, alone_words: int) -> list[tuple[int, int, int]]:
    """(first sentence, last sentence, hash of the words) of every span."""
    _, first, last, _, _, found = _found_spans(_parse([text]), least_sentences, least_words, alone_words)
    return list(zip(first.tolist(), last.tolist(), found.tolist(), strict=True))


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _list(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """``values``, ascending by row, as one list for each of ``n`` rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


_SPAN = {"first": np.int32, "last": np.int32, "at": np.int64, "words": np.int64, "hash": np.int64}


def _spans_of(least_sentences: int, least_words: int, alone_words: int):
    """row, doc_id, n_sentences, spans from row, doc_id, text."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(2), BYTES_AT_ONCE):
                rows, doc_ids, texts = batch.slice(a, b - a).columns
                p = _parse(_texts(texts))
                own, *found = _found_spans(p, least_sentences, least_words, alone_words)
                fields = [pa.array(x.astype(t)) for x, t in zip(found, _SPAN.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows, doc_ids, pa.array(np.diff(p.sentence_rows).astype(np.int32)),
                     _list(own, b - a, pa.StructArray.from_arrays(fields, list(_SPAN)))],
                    names=["row", "doc_id", "n_sentences", "spans"],
                )

    return run


def _fields(lists: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row and fields of every struct in a column of lists; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def _in_copies(p: _Parsed, copied: pa.Array, run_words: int) -> np.ndarray:
    """For every word, whether the window that begins there lies in one copied region."""
    row, (at, words, of, there) = _fields(copied, ["at", "words", "from_row", "from_at"])
    order = np.lexsort((at, there - at, of, row))
    row, at, words, of, there = (x[order] for x in (row, at, words, of, there))
    same = np.zeros(len(row), bool)
    same[1:] = (np.diff(row) == 0) & (np.diff(of) == 0) & (np.diff(there - at) == 0)
    # Regions that follow each other without a gap are one; ends are compared within a group.
    group = np.cumsum(~same) * (len(p.words) + 1)
    reach = np.maximum.accumulate(group + at + words) if len(at) else at
    joined = same.copy()
    joined[1:] &= at[1:] + group[1:] <= reach[:-1]
    starts = np.flatnonzero(~joined)
    begin = (p.word_rows[row] + at)[starts]
    end = begin + np.maximum.reduceat(reach, starts) - (group + at)[starts] if len(starts) else begin
    steps = np.zeros(len(p.words) + 1, np.int64)
    long = end - begin >= run_words
    np.add.at(steps, begin[long], 1)
    np.add.at(steps, end[long] - run_words + 1, -1)
    return np.cumsum(steps)[:-1] > 0


def _windows(p: _Parsed, run_words: int, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows of ``run_words`` words that are not skipped, the least hash
    of a short run in each, and the least hashes' places, once for every place where one stands."""
    n, seed = len(p.words), min(SEED_WORDS, run_words)
    none = np.zeros(0, np.int64)
    if n < run_words:
        return none, none, none
    row = np.repeat(np.arange(len(p.word_rows) - 1), np.diff(p.word_rows))
    starts = np.arange(n - run_words + 1)
    held = (starts + run_words <= p.word_rows[row[starts] + 1]) & ~skipped[starts]
    short = np.arange(n - seed + 1)
    short = p.hashes(short, short + seed)
    width = run_words - seed + 1
    least = _joined(short, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    greatest = _joined(np.concatenate([edge, np.where(held, least, _U(0)), edge]), width, np.maximum)
    return starts[held], least[held].view(np.int64), np.flatnonzero((short == greatest) & (greatest > 0))


def _seeds_of(run_words: int):
    """row, seeds: the least hashes of each text's windows."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), BYTES_AT_ONCE):
                part = batch.slice(a, b - a)
                p = _parse(_texts(part.column(1)))
                _, _, places = _windows(p, run_words, _in_copies(p, part.column(2), run_words))
                found = p.hashes(places, places + min(SEED_WORDS, run_words)).view(np.int64)
                own = np.searchsorted(p.word_rows, places, side="right") - 1
                yield pa.RecordBatch.from_arrays([part.column(0), _list(own, b - a, pa.array(found))], ["row", "seeds"])

    return run


def _windows_of(run_words: int):
    """row, doc_id, at, hash of the windows with one of the repeated least hashes."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(2), BYTES_AT_ONCE):
                part = batch.slice(a, b - a)
                rows, doc_ids, texts, copied, again = part.columns
                p = _parse(_texts(texts))
                at, least, _ = _windows(p, run_words, _in_copies(p, copied, run_words))
                # What one text has and another's windows meet by chance is joined in vain, no more.
                at = at[np.isin(least, again.flatten().to_numpy(zero_copy_only=False))]
                own = np.searchsorted(p.word_rows, at, side="right") - 1
                for i in range(0, len(at), 1 << 16):
                    here, of = at[i : i + (1 << 16)], own[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [rows.take(pa.array(of)), doc_ids.take(pa.array(of)), pa.array(here - p.word_rows[of]),
                         pa.array(p.hashes(here, here + run_words).view(np.int64))], names=["row", "doc_id", "at", "hash"])

    return run


def _repeated_runs(texts: DataFrame, run_words: int) -> DataFrame:
    """row, starts: the windows of ``texts`` (row, doc_id, text, copied) outside copied regions that are
    not the first of their kind.  A window that overlaps the first one is no copy of it."""
    seeds = texts.select("row", "text", "copied").mapInArrow(_seeds_of(run_words), "row long, seeds array<long>")
    each = written(seeds, "seeds").select("row", F.explode("seeds").alias("seed"))
    often = written(each.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"), "often")
    # A text has no more seeds than words.
    again = each.join(often.hint("merge"), "seed").groupBy("row").agg(F.collect_set("seed").alias("again"))
    held = texts.join(written(again, "again").hint("merge"), "row").select("row", "doc_id", "text", "copied", "again")
    windows = held.mapInArrow(_windows_of(run_words), "row long, doc_id long, at long, hash long")
    windows = written(windows, "windows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")
    first = windows.groupBy("hash").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    first = written(first.select("hash", F.col("first.row").alias("of"), F.col("first.at").alias("from")), "first")
    copies = windows.join(first.hint("merge"), "hash").filter(
        (F.col("row") != F.col("of")) | (F.col("at") >= F.col("from") + run_words))
    return copies.groupBy("row").agg(F.collect_set("at").alias("starts"))


_AFTER = re.compile(r"[^\w\s]*\s*")


def cuts(p: _Parsed, row: int, text: str, removed: np.ndarray, starts: np.ndarray, run_words: int) -> list[tuple[int, int]]:
    """Character ranges of ``text`` that go, ascending and apart: the sentences ``removed`` and the windows
    at ``starts``, each with the marks and the white space after it."""
    zero = p.starts[row]
    ends = p.sentence_ends[p.sentence_rows[row] : p.sentence_rows[row + 1]] - zero
    begins = np.concatenate([[0], ends[:-1]])
    gone = list(zip(begins[removed].tolist(), ends[removed].tolist(), strict=True))
    if len(starts):
        starts = np.sort(starts) + p.word_rows[row]
        for group in np.split(starts, np.flatnonzero(np.diff(starts) > run_words) + 1):
            last = int(p.end[group[-1] + run_words - 1] - zero)
            gone.append((int(p.begin[group[0]] - zero), _AFTER.match(text, last).end()))
    out: list[tuple[int, int]] = []
    for a, b in sorted(gone):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(run_words: int):
    """doc_id, n_sentences, removed, cuts, clean_text from doc_id, text, n_sentences, removed, starts."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), BYTES_AT_ONCE):
                part = batch.slice(a, b - a)
                doc_ids, texts, counts, removed, starts = part.columns
                held = texts.to_pylist()
                touched = [i for i, t in enumerate(held) if t and (len(removed[i].values) or len(starts[i].values))]
                p = _parse([held[i] for i in touched])
                gone: list[list] = [[] for _ in held]
                for r, i in enumerate(touched):
                    text = held[i]
                    found = cuts(p, r, text, removed[i].values.to_numpy(), starts[i].values.to_numpy(), run_words)
                    gone[i] = [{"start": x, "end": y} for x, y in found]
                    edges = [0, *(e for c in found for e in c), len(text)]
                    held[i] = "".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                kept = pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, counts, removed, kept, pa.array(held, pa.string())],
                    names=["doc_id", "n_sentences", "removed", "cuts", "clean_text"])

    return run


def _pair(first: str, second: str) -> Column:
    """Two numbers from 0 to 2**31 - 1 as one long, ordered by the first, then the second."""
    return F.shiftleft(F.col(first).cast("long"), 32).bitwiseOR(F.col(second).cast("long"))


def _first(pair: str) -> Column:
    return F.shiftright(pair, 32)


def _second(pair: str) -> Column:
    return F.col(pair).bitwiseAND(F.lit(2**31 - 1))


def repeated_sentences(
    docs: DataFrame,
    least_sentences: int = LEAST_SENTENCES,
    least_words: int = LEAST_WORDS,
    alone_words: int = ALONE_WORDS,
    run_words: int = RUN_WORDS,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_sentences, removed (numbers of the sentences
    under a repeated span, from 0, ascending), cuts (all character ranges that go, ascending and
    apart), clean_text (what the cuts leave).

    Spans are equal when their words are, case aside.  The first of equal spans is that
    of the smallest doc_id (null last), then the earliest row and sentence; the same passage
    twice in one document counts as repeated.  Cuts are the sentences ``removed`` and every other run of
    ``run_words`` words or more that occurred before, wherever in a sentence it begins.  Null text stays null, with no sentence; texts too short
    for a span stay whole; of repeated rows the first keeps its text.  Other columns
    are ignored; an empty table gives no rows.  Rows are numbered while ``docs`` is read: it is a table in files,
    or else its rows come in the same order whenever a lost task reads them again.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Texts are moved and stored once, in buckets of their row: all that is found of them comes to their buckets.
    texts = written_by(rows, "texts", "row")
    schema = T.StructType([
        *rows.drop("text").schema.fields, T.StructField("n_sentences", T.IntegerType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField(n, T.IntegerType() if t is np.int32 else T.LongType()) for n, t in _SPAN.items()]))),
    ])
    made = written(texts.mapInArrow(_spans_of(least_sentences, least_words, alone_words), schema), "spans")
    # Every span is moved, so it is moved narrow: sentences and words of a text are fewer than 2**31.
    each = made.select("row", "doc_id", F.explode("spans").alias("s")).select(
        "row", "doc_id", "s.hash", _pair("s.first", "s.last").alias("sentences"), _pair("s.at", "s.words").alias("place"))
    often = each.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    often = written(often, "often")
    shared = written(each.join(often.hint("merge"), "hash"), "shared")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "sentences", "place")
    original = shared.groupBy("hash").agg(F.min(order).alias("o"))
    original = original.select("hash", F.col("o.row").alias("from_row"), _first("o.place").alias("from_at"))
    again = shared.select("hash", "row", "sentences", "place").join(written(original, "original").hint("merge"), "hash")
    again = again.select("row", _first("sentences").cast("int").alias("first"), _second("sentences").cast("int").alias("last"),
                         _first("place").alias("at"), _second("place").alias("words"), "from_row", "from_at")
    again = again.filter("row != from_row OR at != from_at")
    # A document has no more spans than its own text.
    copied = again.groupBy("row").agg(F.collect_list(F.struct("first", "last", "at", "words", "from_row", "from_at")).alias("copied"))
    none = F.array().cast("array<int>")
    removed = F.array_sort(F.array_distinct(F.flatten(F.transform("copied", lambda c: F.sequence(c["first"], c["last"])))))
    copied = written_by(made.select("row", "n_sentences").join(copied, "row", "left"), "copied", "row")
    texts = texts.join(copied.hint("merge"), "row")
    runs = written(_repeated_runs(texts.select("row", "doc_id", "text", "copied"), run_words), "repeated_runs")
    out = texts.join(runs.hint("merge"), "row", "left").select(
        "doc_id", "text", "n_sentences", F.coalesce(removed, none).alias("removed"),
        F.coalesce("starts", F.array().cast("array<long>")).alias("starts"))
    return out.mapInArrow(
        _without(run_words),
        "doc_id long, n_sentences int, removed array<int>, cuts array<struct<start:long,end:long>>, clean_text string")
