"""Phrases whose words stand together more often than their parts suggest.

Best-first branch and bound over prefixes.  A node is a prefix that occurs often enough; growing
it by one word counts its continuations in one pass over the texts.  Whatever grows from a prefix p
can be cut after p's first word, and what follows that cut is at least as frequent as the whole, so

    score <= floor(1000 * n / f(first word of p))

holds for all of them.  Rounds grow the open nodes with the best bounds; a node whose bound is below
the score that is now a language's ``top``-th among surviving, exactly scored phrases can
never reach the result and is closed.  Nodes at exactly that score stay open, for ties.  The first
round leaves out the words that hold more than one ``HEAVY``-th of a language (fewer than ``HEAVY`` of
them): their bounds are the lowest, and they are grown only if they stay open.

A phrase that is always preceded (or always followed) by one word lies in a longer candidate that is
as frequent, and only then; so the least and largest neighbour seen, as 64-bit hashes, tell what is dropped.
They are gathered while a phrase is grown; a phrase that is not grown is out of reach itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import written

LONGEST = 5  # words of a phrase
HEAVY = 100
CHUNK = 4 << 20  # bytes of text that a task looks at together
FILTER_BITS = 1 << 26  # at most, 8 MB; beyond it filters let more through, and results stay the same
LANES = 8  # a language's ranking is cut to `top` rows in so many lanes first

_SPACE, _BREAK = 32, 10
_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
_FOLD[9] = _SPACE
for _mark in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_mark] = _BREAK
_FOLD = bytes(_FOLD)
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _hashes(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Filter:
    """Set of hashes as a bit table: no member is ever missed; others may pass."""

    def __init__(self, bits: int):
        self.bits = bits
        self.table = np.zeros(bits // 64, np.uint64)

    @staticmethod
    def places(h: np.ndarray, bits: int):
        yield h & np.uint64(bits - 1)
        yield (h >> np.uint64(32)) & np.uint64(bits - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.places(h, self.bits):
            found &= (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def phrase_filters(rows: DataFrame) -> dict[tuple[str, int], Filter]:
    """A filter for each (kind, words) of the rows (kind, words, lang, phrase): 16 bits a row, ``FILTER_BITS``
    at most.  Only set words of 64 bits reach the driver."""
    sizes = {}
    for row in rows.groupBy("kind", "words").count().collect():
        bits = 1 << 12
        while bits < min(16 * row["count"], FILTER_BITS):
            bits *= 2
        sizes[row.kind, row.words] = bits

    def run(batches):
        for batch in batches:
            kinds, lengths, langs, phrases = (batch.column(i).to_pylist() for i in range(4))
            of = {}
            for i, key in enumerate(zip(kinds, lengths, strict=True)):
                of.setdefault(key, []).append(i)
            for (kind, length), at in of.items():
                split = [phrases[i].encode().split(b" ") for i in at]
                h = _hashes([langs[i].encode() for i in at])
                for j in range(length):
                    h = _mix(h, _hashes([p[j] for p in split]))
                places = np.concatenate(list(Filter.places(h, sizes[kind, length])))
                yield pa.RecordBatch.from_arrays([
                    pa.array([kind] * len(places)), pa.array([length] * len(places), pa.int32()),
                    pa.array((places >> np.uint64(6)).astype(np.int64)),
                    pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64)),
                ], names=["kind", "words", "place", "bits"])

    filters = {key: Filter(bits) for key, bits in sizes.items()}
    if filters:
        bits = rows.select("kind", "words", "lang", "phrase").mapInArrow(run, "kind string, words int, place long, bits long")
        bits = bits.groupBy("kind", "words", "place").agg(F.bit_or("bits").alias("bits")).toArrow()
        for (kind, length), made in filters.items():
            mine = bits.filter((pc.field("kind") == kind) & (pc.field("words") == length))
            made.table[mine["place"].to_numpy()] = mine["bits"].to_numpy().view(np.uint64)
    return filters


class Chunk:
    """Words of some texts: codes into ``words`` in text order, with piece and language of each."""

    def __init__(self, texts: list[bytes], langs: list[bytes]):
        data = np.frombuffer(b"\n".join(texts).translate(_FOLD), np.uint8)
        breaks = data == _BREAK
        inside = ~(breaks | (data == _SPACE))
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        content = data[inside]
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(content)])
        encoded = words.dictionary_encode()
        self.words = encoded.dictionary
        self.codes = encoded.indices.to_numpy().astype(np.int64)
        self.piece = np.searchsorted(np.flatnonzero(breaks), starts)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        known = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        self.langs = list(known)
        of_text = np.array([known[x] for x in langs], np.int64)
        self.lang = of_text[np.searchsorted(bounds, starts, side="right")]

    def hashed(self):
        """Hash of each word, for filters and neighbours."""
        self.lang_hash = _hashes(self.langs)
        self.hash = _hashes(self.words.to_pylist())[self.codes]

    def phrase_hash(self, at: np.ndarray, length: int) -> np.ndarray:
        h = self.lang_hash[self.lang[at]]
        for j in range(length):
            h = _mix(h, self.hash[at + j])
        return h

    def groups(self, at: np.ndarray, length: int):
        """Exact groups of the phrases that begin at ``at``: first member, and
        the positions in group order with each group's start."""
        key, width = self.lang[at], len(self.words)
        for j in range(length):
            if j > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * width + self.codes[at + j]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return at[order], first

    def texts_of(self, at: np.ndarray, length: int) -> pa.Array:
        words = [self.words.take(pa.array(self.codes[at + j])) for j in range(length)]
        joined = words[0] if length == 1 else pc.binary_join_element_wise(*words, b" ")
        return joined.cast(pa.string())

    def langs_of(self, at: np.ndarray) -> pa.Array:
        return pa.array([x.decode() for x in self.langs], pa.string()).take(pa.array(self.lang[at]))


def _chunks(batches):
    for batch in batches:
        texts, langs, held = [], [], 0
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
            langs.append(lang.as_py().encode())
            held += len(texts[-1])
            if held >= CHUNK:
                yield Chunk(texts, langs)
                texts, langs, held = [], [], 0
        if held:
            yield Chunk(texts, langs)


def _count_words(batches):
    for chunk in _chunks(batches):
        at, first = chunk.groups(np.arange(len(chunk.codes)), 1)
        counts = np.diff(np.append(first, len(at)))
        yield pa.RecordBatch.from_arrays(
            [chunk.langs_of(at[first]), chunk.texts_of(at[first], 1), pa.array(counts)], names=["lang", "phrase", "a"]
        )


SIDES = ["l_min", "l_max", "r_min", "r_max"]
COUNTED = "lang string, phrase string, words int, a long, " + ", ".join(f"{x} long" for x in SIDES)


def _count_phrases(frequent: Filter, filters: dict[tuple[str, int], Filter]):
    """Counts (``a``) of one-word continuations of the nodes to ``grow`` (filters by kind and number of words) and of
    the phrases to ``count``; and for nodes of two words or more, with ``a`` 0, the least and largest hash of the
    neighbours on both sides (both ends of the range where an occurrence has none)."""

    def counted(chunk, at, length, sides=None):
        at, first = chunk.groups(at, length)
        counts = np.zeros(len(first), np.int64) if sides else np.diff(np.append(first, len(at)))
        seen = [pa.nulls(len(first), pa.int64())] * 4
        if sides:
            follows, near = sides
            last = len(near) - 1
            left = follows[at], near[np.maximum(at - 1, 0)]
            right = follows[at + length], near[np.minimum(at + length, last)]
            seen = [pa.array(pick.reduceat(np.where(there, value, end), first))
                    for there, value in (left, right) for pick, end in ((np.minimum, _LOW), (np.maximum, _HIGH))]
        rows = at[first]
        return pa.RecordBatch.from_arrays(
            [chunk.langs_of(rows), chunk.texts_of(rows, length), pa.array(np.full(len(rows), length, np.int32)),
             pa.array(counts), *seen], names=["lang", "phrase", "words", "a", *SIDES])

    def run(batches):
        for chunk in _chunks(batches):
            chunk.hashed()
            size = len(chunk.codes)
            follows = np.zeros(size + 1, bool)  # word i belongs to the piece of word i - 1
            follows[1:size] = chunk.piece[1:] == chunk.piece[:-1]
            often = frequent.has(chunk.phrase_hash(np.arange(size), 1))
            at = np.flatnonzero(often)
            for length in range(1, LONGEST):
                # at: where `length` frequent words stand in one piece
                longer = at[follows[at + length]]
                longer = longer[often[longer + length]]
                chosen = np.zeros(len(longer), bool)
                if node := filters.get(("grow", length)):
                    grown = node.has(chunk.phrase_hash(at, length))
                    if length > 1 and grown.any():
                        yield counted(chunk, at[grown], length, (follows, chunk.hash.view(np.int64)))
                    chosen[np.searchsorted(longer, at[grown & np.isin(at, longer, assume_unique=True)])] = True
                if part := filters.get(("count", length + 1)):
                    chosen |= part.has(chunk.phrase_hash(longer, length + 1))
                if chosen.any():
                    yield counted(chunk, longer[chosen], length + 1)
                at = longer

    return run


def _quotient(a, n, l, r):  # noqa: E741 - the names of the score's definition
    """floor(1000 * a * n / (l * r)), exact: products in 38 digits."""
    a, n, l, r = (x.cast("decimal(19,0)") for x in (a, n, l, r))  # noqa: E741
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * a * n, l * r)


def _cuts(phrases: DataFrame) -> DataFrame:
    """lang, phrase, k, head, tail: the ways to cut a phrase in two."""
    return phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.lit(LONGEST)), " ").alias("tail"),
    )


def _scored(found: DataFrame, counts: DataFrame, langs: DataFrame) -> DataFrame:
    """Per phrase its best possible score and the cut that gives it, ``exact`` where all parts are
    counted.  A part that is not counted yet is taken to be as frequent as the phrase: it is at least."""
    part = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = _cuts(found)
    cuts = cuts.join(part.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"], "left")
    cuts = cuts.join(part.withColumnsRenamed({"part": "tail", "f": "r"}), ["lang", "tail"], "left")
    cuts = cuts.join(langs.select("lang", "n"), "lang")
    cuts = cuts.withColumn("score", _quotient(F.col("a"), F.col("n"), F.coalesce("l", "a"), F.coalesce("r", "a")))
    best = F.min(F.struct("score", "k", "l", "r"))
    unknown = F.array_compact(F.flatten(F.collect_list(F.array(
        F.when(F.col("l").isNull(), F.col("head")), F.when(F.col("r").isNull(), F.col("tail"))))))
    return cuts.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), best.alias("best"), unknown.alias("unknown")
    ).select("lang", "phrase", "a", "n", "best.*", "unknown", (F.size("unknown") == 0).alias("exact"))


def _first_rows(scored: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` rows with ``rank``; lanes are cut first, so no
    task sees more than ``LANES * top`` rows a language besides those of its own lane."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    lane = F.pmod(F.xxhash64("phrase"), F.lit(LANES))
    kept = scored.withColumn("lane", lane).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order)))
    kept = kept.filter(F.col("rank") <= top)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(
        F.col("rank") <= top).drop("lane")


def collocations(documents: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Words are runs of other than spaces and tabs, A-Z lower-cased, in pieces between ``. , ; : ! ?`` and line breaks.
    Phrases have 2 to 5 words and ``least`` occurrences or more in their language (overlaps count).  The
    score is the least of ``floor(1000 a n / (l r))`` over the cuts in two, ties to the
    first cut; phrases inside a longer one that is as frequent are dropped.  Order: score and
    a descending, phrase ascending by UTF-8 bytes; exactly ``top`` rows where ties cross the end.

    A null language is ``und``; null and empty texts have no words but repeated rows count
    each time.  Other columns are ignored; no words give no rows.  Texts are read whole.
    """
    texts = documents.select("text", F.coalesce(F.col("lang"), F.lit("und")).alias("lang"))
    counted = texts.mapInArrow(_count_words, "lang string, phrase string, a long")
    words = written(counted.groupBy("lang", "phrase").agg(F.sum("a").alias("a")), "words")
    langs = written(words.groupBy("lang").agg(F.sum("a").alias("n")), "langs")
    words = words.filter(F.col("a") >= least)
    bound = F.call_function("div", F.col("n") * 1000, F.col("first")).alias("bound")
    frequent = phrase_filters(words.select(F.lit("word").alias("kind"), F.lit(1).alias("words"), "lang", "phrase"))
    frequent = frequent.get(("word", 1), Filter(64))
    counts = words.select("lang", "phrase", "a")
    first = words.select("lang", F.col("phrase").alias("word"), F.col("a").alias("first"))
    nodes = first.join(langs, "lang").withColumn("heavy", F.col("first") * HEAVY > F.col("n"))
    nodes = nodes.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), bound, "heavy")
    # The best bounds first; the heavy words wait until there is a score to reach.
    todo = nodes.filter("NOT heavy").select(F.lit("grow").alias("kind"), "words", "lang", "phrase")
    waiting = nodes.filter("heavy").drop("heavy")
    found = scored = None
    lasting = words.select("lang", "phrase").filter("false")
    while True:
        filters = phrase_filters(todo)
        if not filters and waiting is not None:  # all frequent words are heavy
            todo, waiting = waiting.select(F.lit("grow").alias("kind"), "words", "lang", "phrase"), None
            continue
        if not filters:
            break
        rows = texts.mapInArrow(_count_phrases(frequent, filters), COUNTED)
        rows = rows.groupBy("lang", "phrase", "words").agg(
            F.sum("a").alias("a"), *[getattr(F, x[2:])(x).alias(x) for x in SIDES])
        rows = written(rows.filter((F.col("a") >= least) | F.col("l_min").isNotNull()), "counted")
        mixed = (F.col("l_min") < F.col("l_max")) & (F.col("r_min") < F.col("r_max"))
        lasting = lasting.union(rows.filter(mixed).select("lang", "phrase"))
        new = rows.filter(F.col("a") >= least).select("lang", "phrase", "words", "a")
        # What is counted in two rounds has the same count in both.
        new = written(new.join(counts, ["lang", "phrase"], "left_anti"), "phrases")
        counts = counts.union(new.select("lang", "phrase", "a"))
        found = new if found is None else found.union(new)
        survivors = found.filter(F.col("words") < LONGEST).join(lasting, ["lang", "phrase"], "left_semi")
        survivors = survivors.union(found.filter(F.col("words") == LONGEST))
        scored = written(_scored(survivors, counts, langs), "scored")
        # The score that has to be reached: 0 until a language has `top` phrases.
        last = _first_rows(scored.filter("exact"), top).filter(F.col("rank") == top)
        reached = langs.join(last.select("lang", "score"), "lang", "left")
        reached = reached.select("lang", "n", F.coalesce("score", F.lit(0)).alias("reached"))
        children = new.filter(F.col("words") < LONGEST).withColumn("word", F.substring_index("phrase", " ", 1))
        children = children.join(first, ["lang", "word"]).join(langs, "lang").select("lang", "phrase", "words", bound)
        if waiting is not None and any(length > 1 for _, length in filters):  # there may be a score to reach now
            children, waiting = children.union(waiting), None
        grow = children.join(reached, "lang").filter("bound >= reached").select(
            F.lit("grow").alias("kind"), "words", "lang", "phrase")
        parts = scored.filter("NOT exact").join(reached.drop("n"), "lang").filter("score >= reached")
        parts = parts.select("lang", F.explode("unknown").alias("phrase")).distinct()
        count = parts.select(F.lit("count").alias("kind"), F.size(F.split("phrase", " ")).alias("words"), "lang", "phrase")
        todo = written(grow.union(count), "todo")
    if scored is None:
        empty = "lang string, phrase string, a long, l long, r long, n long, score long, exact boolean"
        scored = texts.sparkSession.createDataFrame([], empty)
    return _first_rows(scored.filter("exact"), top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM listed, (SELECT unnest(range(1, 6)) AS m) lengths WHERE len(w) >= m) places),
counted AS MATERIALIZED (
  SELECT lang, m, phrase, count(*)::BIGINT AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
kept AS MATERIALIZED (
  SELECT * FROM counted c WHERE m >= 2 AND NOT EXISTS (
    SELECT 1 FROM counted o WHERE o.lang = c.lang AND o.m > c.m AND 100 * o.f >= 100 * c.f
      AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(list_slice(w, 1, k), ' ') AS head,
         array_to_string(list_slice(w, k + 1, m), ' ') AS tail
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM kept) split),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, s.n,
         ((1000::HUGEINT * c.a * s.n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head
       JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail JOIN sizes s ON s.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
         phrase, a, l, r, n, score
  FROM best WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
