"""License scan by conditional compression.

A text's sentences that mention licensing are candidate blocks.  Each block, in windows of bounded
length, is compressed alone and with every license template as a raw zstandard dictionary.  The templates that
save something are the winners, and only they are confirmed, in the order of what they save, by their
wording: all of a template's words stand in and around the window, in order and together, but for a
stated share of differences, none of them in the identifying words (names and versions), and no negation before.
"""

from __future__ import annotations

import difflib
import functools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.license_texts import FORMS, NAME_WORDS, OTHER_IDENTIFIERS, SPDX_SUFFIX

# Names and notices by which public licenses are granted.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "all-rights-reserved": "All rights reserved.",
}
ALL_FORMS = tuple(TEMPLATES.items()) + FORMS
MENTION = re.compile(
    r"licen[sc]|copyright|rights reserved|redistribut|public domain|\bSPDX\b|\bCC[ -]?(?:BY|0)|creative commons"
    r"|permission (?:is|to use)|\b[AL]?GPL", re.I)  # fmt: skip
MOST_DIFFERENCES = 0.1  # share of a template's words, identifying ones aside, that may differ
NEGATIONS = {"not", "no", "nor", "never", "except"}  # never among the differences
LEAST_SAVED = 1  # bytes that a template must save for its wording to be tried
SHORT = 200  # characters; longer templates may have several sentences and go on around a block
NEAR_WORDS = 6  # a negation so many words before a notice, in its clause, denies it
_WORD = re.compile(r"[\w.\-]*\w")


# Not at "v. 2.0" or the number of a paragraph; a block that goes on too far loses no notice.
_SENTENCE_END = re.compile(r"(?<!\s\d)[.!?]+[\"')\]]*(?=\s+[^\s\da-z])")
_CLOSING = re.compile(r"[.!?)\]\"']*")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*")
_SPDX_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\+?)")
_CLAUSE_END = re.compile(r"[.,;:!?()](?=\s|$)|\n\s*\n")
_DENIAL = re.compile(r"\b(?:not(?!\s+only\b)|no|nor|never|neither|cannot|without|\w+n['\u2019]t)\b", re.I)


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences with a mention, within lines or each joined
    to the next line while it does not end as a sentence does."""
    out: list[tuple[int, int]] = []
    parts = []
    for line in re.finditer(r"[^\n]+", text):
        at = line.start()
        for m in _SENTENCE_END.finditer(text, line.start(), line.end()):
            parts.append((at, m.end()))
            at = m.end()
        if text[at : line.end()].strip():
            parts.append((at, line.end()))
    i = 0
    while i < len(parts):
        start, end = parts[i]
        if MENTION.search(text, start, end):
            while i + 1 < len(parts) and text[max(start, end - 80) : end].rstrip().rstrip("\"')]")[-1:] not in (".", "!", "?"):
                i += 1
                end = parts[i][1]
            start += len(text[start:end]) - len(text[start:end].lstrip())
            out.append((start, end))
        i += 1
    return out


@functools.lru_cache(maxsize=64)
def _compressors(templates: tuple) -> tuple:
    plain = zstandard.ZstdCompressor(level=3)
    made = []
    for name, wording in templates:
        raw = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, zstandard.ZstdCompressor(level=3, dict_data=raw)))
    return plain, made


def rank(block: str, templates: tuple) -> list[tuple[int, str]]:
    """(bytes saved, template), most first."""
    plain, made = _compressors(templates)
    data = block.encode("utf-8", "surrogatepass")
    alone = len(plain.compress(data))
    return sorted(((alone - len(c.compress(data)), name) for name, c in made), key=lambda x: (-x[0], x[1]))


def wording_differences(block: str, wording: str) -> list[str]:
    """The template's words that the block lacks (``-word``) and words that
    interrupt it (``+word``), within the stretch of the block that matches best."""
    has, wants = _WORD.findall(block.lower()), _WORD.findall(wording.lower())
    pieces = [p for p in difflib.SequenceMatcher(None, has, wants, autojunk=False).get_matching_blocks() if p.size]
    out, inside, place = [], 0, None
    for p in pieces:
        out += [f"-{w}" for w in wants[inside : p.b]]
        if place is not None:
            out += [f"+{w}" for w in has[place : p.a]]
        inside, place = p.b + p.size, p.a + p.size
    return out + [f"-{w}" for w in wants[inside:]]


@functools.lru_cache(maxsize=1024)
def _wanted(wording: str) -> tuple[list[str], list[bool], frozenset[str]]:
    """A template's words, which of them identify it, and each once."""
    places = [m.span() for m in _WORD.finditer(wording)]
    words = [wording[a:b] for a, b in places]
    # Numbers that begin a sentence count its paragraphs and identify nothing.
    own = [
        (any(c.isdigit() for c in w) and not wording[:a].rstrip().endswith((".", ":", ";")))
        or (w[0].isupper() and w.lower() in NAME_WORDS)
        for w, (a, _) in zip(words, places, strict=True)
    ]
    return [w.lower() for w in words], own, frozenset(w.lower() for w in words)


def stretches(has: list[str], once: set[str], wording: str, most_differences: float) -> list[tuple[int, int, list[str]]]:
    """(first word, end, differences) of every place in ``has`` (``once``: its words, each once) that holds ``wording``."""
    wants, own, all_wants = _wanted(wording)
    allowed = int(most_differences * len(wants) + 1e-9)
    if len(all_wants - once) > allowed:
        return []
    # With so few differences, some run of equal words is at least so long.
    least = max(1, (len(wants) - allowed) // (allowed + 1))
    matcher = difflib.SequenceMatcher(None, has, wants, autojunk=False)
    out, todo = [], [(0, len(has))]
    while todo:
        low, high = todo.pop()
        a, b, n = matcher.find_longest_match(low, high, 0, len(wants))
        if n < least:
            continue
        start, end = max(low, a - b - allowed), min(high, a + len(wants) - b + allowed)
        near = difflib.SequenceMatcher(None, has[start:end], wants, autojunk=False)
        pieces = [p for p in near.get_matching_blocks() if p.size]
        differences, wrong, inside, place = [], False, 0, None
        for p in [*pieces, None]:
            until = p.b if p else len(wants)
            differences += [f"-{w}" for w in wants[inside:until]]
            wrong = wrong or any(own[inside:until])
            if p:
                if place is not None and place < p.a:
                    extra = has[start + place : start + p.a]
                    differences += [f"+{w}" for w in extra]
                    wrong = wrong or bool(NEGATIONS & set(extra)) or (own[inside - 1] and own[p.b])
                inside, place = p.b + p.size, p.a + p.size
        if len(differences) <= allowed and not wrong:
            a, end = start + pieces[0].a, start + place
            out.append((a, end, differences))
        else:
            end = a + n
        todo += [(low, a), (end, high)]
    return sorted(out)


def spdx(text: str, start: int, end: int) -> list[tuple[int, int, list[str]]]:
    """(start, end, identifiers) of every SPDX line in the stretch; an expression ends where its grammar does."""
    out = []
    for m in _SPDX.finditer(text, start, end):
        at, open_brackets, wants_name, names, stop = m.end(), 0, True, [], m.end()
        while token := _SPDX_TOKEN.match(text, at, end):
            word = token.group(1)
            if wants_name and word == "(":
                open_brackets += 1
            elif wants_name and word != ")" and word.upper() not in ("AND", "OR", "WITH"):
                if names and names[-1] == "WITH":
                    names.pop()  # an exception to the license before it
                else:
                    names.append(word)
                wants_name, stop = False, token.end()
            elif not wants_name and word == ")" and open_brackets:
                open_brackets, stop = open_brackets - 1, token.end()
            elif not wants_name and word.upper() in ("AND", "OR", "WITH"):
                wants_name = True
                names += ["WITH"] * (word.upper() == "WITH")
            else:
                break
            at = token.end()
        names = [n for n in names if n != "WITH"]
        if names:
            out.append((m.start(), stop, names))
    return out


@functools.lru_cache(maxsize=64)
def _identifiers(templates: tuple) -> dict[str, str]:
    """Every confirmed SPDX identifier, in lower case, and its name here."""
    return {n.lower(): n for n in [*OTHER_IDENTIFIERS, *(name for name, _ in (*ALL_FORMS, *templates))]}


def denied(text: str, start: int) -> str | None:
    """The negation in the clause before ``start``, among its last NEAR_WORDS words."""
    before = text[max(0, start - 200) : start]
    if text[start : start + 1].isupper():
        before = before.rsplit("\n", 1)[-1]  # a capital after a line break begins a sentence
    for m in _CLAUSE_END.finditer(before + " "):
        last = m.end()
        before = " " * last + before[last:]
    words = list(re.finditer(r"[\w'\u2019-]+", before))[-NEAR_WORDS:]
    found = _DENIAL.search(before, words[0].start()) if words else None
    return found.group().lower() if found else None


def _goes_on(text: str, end: int) -> bool:
    """Whether a name goes on after a short form ("MIT Press")."""
    following = re.compile(r"[ \t]+([^\W\d_]\w*)").match(text, end)
    return bool(following) and following.group(1)[0].isupper() and following.group(1).lower() not in ("license", "licence", "and", "or")


@functools.lru_cache(maxsize=64)
def _window_words(templates: tuple) -> int:
    """Words that two windows of a block share: no short template, differences included, is longer."""
    return max([8, *(2 * len(_wanted(w)[0]) for _, w in templates if len(w) <= SHORT)])


def windows(text: str, start: int, end: int, shared: int) -> list[tuple[int, int]]:
    """The block, cut into stretches of ``4 * shared`` words that overlap by ``shared``."""
    places = [m.span() for m in _WORD.finditer(text, start, end)]
    size, out = 4 * shared, []
    for i in range(0, max(1, len(places) - shared), size - shared):
        low = start if i == 0 else places[i][0]
        high = end if i + size >= len(places) else places[i + size - 1][1]
        out.append((low, high))
    return out


def _winners(text: str, start: int, end: int, templates: tuple) -> list[tuple[int, str, str]]:
    """(bytes saved, license, wording) of all templates for one window, most first."""
    plain, made = _compressors(templates)
    data = text[start:end].encode("utf-8", "surrogatepass")
    alone = len(plain.compress(data))
    saved = [(alone - len(c.compress(data)), name, w) for (name, c), (_, w) in zip(made, templates, strict=True)]
    return sorted(saved, key=lambda x: (-x[0], x[1]))


def _words(text: str, low: int, high: int) -> tuple[list[tuple[int, int]], list[str], set[str]]:
    places = [m.span() for m in _WORD.finditer(text, low, high)]
    has = [text[a:b].lower() for a, b in places]
    return places, has, set(has)


def scan(text: str, templates: tuple, most_differences: float) -> list[dict]:
    """One entry per confirmed stretch; one, unconfirmed, per candidate block without any.

    Time grows with the text's length: every window is compressed and compared on its own.
    """
    out, found, marks = [], {}, set()
    identifiers, shared = _identifiers(templates), _window_words(templates)

    def entry(start, end, name, saved, differences, confirmed=True):
        return {
            "start": start, "length": end - start, "license": name, "saved_bytes": saved,
            "differences": differences, "confirmed": confirmed,
        }

    for start, end in blocks(text):
        held, best = False, None
        for a, b, names in spdx(text, start, end):
            for name in dict.fromkeys(names):
                form = ((name, f"SPDX-License-Identifier: {name}"),)
                saved = _winners(text, a, b, form)[0][0]
                known = identifiers.get(_spdx_name(name).lower())
                if known and saved >= LEAST_SAVED:
                    found.setdefault((a, b, known), entry(a, b, known, saved, []))
                    marks.add((a, b, known))
                else:
                    out.append(entry(a, b, name, saved, [f"+{name}"], False))
                held = True
        for low, high in windows(text, start, end, shared):
            around = {0: _words(text, low, high)}
            ranked = _winners(text, low, high, templates)
            if ranked and (best is None or ranked[0][0] > best[0]):
                best = (*ranked[0], low, high)
            for saved, name, wording in ranked:
                if saved < LEAST_SAVED:
                    break
                reach = len(wording) if len(wording) > SHORT else 0
                if reach not in around:
                    around[reach] = _words(text, max(0, low - 2 * reach), high + 2 * reach)
                places, has, once = around[reach]
                for i, j, differences in stretches(has, once, wording, most_differences):
                    a, b = places[i][0], _CLOSING.match(text, places[j - 1][1]).end()
                    if j - i <= 3 and _goes_on(text, places[j - 1][1]):
                        continue
                    overlaps = a < end and b > start
                    if word := denied(text, a):
                        if overlaps and not held:
                            best = (saved, name, wording, a, b, word)
                        continue
                    held = held or overlaps
                    found.setdefault((a, b, name), entry(a, b, name, saved, differences))
        if not held and best:
            saved, name, wording, low, high, *word = best
            differences = [f"+{word[0]}"] if word else wording_differences(text[low:high], wording)
            out.append(entry(start, end, name, saved, differences, False))
    return sorted(out + _outermost(found, marks), key=lambda e: (e["start"], e["length"], e["license"]))


def _outermost(found: dict, marks: set) -> list[dict]:
    """A notice that is part of a longer confirmed one, SPDX lines aside, is not a notice of its own."""
    out, reached, group, at = [], -1, -1, None
    for key in sorted(found, key=lambda k: (k[0], -k[1], k[2])):
        if key[:2] != at:
            at, reached = key[:2], max(reached, group)
        if reached < key[1]:
            out.append(found[key])
        if key not in marks:
            group = max(group, key[1])
    return out


def _spdx_name(identifier: str) -> str:
    for suffix in SPDX_SUFFIX:
        identifier = identifier.removesuffix(suffix)
    return identifier


_FOUND = "array<struct<start:int, length:int, license:string, saved_bytes:int, differences:array<string>, confirmed:boolean>>"


def _scan_batches(templates: tuple, most_differences: float):
    entry = pa.struct([
        ("start", pa.int32()), ("length", pa.int32()), ("license", pa.string()), ("saved_bytes", pa.int32()),
        ("differences", pa.list_(pa.string())), ("confirmed", pa.bool_()),
    ])

    def run(batches):
        for batch in batches:
            found = [scan(t.as_py() or "", templates, most_differences) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(entry))], names=["doc_id", "blocks"]
            )

    return run


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | tuple = ALL_FORMS, most_differences: float = MOST_DIFFERENCES
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, licenses (confirmed
    ones, sorted, each once), blocks (start, length, license, saved_bytes, differences, confirmed).

    A block reports every template that saves at least ``LEAST_SAVED`` bytes of one of its windows and that
    its wording confirms, each with its own stretch, or else the best-ranked one, unconfirmed, with the
    differences (a negation before the notice is one); ties go to the first name.  SPDX identifiers are
    confirmed if they are known ones, and else reported unconfirmed.  Null
    and empty texts have no block.  Repeated rows are scanned alike; other columns are ignored;
    an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = tuple(templates.items() if isinstance(templates, dict) else templates)
    found = rows.mapInArrow(_scan_batches(pairs, most_differences), f"doc_id long, blocks {_FOUND}")
    confirmed = F.transform(F.filter("blocks", lambda b: b["confirmed"]), lambda b: b["license"])
    return found.select("doc_id", F.array_sort(F.array_distinct(confirmed)).alias("licenses"), "blocks")
