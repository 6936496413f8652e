"""Column helpers shared by the operators.

Every helper returns a ``Column`` built from built-in functions only, so it
stays inside whole-stage codegen.  All of them are safe with ANSI mode on:
junk text turns into NULL instead of failing the job (``try_cast``,
``try_to_date``, ``get``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Validation patterns and lists used by the cleaning stages.
# ---------------------------------------------------------------------------
URL_PATTERN = r"(?i)^https?://"
EMAIL_PATTERN = r"(?i)^[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}$"
DIGITS_PATTERN = r"^[0-9]+$"
DATE_TEXT_PATTERN = (
    r"^(January|February|March|April|May|June|July|August|September|October"
    r"|November|December)\s+\d{1,2},\s+\d{4}$"
)
MINUTES_PATTERN = r"(\d+)\s+min$"
SEASONS_PATTERN = r"(\d+)\s+Seasons?$"
DATE_FORMAT = "MMMM d, yyyy"
VALID_KINDS = ("Movie", "TV Show")
VALID_RATINGS = (
    "G", "PG", "PG-13", "R", "NC-17", "NR", "UR",
    "TV-G", "TV-PG", "TV-Y", "TV-Y7", "TV-Y7-FV", "TV-14", "TV-MA",
)
TEXT_PATTERNS = (URL_PATTERN, EMAIL_PATTERN, DIGITS_PATTERN, DATE_TEXT_PATTERN)
# Titles may legitimately be all digits ("300").
TITLE_PATTERNS = (URL_PATTERN, EMAIL_PATTERN, DATE_TEXT_PATTERN)
# ---------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_int(c: str | Column) -> Column:
    """Text -> int; NULL for junk, overflow and non-integral text."""
    return col(c).try_cast("int")


def lenient_date(c: str | Column, fmt: str = DATE_FORMAT) -> Column:
    """Text -> date with a pattern; NULL when the text does not parse."""
    return F.try_to_date(col(c), fmt)


def first_token(c: str | Column, sep: str = " ") -> Column:
    """First element of ``split(c, sep)``; ``get`` is NULL-safe past the end."""
    return F.get(F.split(col(c), sep), 0)


def matches_any(columns, patterns) -> Column:
    """OR of ``column RLIKE pattern`` over every column x pattern pair.

    SQL three-valued logic applies: a NULL column makes its terms NULL, so
    the disjunction is NULL unless some other term is true.  Built as one SQL
    expression (raw string literals keep the regex backslashes), which costs
    one call into the JVM instead of one per term.
    """
    terms = []
    for c in columns:
        for p in patterns:
            if "'" in p:
                raise ValueError(f"pattern must not contain a single quote: {p!r}")
            terms.append(f"`{c}` RLIKE r'{p}'")
    return F.expr(" OR ".join(terms))


def extract_int(c: str | Column, pattern: str) -> Column:
    """Group 1 of ``pattern`` as int when the text matches, else NULL.

    One regex pass.  ``regexp_extract`` gives '' when nothing matches; that is made NULL before the cast,
    since a cast that fails makes an exception for the row, which costs many times the
    pass.  ``pattern``'s group 1 must not match the empty string.
    """
    found = F.regexp_extract(col(c), pattern, 1)
    return lenient_int(F.get(F.array_remove(F.array(found), ""), 0))


def item_count(c: str | Column, sep: str = ",") -> Column:
    """Number of separator occurrences + 1 (literal separator); NULL on NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.size(F.split(c, re.escape(sep), -1)))


def item_array(c: str | Column, sep: str = ",", trim: bool = False) -> Column:
    """Split a delimited list into ``array<string>``; ``trim`` also eats the
    whitespace that follows each separator."""
    pattern = re.escape(sep) + (r"\s*" if trim else "")
    return F.split(col(c), pattern, -1)


def normalised_rating(c: str | Column, ratings=VALID_RATINGS) -> Column:
    """Known rating -> itself; ``N min`` / ``N Season(s)`` -> ``N`` as text;
    anything else -> NULL.  All branches are strings (ANSI-safe CASE)."""
    c = col(c)
    # Equal to CASE WHEN known / WHEN minutes text / WHEN seasons text: the two
    # patterns end differently, so at most one of them can match.
    return F.coalesce(
        F.when(c.isin(list(ratings)), c),
        extract_int(c, MINUTES_PATTERN).cast("string"),
        extract_int(c, SEASONS_PATTERN).cast("string"),
    )


def minutes_text(c: str | Column) -> Column:
    """Mean minutes as ``N min M sec``: floor, remainder x 60 rounded."""
    m = col(c)
    whole = F.floor(m)
    seconds = F.round((m - whole) * 60, 0).cast("int")
    return F.concat(whole.cast("string"), F.lit(" min "), seconds.cast("string"), F.lit(" sec"))


def strip_ws(c: str | Column) -> Column:
    """Remove leading and trailing white space of any kind, no-break spaces too."""
    return F.regexp_replace(col(c), r"^[\s\u00a0]+|[\s\u00a0]+$", "")


# Elements of HTML that have no content and no closing tag.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

# What stands in a tag after its name, quoted values with any character but their quote.  Possessive
# repeats only: no deep recursion on long tags and no backtracking over them.
_IN_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_COMMENT = r"<!--(?s:.*?-->|.*+)"
_MARK = "\u0000"
_ANY_TAG = rf"</?[A-Za-z!]{_IN_TAG}"


def element_start(tag: str, css_class: str) -> str:
    """Regex of an opening tag ``<tag class="... css_class ...">``.

    Tag and attribute names match in any case, classes exactly; values may be quoted
    either way or bare, and a tag's first class attribute counts.
    """
    t, k = re.escape(tag), re.escape(css_class)
    other = r"""\s++(?!(?i:class)\s*+=)[^\s"'>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
    value = rf"""(?:"(?:[^"]*\s)?{k}(?:\s[^"]*)?"|'(?:[^']*\s)?{k}(?:\s[^']*)?'|{k}(?=[\s/>]))"""
    return rf"<(?i:{t})(?:{other})*+\s++(?i:class)\s*+=\s*+{value}{_IN_TAG}"


def same_tag(tag: str) -> str:
    """Regex of an opening or closing tag of that name."""
    return rf"</?(?i:{re.escape(tag)})(?=[\s/>]){_IN_TAG}"


# Basic character entities, decoded in this order ("&amp;" last so
# that "&amp;lt;" stays "&lt;").
HTML_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"),
)


def unescape_basic(c: str | Column) -> Column:
    out = col(c)
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def first_element_text(html: str | Column, tag: str, css_class: str) -> Column:
    """Text of the first matching element with all tags inside it taken out,
    entity-decoded and stripped; NULL when no element matches.

    The page is cut at its tags of that name, and a fold over them counts depth: the element ends where
    its own closing tag brings depth back to zero, whatever elements of the same name it holds, or
    at the page's end.  Comments and other tags are taken out first, ``>`` and tags inside quoted values end nothing, and a
    void element has the empty text.  Limit: script and style text is read like any other.
    """
    cut = same_tag(tag)
    # One pass from left to right, so that nothing inside a tag or a comment is taken for a tag.  A mark stays
    # where something was taken out, so that what stood around it makes no new tag.
    page = F.regexp_replace(col(html), rf"(?=<)(?:{_COMMENT}|({cut})|{_ANY_TAG})", f"$1{_MARK}")
    rest = F.regexp_substr(page, F.lit(rf"{element_start(tag, css_class)}(?s:.*+)"))
    if tag.lower() in VOID_TAGS:
        return F.when(rest.isNotNull(), "")

    def text(r: Column) -> Column:
        tags = F.regexp_extract_all(r, F.lit(cut), F.lit(0))
        ended = F.aggregate(
            tags,
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen")),
            lambda s, t: F.when((s.seen > 0) & (s.depth == 0), s).otherwise(F.struct(
                (s.depth + F.when(F.startswith(t, F.lit("</")), -1).otherwise(1)).alias("depth"),
                (s.seen + 1).alias("seen"))),
            # How many pieces after the opening tag belong to the element.
            lambda s: F.when(s.depth == 0, s.seen - 1).otherwise(F.size(tags)),
        )
        return F.array_join(F.slice(F.split(r, cut), F.lit(2), F.greatest(ended, F.lit(0))), "")

    # A lambda's argument is computed once, though it is used three times.
    inner = F.get(F.transform(F.array(rest), text), 0)
    return strip_ws(unescape_basic(F.replace(inner, F.lit(_MARK), F.lit(""))))
