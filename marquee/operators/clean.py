"""Cleaning stages of the title catalogue.

After ``clean_identity`` (the only shuffle: one row per id) every stage is a
``Rule``: columns it derives and the condition of the rows it keeps.  The filter chain,
the validity flags and the funnel are all built from the same list of rules, with the
same options.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import exprs as X
from marquee.sources.schema import RAW_COLUMNS

TEXT_COLUMNS = ("directors", "performers", "synopsis", "countries")


def dedupe_by_key(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Keep one row per ``key``: the smallest by ``order`` (NULLS FIRST).

    Written as ``min(struct(...))`` per key rather than a window: the
    aggregate combines map-side, so a key that holds a third of all rows
    still leaves each map task as one row, and only those rows are shuffled.
    """
    columns = df.columns
    rest = order or [c for c in columns if c != key]
    packed = F.min(F.struct(*rest)).alias("_row")
    unpacked = {c: F.col(f"_row.{c}") for c in rest}
    return df.groupBy(key).agg(packed).select(
        *[F.col(key) if c == key else unpacked[c].alias(c) for c in columns]
    )


def clean_identity(
    df: DataFrame, kinds=X.VALID_KINDS, id_length: int = 8
) -> DataFrame:
    """Valid kind -> integer id -> id present -> id of ``id_length`` characters
    -> one row per id (in this order)."""
    kind_ok, as_int, id_ok = _identity(kinds, id_length)
    valid = df.filter(id_ok & kind_ok).withColumn("title_id", as_int)
    return dedupe_by_key(valid, "title_id", _row_order(df))


def _identity(kinds, id_length: int) -> tuple[Column, Column, Column]:
    """Whether the kind is valid; the id as int; whether that is valid."""
    as_int = X.lenient_int("title_id")
    id_ok = F.col("title_id").isNotNull() & as_int.isNotNull() & (F.length(as_int.cast("string")) == id_length)
    return F.col("kind").isin(list(kinds)), as_int, id_ok


def _row_order(df: DataFrame) -> list[str]:
    """Which of the rows of one id stays: the smallest by these columns, any
    that are not the catalogue's own last."""
    order = [c for c in RAW_COLUMNS if c not in ("title_id", "kind")] + ["kind"]
    return order + [c for c in df.columns if c not in RAW_COLUMNS]


def _negated(cond: Column, null_policy: str) -> Column:
    if null_policy == "drop":
        # NOT(NULL) is NULL, so rows whose checked columns hold a NULL go too.
        return ~cond
    if null_policy == "keep":
        return ~F.coalesce(cond, F.lit(False))
    raise ValueError(f"null_policy must be 'drop' or 'keep', not {null_policy!r}")


class Rule(NamedTuple):
    """One cleaning stage: its name, the funnel's name for it, the columns that
    it derives, and the condition that rows must meet after that.  Where the chain's
    final type of a column tells whether its row is kept, ``typed`` has its expression over the
    raw columns; the condition is then that it is not null."""

    stage: str
    step: str
    derived: dict[str, Column]
    keep: Column
    typed: dict[str, Column] = {}  # noqa: RUF012 - never changed


def rules(
    null_policy: str = "drop",
    text_columns=TEXT_COLUMNS,
    text_patterns=X.TEXT_PATTERNS,
    title_columns=("title",),
    title_patterns=X.TITLE_PATTERNS,
    fmt: str = X.DATE_FORMAT,
    min_year: int | None = None,
    max_year: int | None = None,
    ratings=X.VALID_RATINGS,
) -> list[Rule]:
    """The stages after ``clean_identity``, in chain order.

    text, title: not a URL, e-mail, date (text: nor a number); duration: ``N
    min`` or ``N Season(s)``; date: the trimmed text parses; year: a number (and in
    range); rating: known after normalising; genre: present.
    """
    year = F.col("release_year")
    in_range = year.isNotNull()
    if min_year is not None:
        in_range = in_range & (year >= min_year)
    if max_year is not None:
        in_range = in_range & (year <= max_year)
    durations = {
        "duration_min": X.extract_int("duration", X.MINUTES_PATTERN),
        "seasons": X.extract_int("duration", X.SEASONS_PATTERN),
    }
    known = F.col("duration_min").isNotNull() | F.col("seasons").isNotNull()
    rating = X.normalised_rating(F.trim("rating"), ratings)
    return [
        Rule("text", "text_valid", {}, _negated(X.matches_any(text_columns, text_patterns), null_policy)),
        Rule("title", "title_valid", {}, _negated(X.matches_any(title_columns, title_patterns), null_policy)),
        Rule("duration", "duration_valid", durations, known),
        Rule("added_date", "date_valid", {"added_on": F.trim("added_on")}, X.lenient_date("added_on", fmt).isNotNull(),
             {"added_on": X.lenient_date(F.trim("added_on"), fmt)}),
        Rule("year", "year_valid", {"release_year": X.lenient_int("release_year")}, in_range),
        Rule("rating", "rating_valid", {"rating": rating}, F.col("rating").isNotNull()),
        Rule("genre", "genre_valid", {}, F.col("genres").isNotNull()),
    ]


def apply_rule(df: DataFrame, rule: Rule) -> DataFrame:
    return (df.withColumns(rule.derived) if rule.derived else df).filter(rule.keep)


def _stage(name: str, **options):
    return next(r for r in rules(**options) if r.stage == name)


def clean_text(
    df: DataFrame, columns=TEXT_COLUMNS, patterns=X.TEXT_PATTERNS, null_policy: str = "drop"
) -> DataFrame:
    """Drop rows where a free-text column is a URL, e-mail, number or date."""
    return apply_rule(df, _stage("text", text_columns=columns, text_patterns=patterns, null_policy=null_policy))


def clean_title(
    df: DataFrame, columns=("title",), patterns=X.TITLE_PATTERNS, null_policy: str = "drop"
) -> DataFrame:
    """As ``clean_text`` for titles, without the all-digits rule."""
    return apply_rule(df, _stage("title", title_columns=columns, title_patterns=patterns, null_policy=null_policy))


def clean_duration(df: DataFrame) -> DataFrame:
    """``N min`` -> duration_min, ``N Season(s)`` -> seasons; drop the rest."""
    return apply_rule(df, _stage("duration"))


def clean_added_date(df: DataFrame, fmt: str = X.DATE_FORMAT) -> DataFrame:
    """Trim the availability date and keep rows whose text parses."""
    return apply_rule(df, _stage("added_date", fmt=fmt))


def clean_year(df: DataFrame, min_year: int | None = None, max_year: int | None = None) -> DataFrame:
    """Release year -> int, keep rows where it is a number (and in range)."""
    return apply_rule(df, _stage("year", min_year=min_year, max_year=max_year))


def clean_rating(df: DataFrame, ratings=X.VALID_RATINGS) -> DataFrame:
    """Normalise the rating (see ``normalised_rating``), drop what stays NULL."""
    return apply_rule(df, _stage("rating", ratings=ratings))


def clean_genre(df: DataFrame) -> DataFrame:
    return apply_rule(df, _stage("genre"))


def typed_catalog(df: DataFrame, fmt: str = X.DATE_FORMAT) -> DataFrame:
    """Final types: duration -> int (first token), date text -> date."""
    return df.withColumns(
        {
            "duration": X.lenient_int(X.first_token("duration")),
            "release_year": F.col("release_year").cast("int"),
            "added_on": X.lenient_date("added_on", fmt),
        }
    )


# Funnel step names of the stages after de-duplication, in chain order.
STEP_NAMES = ("text_valid", "title_valid", "duration_valid", "date_valid", "year_valid",
              "rating_valid", "genre_valid")
FIRST_STEPS = ("raw", "valid_kind", "valid_id", "one_per_id")


def annotate_validity(
    df: DataFrame, fmt: str = X.DATE_FORMAT, flags: bool = False, **options
) -> DataFrame:
    """The stages after ``clean_identity`` as one pass without filtering: all
    derived and typed columns plus ``valid``, true exactly for the rows the
    filter chain with the same ``options`` keeps (NULL counts as false).

    With ``flags=True`` the cumulative result after each stage is kept as
    well (one boolean column per ``STEP_NAMES`` entry), which is what the
    funnel counts.
    """
    chain = rules(fmt=fmt, **options)
    derived = df.withColumns({name: c for rule in chain for name, c in rule.derived.items()})
    cumulative = F.lit(True)
    steps = {}
    for rule in chain:
        cumulative = cumulative & F.coalesce(rule.keep, F.lit(False))
        steps[rule.step] = cumulative
    out = derived.withColumns(steps) if flags else derived
    return out.withColumn("valid", cumulative).transform(typed_catalog, fmt=fmt)


def clean_until(df: DataFrame, last_stage: str, kinds=X.VALID_KINDS, id_length: int = 8, **options) -> DataFrame:
    """Apply the stages up to and including ``last_stage``."""
    df = clean_identity(df, kinds, id_length)
    if last_stage == "identity":
        return df
    chain = rules(**options)
    names = [r.stage for r in chain]
    if last_stage not in names:
        raise ValueError(f"unknown stage {last_stage!r}")
    for rule in chain[: names.index(last_stage) + 1]:
        df = apply_rule(df, rule)
    return df


# Stage names, in chain order.
STAGES = ("identity", "text", "title", "duration", "added_date", "year", "rating", "genre")


def clean_catalog(
    df: DataFrame, kinds=X.VALID_KINDS, id_length: int = 8, fmt: str = X.DATE_FORMAT, **options
) -> DataFrame:
    """Raw catalogue -> typed, validated, one row per id.  ``options`` are those
    of ``rules``."""
    df = clean_identity(df, kinds, id_length)
    return once(df, rules(fmt=fmt, **options), {"duration": X.lenient_int(X.first_token("duration"))})


def once(df: DataFrame, chain: list[Rule], typed: dict[str, Column]) -> DataFrame:
    """The rows that all rules of ``chain`` keep, with derived and ``typed`` columns, every expression
    evaluated once a row.

    Catalyst pushes a filter on a derived column below the projection that derives it, so that both
    evaluate the column.  A generator stops that: conditions on raw columns come first, what
    they leave makes one array of one struct of all derived columns, and ``explode`` yields it as a row whose
    fields are filtered and returned as they are.
    """
    values = {name: c for rule in chain for name, c in (rule.derived | rule.typed).items()} | typed
    early = [rule for rule in chain if not rule.derived]
    for rule in early:
        df = df.filter(rule.keep)
    made = F.array(F.struct(*[c.alias(name) for name, c in values.items()]))
    df = df.withColumn("_made", F.explode(made))
    columns = {name: F.col(f"_made.{name}") for name in values}
    out = df.withColumns(columns).drop("_made")
    for rule in chain:
        if rule.derived:
            out = out.filter(F.col(next(iter(rule.typed))).isNotNull() if rule.typed else rule.keep)
    return out


def _long(wide: DataFrame, steps) -> DataFrame:
    """One row of counts -> (step_no, step, rows)."""
    order = F.create_map(*[x for i, s in enumerate(steps) for x in (F.lit(s), F.lit(i + 1))])
    out = wide.unpivot([], list(steps), "step", "rows")
    return out.select(order[F.col("step")].cast("int").alias("step_no"), "step", "rows")


def clean_funnel(
    df: DataFrame, kinds=X.VALID_KINDS, id_length: int = 8, fmt: str = X.DATE_FORMAT, **options
) -> DataFrame:
    """Rows left after every cleaning step: (step_no, step, rows).

    One scan and one shuffle: rows are grouped by valid id (all others under
    NULL), each group keeps its counts and the row that de-duplication would, and
    one global aggregate adds them up.  ``options`` are those of ``clean_catalog``.
    """
    kind_ok, as_int, id_ok = _identity(kinds, id_length)
    order = _row_order(df)
    groups = df.withColumn("_id", F.when(kind_ok & id_ok, as_int)).groupBy("_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(kind_ok).alias("_kind_n"),
        F.min(F.when(F.col("_id").isNotNull(), F.struct(*[F.col(f"`{c}`") for c in order]))).alias("_row"),
    )
    one = groups.select(F.col("_id").alias("title_id"), "_n", "_kind_n", "_row.*")
    flagged = annotate_validity(one, fmt=fmt, flags=True, **options)
    has_id = F.col("title_id").isNotNull()
    counts = flagged.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum("_kind_n"), F.lit(0)).alias("valid_kind"),
        F.coalesce(F.sum(F.when(has_id, F.col("_n"))), F.lit(0)).alias("valid_id"),
        F.count("title_id").alias("one_per_id"),
        *[F.count_if(has_id & F.col(n)).alias(n) for n in STEP_NAMES],
    )
    return _long(counts, (*FIRST_STEPS, *STEP_NAMES))


def funnel_counts(raw: DataFrame, flagged: DataFrame, kinds=X.VALID_KINDS, id_length: int = 8) -> DataFrame:
    """The same from the raw rows and the stored, de-duplicated rows annotated by
    ``annotate_validity(..., flags=True)`` with the same options."""
    kind_ok, _, id_ok = _identity(kinds, id_length)
    before = raw.agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(kind_ok).alias("valid_kind"),
        F.count_if(kind_ok & id_ok).alias("valid_id"),
    )
    after = flagged.agg(
        F.count(F.lit(1)).alias("one_per_id"), *[F.count_if(n).alias(n) for n in STEP_NAMES]
    )
    steps = (*FIRST_STEPS, *STEP_NAMES)
    rows = _long(before, FIRST_STEPS[:3]).unionByName(_long(after, (FIRST_STEPS[3], *STEP_NAMES)))
    order = F.create_map(*[x for i, s in enumerate(steps) for x in (F.lit(s), F.lit(i + 1))])
    return rows.withColumn("step_no", order[F.col("step")].cast("int"))
