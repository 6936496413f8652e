"""DuckDB SQL for every query key: the independent check of the Spark plans.

Each statement runs on the driver's tables (``orders``, ``pages``) registered
as views and rebuilds the catalogue, the cleaning chain and the query in plain
SQL.  Engine differences handled here: DuckDB arrays are 1-based, ``floor`` is
DOUBLE, ``length`` and date differences are BIGINT, ``concat`` skips NULLs
(``||`` does not), ``regexp_replace`` needs the ``g`` flag, and ``UNPIVOT``
drops NULLs.
"""

from __future__ import annotations

from marquee.functions import exprs as X

MIN = X.MINUTES_PATTERN
SEAS = X.SEASONS_PATTERN
DATE_FMT = "%B %d, %Y"
KINDS = "('Movie','TV Show')"
RATINGS = "(" + ",".join(f"'{r}'" for r in X.VALID_RATINGS) + ")"
COUNTRIES = "('United States','France','India','Spain')"

RAW_COLUMNS = (
    "title_id, kind, title, directors, performers, countries, added_on, "
    "release_year, rating, duration, genres, synopsis"
)


def _bad(col: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '{p}')" for p in patterns) + ")"


TEXT_BAD = " OR ".join(
    _bad(c, X.TEXT_PATTERNS) for c in ("directors", "performers", "synopsis", "countries")
)
TITLE_BAD = _bad("title", X.TITLE_PATTERNS)


def _extract_int(c: str, p: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{p}') THEN try_cast(regexp_extract({c}, '{p}', 1) AS INTEGER) END"


def _rating(c: str) -> str:
    return (
        f"CASE WHEN {c} IN {RATINGS} THEN {c} "
        f"WHEN regexp_matches({c}, '{MIN}') THEN CAST({_extract_int(c, MIN)} AS VARCHAR) "
        f"WHEN regexp_matches({c}, '{SEAS}') THEN CAST({_extract_int(c, SEAS)} AS VARCHAR) END"
    )


def _minutes_text(m: str) -> str:
    return (
        f"CAST(CAST(floor({m}) AS BIGINT) AS VARCHAR) || ' min ' || "
        f"CAST(CAST(round(({m} - floor({m})) * 60, 0) AS INTEGER) AS VARCHAR) || ' sec'"
    )


def _element_text(html: str, tag: str, css_class: str) -> str:
    """Text of the first element of a class, found by other means than the
    Spark side: all elements of the tag as a list, the class attribute of each taken
    apart, the first that has the class, its tags cut away."""
    elements = f"regexp_extract_all({html}, '(?is)<{tag}(?:\\s[^>]*)?>.*?(?:</{tag}\\s*>|\\z)')"
    opening = "regexp_extract(e, '^[^>]*')"
    given = f"regexp_extract({opening}, '(?i)\\sclass\\s*=\\s*(.*)$', 1)"
    quoted = f"CASE WHEN left({given}, 1) IN ('\"', chr(39)) THEN string_split(substr({given}, 2), left({given}, 1))[1] "
    quoted += f"ELSE string_split({given}, ' ')[1] END"
    has = f"list_contains(regexp_split_to_array({quoted}, '\\s+'), '{css_class}')"
    first = f"list_filter({elements}, lambda e: {has})[1]"
    text = f"regexp_replace({first}, '<[^>]*>', '', 'g')"
    for entity, char in (("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("#39", "chr(39)"), ("nbsp", "chr(160)"), ("amp", "'&'")):
        text = f"replace({text}, '&{entity};', {char})"
    return f"trim({text}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


CTES = f"""
raw_catalog AS (
 SELECT CASE WHEN k%53=0 THEN 'n/a' WHEN k%59=0 THEN CAST(k%9999 AS VARCHAR)
             WHEN k%41=0 THEN CAST(80000000+k-1 AS VARCHAR) ELSE CAST(80000000+k AS VARCHAR) END AS title_id,
  CASE WHEN k%47=0 THEN 'William Wyler' WHEN k%3=0 THEN 'TV Show' ELSE 'Movie' END AS kind,
  CASE WHEN k%61=0 THEN 'HTTPS://x.example/' || k WHEN k%67=0 THEN CAST(k AS VARCHAR)
       WHEN k%101=0 THEN 'January 31, 2019' ELSE 'Title ' || k END AS title,
  CASE WHEN k%11=0 THEN NULL WHEN k%71=0 THEN 'a' || k || '@mail.example' ELSE 'Director ' || (k%97) END AS directors,
  CASE WHEN k%23=0 THEN NULL WHEN k%73=0 THEN '12345' ELSE 'Actor ' || (c%50) || ', Actor ' || (k%37) END AS performers,
  CASE WHEN k%19=0 THEN NULL WHEN k%4=0 THEN co1 || ', ' || co2 ELSE co1 END AS countries,
  CASE WHEN k%79=0 THEN '2019-13-45' WHEN k%5=0 THEN ' ' || dtxt || ' ' ELSE dtxt END AS added_on,
  CASE WHEN k%83=0 THEN 'abc' ELSE CAST(1990+k%30 AS VARCHAR) END AS release_year,
  CASE WHEN k%89=0 THEN '90 min' WHEN k%103=0 THEN '2 Seasons' WHEN k%13=0 THEN 'junk'
       WHEN k%2=0 THEN ' TV-MA' ELSE 'PG-13' END AS rating,
  CASE WHEN k%43=0 THEN 'Dramas' WHEN k%3=0 THEN (CASE WHEN k%7=0 THEN '1 Season' ELSE (k%7+1) || ' Seasons' END)
       ELSE (60+k%120) || ' min' END AS duration,
  CASE WHEN k%29=0 THEN NULL WHEN k%2=0 THEN 'Dramas, Music' ELSE 'Comedies' END AS genres,
  CASE WHEN k%222=0 THEN '' ELSE (CASE WHEN k%6=1 THEN 'A MUSIC story ' ELSE 'A plain story ' END) || k ||
    (CASE WHEN k%211=0 THEN chr(10) || '"told"' || chr(9) || 'in two lines' ELSE '' END) END AS synopsis
 FROM (SELECT o_orderkey k, o_custkey c, strftime(o_orderdate, '%B %-d, %Y') AS dtxt,
  CASE o_orderkey%4 WHEN 0 THEN 'United States' WHEN 1 THEN 'India' WHEN 2 THEN 'Spain' ELSE 'France' END co1,
  CASE o_orderkey%3 WHEN 0 THEN 'Mexico' WHEN 1 THEN 'India' ELSE 'France' END co2 FROM orders) t),
release_pages AS (
 SELECT 'Title ' || k AS title,
  CASE WHEN k%2=0 THEN 0 WHEN k%17=0 THEN 404 ELSE 200 END AS status,
  CASE WHEN k%2=0 THEN NULL WHEN k%31=0 THEN '<html><p>no date</p></html>'
   WHEN k%7=1 THEN '<html><span data-class="release">WRONG</span><span id=r class="release">' || strftime(r, '%B')
     || ' <b class="day">' || strftime(r, '%-d') || '</b>, <i>' || strftime(r, '%Y') || '</i></span></html>'
   WHEN k%7=2 THEN '<HTML><SPAN CLASS=''x''>-</SPAN><SPAN ID="r" CLASS = ''a release''>'
     || strftime(r, '%B %-d, %Y') || '&nbsp;</SPAN></HTML>'
   WHEN k%7=3 THEN '<span class="release"><a href="/r">' || strftime(r, '%B %-d, %Y') || '</a></span>'
   ELSE '<html><span class="x">-</span><span class="a release b"> ' || strftime(r, '%B %-d, %Y')
     || ' </span><span class="release">January 1, 1900</span></html>' END AS html
 FROM (SELECT o_orderkey AS k, o_orderdate + INTERVAL 30 DAY AS r FROM orders) t),
s_identity AS (
 SELECT {RAW_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY title NULLS FIRST, directors NULLS FIRST,
     performers NULLS FIRST, countries NULLS FIRST, added_on NULLS FIRST, release_year NULLS FIRST,
     rating NULLS FIRST, duration NULLS FIRST, genres NULLS FIRST, synopsis NULLS FIRST, kind NULLS FIRST) AS rn
  FROM (SELECT try_cast(title_id AS INTEGER) AS title_id, kind, title, directors, performers, countries,
               added_on, release_year, rating, duration, genres, synopsis
        FROM raw_catalog WHERE kind IN {KINDS}) c
  WHERE title_id IS NOT NULL AND length(CAST(title_id AS VARCHAR)) = 8) d
 WHERE rn = 1),
s_text AS (SELECT * FROM s_identity WHERE NOT ({TEXT_BAD})),
s_title AS (SELECT * FROM s_text WHERE NOT ({TITLE_BAD})),
s_duration AS (
 SELECT * FROM (SELECT *, {_extract_int('duration', MIN)} AS duration_min,
                          {_extract_int('duration', SEAS)} AS seasons FROM s_title) x
 WHERE duration_min IS NOT NULL OR seasons IS NOT NULL),
s_added_date AS (
 SELECT * REPLACE (trim(added_on) AS added_on) FROM s_duration
 WHERE try_strptime(trim(added_on), '{DATE_FMT}') IS NOT NULL),
s_year AS (
 SELECT * REPLACE (try_cast(release_year AS INTEGER) AS release_year) FROM s_added_date
 WHERE try_cast(release_year AS INTEGER) IS NOT NULL),
s_rating AS (
 SELECT * FROM (SELECT * REPLACE ({_rating('trim(rating)')} AS rating) FROM s_year) x
 WHERE rating IS NOT NULL),
s_genre AS (SELECT * FROM s_rating WHERE genres IS NOT NULL),
clean_catalog AS (
 SELECT title_id, kind, title, directors, performers, countries,
        CAST(try_strptime(added_on, '{DATE_FMT}') AS DATE) AS added_on, release_year, rating,
        try_cast(string_split(duration, ' ')[1] AS INTEGER) AS duration, genres, synopsis,
        duration_min, seasons
 FROM s_genre),
music AS (
 SELECT * FROM clean_catalog
 WHERE kind = 'Movie' AND contains(lower(synopsis), 'music') AND duration > 90),
music_performers AS (
 SELECT performer, count(performer) AS appearances
 FROM (SELECT unnest(string_split(performers, ', ')) AS performer FROM music) e GROUP BY performer),
top_performer AS (
 SELECT performer, appearances FROM music_performers ORDER BY appearances DESC, performer LIMIT 1),
page_dates AS (
 SELECT title, min(CAST(try_strptime(release_text, '{DATE_FMT}') AS DATE)) AS release_date
 FROM (SELECT title, CASE WHEN status = 200 THEN {_element_text('html', 'span', 'release')} END AS release_text
       FROM release_pages) p
 GROUP BY title),
combination_means AS (
 SELECT countries, round(avg(duration_min), 2) AS mean_minutes FROM clean_catalog GROUP BY countries),
country_means AS (
 SELECT country, round(avg(duration_min), 2) AS mean_minutes
 FROM (SELECT unnest(string_split(countries, ', ')) AS country, duration_min FROM clean_catalog) e
 GROUP BY country),
performer_titles AS (
 SELECT * FROM music WHERE contains(performers, (SELECT performer FROM top_performer)))
"""


def sql(body: str) -> str:
    return f"WITH {CTES.strip()}\n{body.strip()}"


NULL_COUNTS_RAW = ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in RAW_COLUMNS.split(", ")
)

CLEAN_COLUMNS = RAW_COLUMNS.split(", ") + ["duration_min", "seasons"]
CLEAN_TYPES = {
    "title_id": "int", "added_on": "date", "release_year": "int", "duration": "int",
    "duration_min": "int", "seasons": "int",
}


def _null_profile(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {table}"
        for c in columns
    )


def _compare(where: str, as_text: bool) -> str:
    if as_text:
        cols = (f"{_minutes_text('c.mean_minutes')} AS combination_text, "
                f"{_minutes_text('p.mean_minutes')} AS participation_text")
    else:
        cols = "c.mean_minutes AS combination_mean, p.mean_minutes AS participation_mean"
    return (f"SELECT p.country, {cols} FROM combination_means c "
            f"JOIN country_means p ON c.countries = p.country {where}")


_UNPIVOT = " UNION ALL ".join(
    f"SELECT kind, '{m}' AS metric, round(avg({c}), 2) AS value FROM clean_catalog GROUP BY kind"
    for m, c in (("mean_minutes", "duration_min"), ("mean_seasons", "seasons"), ("mean_year", "release_year"))
)

_FUNNEL = " UNION ALL ".join(
    f"SELECT {i} AS step_no, '{name}' AS step, count(*) AS \"rows\" FROM {src}"
    for i, (name, src) in enumerate(
        [
            ("raw", "raw_catalog"),
            ("valid_kind", f"raw_catalog WHERE kind IN {KINDS}"),
            ("valid_id", f"raw_catalog WHERE kind IN {KINDS} AND try_cast(title_id AS INTEGER) IS NOT NULL "
                         "AND length(CAST(try_cast(title_id AS INTEGER) AS VARCHAR)) = 8"),
            ("one_per_id", "s_identity"),
            ("text_valid", "s_text"),
            ("title_valid", "s_title"),
            ("duration_valid", "s_duration"),
            ("date_valid", "s_added_date"),
            ("year_valid", "s_year"),
            ("rating_valid", "s_rating"),
            ("genre_valid", "s_genre"),
        ],
        start=1,
    )
)

# The clean chain with other rules: the same SQL with one part exchanged.
_NO_DATE = {
    TEXT_BAD: " OR ".join(
        _bad(c, [p for p in X.TEXT_PATTERNS if p != X.DATE_TEXT_PATTERN])
        for c in ("directors", "performers", "synopsis", "countries")),
    TITLE_BAD: _bad("title", [p for p in X.TITLE_PATTERNS if p != X.DATE_TEXT_PATTERN]),
}
_KEEP = {bad: f"coalesce(({bad}), false)" for bad in (TEXT_BAD, TITLE_BAD)}
REPLACED = {"clean_catalog_as_run": _NO_DATE, "clean_catalog_keep": _KEEP, "clean_funnel_keep": _KEEP}


def _inferred(table: str, columns) -> str:
    """Types as the stored values suggest: whole numbers, dates, else text."""
    def kind(c: str) -> str:
        value = f"CAST({c} AS VARCHAR)"
        return (f"CASE WHEN bool_and(try_cast({value} AS INTEGER) IS NOT NULL) THEN 'int' "
                f"WHEN bool_and(regexp_matches({value}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) THEN 'date' "
                f"ELSE 'string' END")
    return _report(table, [(c, f"(SELECT {kind(c)} FROM {table} WHERE {c} IS NOT NULL)") for c in columns])


def _report(table: str, pairs) -> str:
    return " UNION ALL ".join(
        f'SELECT {i} AS "position", \'{c}\' AS column_name, {t} AS data_type, count({c}) AS non_null FROM {table}'
        for i, (c, t) in enumerate(pairs))


_COUNT_ITEMS = "CAST(len(string_split(countries, ',')) AS INTEGER)"

BODIES = {
    # 2.1
    "scan_tsv": "SELECT * FROM raw_catalog",
    "scan_tsv_gz": "SELECT * FROM raw_catalog",
    "infer_schema": _inferred("clean_catalog", CLEAN_COLUMNS),
    "parquet_roundtrip": "SELECT * FROM raw_catalog",
    "schema_report": _report("clean_catalog", [(c, f"'{CLEAN_TYPES.get(c, 'string')}'") for c in CLEAN_COLUMNS]),
    "preview": "SELECT * FROM clean_catalog ORDER BY title_id LIMIT 20",
    "row_count": "SELECT 'raw_catalog' AS table_name, count(*) AS \"rows\" FROM raw_catalog "
                 "UNION ALL SELECT 'clean_catalog', count(*) FROM clean_catalog",
    # 2.2
    "rename_columns": "SELECT * FROM raw_catalog",
    "derive_columns": f"SELECT *, {_extract_int('duration', MIN)} AS duration_min, "
                      f"{_extract_int('duration', SEAS)} AS seasons FROM raw_catalog",
    "project_alias": 'SELECT title_id AS id, title AS name, release_year AS "year" FROM clean_catalog',
    "drop_columns": "SELECT * EXCLUDE (synopsis, directors, performers) FROM clean_catalog",
    "filter_equals": "SELECT * FROM clean_catalog WHERE kind = 'Movie'",
    "filter_in_list": f"SELECT * FROM clean_catalog WHERE countries IN {COUNTRIES}",
    "filter_not_null": "SELECT * FROM raw_catalog WHERE directors IS NOT NULL AND genres IS NOT NULL",
    "filter_regex": f"SELECT * FROM raw_catalog WHERE regexp_matches(title, '{X.URL_PATTERN}')",
    "filter_any_pattern": f"SELECT * FROM raw_catalog WHERE {TEXT_BAD}",
    "filter_negated_nulls": f"SELECT * FROM raw_catalog WHERE NOT ({TEXT_BAD})",
    "filter_negated_keep": f"SELECT * FROM raw_catalog WHERE NOT coalesce(({TEXT_BAD}), false)",
    "filter_contains": "SELECT * FROM clean_catalog WHERE contains(lower(synopsis), 'music')",
    "filter_compare": "SELECT * FROM clean_catalog WHERE duration > 90",
    "filter_and_or": "SELECT * FROM clean_catalog WHERE (kind = 'Movie' AND duration > 90) OR seasons > 3",
    "case_multi": f"SELECT title_id, rating, {_rating('trim(rating)')} AS rating_norm FROM raw_catalog",
    "case_single": f"SELECT title_id, duration, {_extract_int('duration', MIN)} AS duration_min FROM raw_catalog",
    # 2.3
    "cast_int_lenient": "SELECT title_id, try_cast(title_id AS INTEGER) AS title_id_int, "
                        "try_cast(release_year AS INTEGER) AS year_int FROM raw_catalog",
    "cast_bool_int": "SELECT title_id, CAST(directors IS NULL AS INTEGER) AS directors_null, "
                     "CAST(genres IS NULL AS INTEGER) AS genres_null FROM raw_catalog",
    "cast_int_text": "SELECT title_id, CAST(title_id AS VARCHAR) AS id_text, "
                     "CAST(length(CAST(title_id AS VARCHAR)) AS INTEGER) AS id_length FROM clean_catalog",
    "cast_double_int": "SELECT countries, mean_minutes, "
                       "CAST(round((mean_minutes - floor(mean_minutes)) * 60, 0) AS INTEGER) AS seconds "
                       "FROM combination_means",
    "parse_date": f"SELECT title_id, added_on, CAST(try_strptime(trim(added_on), '{DATE_FMT}') AS DATE) "
                  "AS added_date FROM raw_catalog",
    "fn_trim": "SELECT title_id, trim(added_on) AS added_trim, trim(rating) AS rating_trim FROM raw_catalog",
    "fn_lower": "SELECT title_id, lower(synopsis) AS synopsis_lower FROM clean_catalog",
    "fn_length": "SELECT title_id, CAST(length(title_id) AS INTEGER) AS id_length, "
                 "CAST(length(title) AS INTEGER) AS title_length FROM raw_catalog",
    "fn_split": "SELECT title_id, string_split(countries, ', ') AS country_list FROM clean_catalog",
    "fn_regexp_extract": f"SELECT title_id, duration, regexp_extract(duration, '{MIN}', 1) AS minutes_text, "
                         f"regexp_extract(duration, '{SEAS}', 1) AS seasons_text FROM raw_catalog",
    "fn_concat": "SELECT title_id, title || ' (' || release_year || ')' AS title_year, "
                 "directors || ' - ' || title AS director_title FROM raw_catalog",
    "fn_round": "SELECT countries, round(avg(duration_min), 2) AS mean_2, round(avg(duration_min), 0) AS mean_0 "
                "FROM clean_catalog GROUP BY countries",
    "fn_floor": "SELECT countries, CAST(floor(mean_minutes) AS BIGINT) AS whole_minutes FROM combination_means",
    "fn_arith": "SELECT title_id, duration - 60 AS over_hour, duration * 60 AS seconds, "
                "release_year + 1 AS next_year, CAST(duration AS DOUBLE) / 7.0 AS per_week FROM clean_catalog",
    "fn_array_get": "SELECT title_id, duration, string_split(duration, ' ')[1] AS first_token FROM raw_catalog",
    "fn_datediff": "SELECT title_id, added_on, CAST(datediff('day', make_date(release_year, 1, 1), added_on) "
                   "AS INTEGER) AS days_since_year_start FROM clean_catalog",
    "explode_list": "SELECT title_id, unnest(string_split(countries, ', ')) AS country FROM clean_catalog",
    "fn_count_items": f"SELECT title_id, countries, {_COUNT_ITEMS} AS country_count FROM clean_catalog",
    # 2.4
    "agg_null_counts": f"SELECT {NULL_COUNTS_RAW} FROM raw_catalog",
    "agg_group_avg": "SELECT release_year, round(avg(duration_min), 2) AS mean_minutes "
                     "FROM clean_catalog GROUP BY release_year",
    "agg_group_count": "SELECT performer, count(performer) AS appearances FROM "
                       "(SELECT unnest(string_split(performers, ', ')) AS performer FROM clean_catalog) e "
                       "GROUP BY performer",
    "agg_count_if": "SELECT count(*) FILTER (WHERE kind = 'Movie') AS films, "
                    "count(*) FILTER (WHERE kind = 'TV Show') AS shows FROM clean_catalog",
    "agg_max_min": "SELECT min(added_on) AS first_added, max(added_on) AS last_added, "
                   "CAST(datediff('day', min(added_on), max(added_on)) AS INTEGER) AS days FROM clean_catalog",
    "dedupe_by_key": "SELECT * FROM s_identity",
    "unpivot_wide": _UNPIVOT,
    # 2.5
    "join_inner": _compare("", as_text=False),
    "join_left_outer": "SELECT c.title_id, c.title, d.release_date FROM clean_catalog c "
                       "LEFT JOIN page_dates d ON c.title = d.title",
    # 2.6
    "sort_asc_limit": "SELECT country, mean_minutes FROM country_means ORDER BY country LIMIT 3",
    "topk_desc": "SELECT * FROM music_performers ORDER BY appearances DESC, performer LIMIT 30",
    "top1": "SELECT * FROM top_performer",
    # 2.7
    "udf_count_items": f"SELECT title_id, countries, {_COUNT_ITEMS} AS country_count FROM clean_catalog",
    # 2.8
    "null_profile": _null_profile("raw_catalog", RAW_COLUMNS.split(", ")),
    "null_profile_clean": _null_profile("clean_catalog", CLEAN_COLUMNS),
    "clean_identity": "SELECT * FROM s_identity",
    "clean_text": "SELECT * FROM s_text",
    "clean_title": "SELECT * FROM s_title",
    "clean_duration": "SELECT * FROM s_duration",
    "clean_added_date": "SELECT * FROM s_added_date",
    "clean_year": "SELECT * FROM s_year",
    "clean_rating": "SELECT * FROM s_rating",
    "clean_genre": "SELECT * FROM s_genre",
    "clean_catalog": "SELECT * FROM clean_catalog",
    "clean_catalog_keep": "SELECT * FROM clean_catalog",
    "clean_catalog_as_run": "SELECT * FROM clean_catalog",
    "clean_funnel": _FUNNEL,
    "clean_funnel_keep": _FUNNEL,
    "avg_by_combination": "SELECT * FROM combination_means",
    "avg_formatted": f"SELECT countries, {_minutes_text('mean_minutes')} AS mean_text FROM combination_means",
    "avg_by_country": "SELECT * FROM country_means",
    "avg_by_country_formatted": f"SELECT country, {_minutes_text('mean_minutes')} AS mean_text FROM country_means",
    "avg_by_country_mixed": "SELECT country, round(avg(duration), 2) AS mean_minutes FROM "
                            "(SELECT unnest(string_split(countries, ', ')) AS country, duration "
                            "FROM clean_catalog) e GROUP BY country",
    "compare_country": _compare(f"WHERE p.country IN {COUNTRIES}", as_text=True),
    "compare_country_all": _compare("", as_text=False),
    "compare_country_mixed": "SELECT p.country, " + _minutes_text("c.mean_minutes") + " AS combination_text, "
                             + _minutes_text("p.mean_minutes") + " AS participation_text "
                             "FROM combination_means c JOIN "
                             "(SELECT country, round(avg(duration), 2) AS mean_minutes FROM "
                             "(SELECT unnest(string_split(countries, ', ')) AS country, duration "
                             f"FROM clean_catalog) e GROUP BY country) p ON c.countries = p.country WHERE p.country IN {COUNTRIES}",
    "music_performers": "SELECT * FROM music_performers",
    "top_performer": "SELECT * FROM top_performer",
    "performer_titles": "SELECT * FROM performer_titles",
    "performer_titles_exact": "SELECT * FROM music WHERE list_contains(string_split(performers, ', '), "
                              "(SELECT performer FROM top_performer))",
    "top_performers_bounded": "SELECT performer, count(performer) AS appearances FROM (SELECT "
                              "unnest(string_split(performers, ', ')) AS performer FROM clean_catalog) e "
                              "GROUP BY performer ORDER BY appearances DESC, performer LIMIT 10",
    "top_words_bounded": "SELECT word, count(word) AS appearances FROM (SELECT unnest(string_split(text, ' ')) "
                         "AS word FROM documents) e GROUP BY word ORDER BY appearances DESC, word LIMIT 100",
    "performer_titles_indexed": "SELECT * FROM music WHERE contains(performers, 'Actor 1')",
    "performer_titles_named": "SELECT * FROM music WHERE contains(performers, 'Actor 1')",
    "performer_titles_named_exact": "SELECT * FROM music WHERE "
                                    "list_contains(string_split(performers, ', '), 'Actor 1')",
    "page_release_date": f"SELECT title, CASE WHEN status = 200 THEN {_element_text('html', 'span', 'release')} "
                         "END AS release_text FROM release_pages",
    "page_field": f"SELECT page_id, {_element_text('html', 'div', 'ad')} AS value FROM pages",
    "attach_release_date": "SELECT t.*, d.release_date FROM performer_titles t "
                           "LEFT JOIN page_dates d ON t.title = d.title",
    "release_span": "SELECT min(release_date) AS first_date, max(release_date) AS last_date, "
                    "CAST(datediff('day', min(release_date), max(release_date)) AS INTEGER) AS days, "
                    "CAST(datediff('day', min(release_date), max(release_date)) AS DOUBLE) / 7.0 AS weeks "
                    "FROM (SELECT t.*, d.release_date FROM performer_titles t "
                    "LEFT JOIN page_dates d ON t.title = d.title) j",
    "genre_array": "SELECT title_id, genres, string_split(genres, ',') AS genre_array FROM raw_catalog",
    "genre_array_trimmed": "SELECT title_id, genres, regexp_split_to_array(genres, ',\\s*') AS genre_array "
                           "FROM raw_catalog",
    "coproduction_counts": f"SELECT count(*) FILTER (WHERE {_COUNT_ITEMS} = 1) AS solo_titles, "
                           f"count(*) FILTER (WHERE {_COUNT_ITEMS} > 1) AS coproduced_titles FROM clean_catalog",
    "coproduction_counts_music": f"SELECT count(*) FILTER (WHERE {_COUNT_ITEMS} = 1) AS solo_titles, "
                                 f"count(*) FILTER (WHERE {_COUNT_ITEMS} > 1) AS coproduced_titles FROM music",
    "export_clean_clustered": "SELECT * FROM clean_catalog WHERE release_year BETWEEN 2000 AND 2005",
    "clean_incremental": "SELECT * FROM clean_catalog",
    "export_clean": "SELECT * FROM clean_catalog",
    "export_clean_counted": f"SELECT *, {_COUNT_ITEMS} AS country_count FROM clean_catalog",
}


def _statement(key: str) -> str:
    out = sql(BODIES[key])
    for old, new in REPLACED.get(key, {}).items():
        out = out.replace(old, new)
    return out


ORACLE_SQL = {key: _statement(key) for key in BODIES}
