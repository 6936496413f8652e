"""Named queries over the driver tables: ``key -> (spark, sf_dir) -> DataFrame``.

Every query starts from the parquet tables in ``sf_dir`` (the catalogue and
the release pages are derived from ``orders``, the page fields read
``pages``), so its work grows with the data.  Queries that exercise a file
sink write to a fresh path under the shared checkpoint folder and read it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import exprs as X
from marquee.functions.udfs import count_items
from marquee.operators import clean as C
from marquee.operators import explore as E
from marquee.operators import profile as P
from marquee.operators import substring_index, topk
from marquee.sources import clustered, delimited, derived, files
from marquee.sources.schema import CLEAN_COLUMNS, POSITIONAL_NAMES, RAW_COLUMNS
from marquee.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(key: str):
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key!r}")
        QUERIES[key] = fn
        return fn

    return register


def spread(spark: SparkSession) -> int:
    """Tasks that the derived tables are dealt out to: as many as a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return derived.raw_catalog(spark, sf, spread(spark))


def release_pages(spark: SparkSession, sf: str) -> DataFrame:
    return derived.release_pages(spark, sf, spread(spark))


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean_catalog(raw(spark, sf))


def music(spark: SparkSession, sf: str) -> DataFrame:
    return E.music_titles(clean(spark, sf))


def _roundtrip_text(spark: SparkSession, sf: str, compression: str | None, name: str) -> str:
    path = files.scratch_path(spark, name)
    files.write_catalog_text(raw(spark, sf), path, compression=compression)
    return path


# The cleaning as the analysis script ran it: its date pattern matched nothing.
AS_RUN = {
    "text_patterns": tuple(p for p in X.TEXT_PATTERNS if p != X.DATE_TEXT_PATTERN),
    "title_patterns": tuple(p for p in X.TITLE_PATTERNS if p != X.DATE_TEXT_PATTERN),
}


# --- 2.1 scans, sources, sinks, inspection ---------------------------------


@query("scan_tsv")
def scan_tsv(spark, sf):
    path = _roundtrip_text(spark, sf, None, "scan_tsv")
    return delimited.read_delimited(spark, f"{path}/part-*.csv", RAW_COLUMNS)


@query("scan_tsv_gz")
def scan_tsv_gz(spark, sf):
    path = _roundtrip_text(spark, sf, "gzip", "scan_tsv_gz")
    return files.read_catalog_text(spark, f"{path}/part-*.csv.gz", multiline=True)


@query("infer_schema")
def infer_schema(spark, sf):
    # Over the clean catalogue, so that numbers and dates are there to be found.
    path = files.scratch_path(spark, "infer_schema")
    files.write_catalog_text(clean(spark, sf), path)
    text = delimited.read_delimited(spark, f"{path}/part-*.csv", CLEAN_COLUMNS)
    return P.infer_types(text).select("position", "column_name", "data_type", "non_null")


@query("parquet_roundtrip")
def parquet_roundtrip(spark, sf):
    path = files.write_parquet(raw(spark, sf), files.scratch_path(spark, "raw_parquet"))
    return spark.read.parquet(path)


@query("schema_report")
def schema_report(spark, sf):
    return P.schema_report(clean(spark, sf))


@query("preview")
def preview(spark, sf):
    return P.preview(clean(spark, sf), "title_id", 20)


@query("row_count")
def row_count(spark, sf):
    return P.row_counts(spark, {"raw_catalog": raw(spark, sf), "clean_catalog": clean(spark, sf)})


# --- 2.2 projections, filters, predicates ----------------------------------


@query("rename_columns")
def rename_columns(spark, sf):
    return files.rename_columns(raw(spark, sf).toDF(*POSITIONAL_NAMES))


@query("derive_columns")
def derive_columns(spark, sf):
    return raw(spark, sf).withColumns(
        {
            "duration_min": X.extract_int("duration", X.MINUTES_PATTERN),
            "seasons": X.extract_int("duration", X.SEASONS_PATTERN),
        }
    )


@query("project_alias")
def project_alias(spark, sf):
    return clean(spark, sf).select(
        F.col("title_id").alias("id"), F.col("title").alias("name"), F.col("release_year").alias("year")
    )


@query("drop_columns")
def drop_columns(spark, sf):
    return clean(spark, sf).drop("synopsis", "directors", "performers")


@query("filter_equals")
def filter_equals(spark, sf):
    return clean(spark, sf).filter(F.col("kind") == "Movie")


@query("filter_in_list")
def filter_in_list(spark, sf):
    return clean(spark, sf).filter(F.col("countries").isin(list(E.COMPARED_COUNTRIES)))


@query("filter_not_null")
def filter_not_null(spark, sf):
    return raw(spark, sf).filter(F.col("directors").isNotNull() & F.col("genres").isNotNull())


@query("filter_regex")
def filter_regex(spark, sf):
    return raw(spark, sf).filter(F.col("title").rlike(X.URL_PATTERN))


@query("filter_any_pattern")
def filter_any_pattern(spark, sf):
    return raw(spark, sf).filter(X.matches_any(C.TEXT_COLUMNS, X.TEXT_PATTERNS))


@query("filter_negated_nulls")
def filter_negated_nulls(spark, sf):
    return C.clean_text(raw(spark, sf), null_policy="drop")


@query("filter_negated_keep")
def filter_negated_keep(spark, sf):
    return C.clean_text(raw(spark, sf), null_policy="keep")


@query("filter_contains")
def filter_contains(spark, sf):
    return clean(spark, sf).filter(F.lower("synopsis").contains("music"))


@query("filter_compare")
def filter_compare(spark, sf):
    return clean(spark, sf).filter(F.col("duration") > 90)


@query("filter_and_or")
def filter_and_or(spark, sf):
    c = F.col
    return clean(spark, sf).filter(((c("kind") == "Movie") & (c("duration") > 90)) | (c("seasons") > 3))


@query("case_multi")
def case_multi(spark, sf):
    return raw(spark, sf).select(
        "title_id", "rating", X.normalised_rating(F.trim("rating")).alias("rating_norm")
    )


@query("case_single")
def case_single(spark, sf):
    return raw(spark, sf).select(
        "title_id", "duration", X.extract_int("duration", X.MINUTES_PATTERN).alias("duration_min")
    )


# --- 2.3 casts and scalar functions ----------------------------------------


@query("cast_int_lenient")
def cast_int_lenient(spark, sf):
    return raw(spark, sf).select(
        "title_id",
        X.lenient_int("title_id").alias("title_id_int"),
        X.lenient_int("release_year").alias("year_int"),
    )


@query("cast_bool_int")
def cast_bool_int(spark, sf):
    return raw(spark, sf).select(
        "title_id",
        F.col("directors").isNull().cast("int").alias("directors_null"),
        F.col("genres").isNull().cast("int").alias("genres_null"),
    )


@query("cast_int_text")
def cast_int_text(spark, sf):
    id_text = F.col("title_id").cast("string")
    return clean(spark, sf).select("title_id", id_text.alias("id_text"), F.length(id_text).alias("id_length"))


def _combination_means(spark, sf, digits=2):
    return E.avg_by(clean(spark, sf), "countries", digits=digits)


@query("cast_double_int")
def cast_double_int(spark, sf):
    m = F.col("mean_minutes")
    return _combination_means(spark, sf).select(
        "countries", "mean_minutes", F.round((m - F.floor(m)) * 60, 0).cast("int").alias("seconds")
    )


@query("parse_date")
def parse_date(spark, sf):
    return raw(spark, sf).select(
        "title_id", "added_on", X.lenient_date(F.trim("added_on")).alias("added_date")
    )


@query("fn_trim")
def fn_trim(spark, sf):
    return raw(spark, sf).select(
        "title_id", F.trim("added_on").alias("added_trim"), F.trim("rating").alias("rating_trim")
    )


@query("fn_lower")
def fn_lower(spark, sf):
    return clean(spark, sf).select("title_id", F.lower("synopsis").alias("synopsis_lower"))


@query("fn_length")
def fn_length(spark, sf):
    return raw(spark, sf).select(
        "title_id", F.length("title_id").alias("id_length"), F.length("title").alias("title_length")
    )


@query("fn_split")
def fn_split(spark, sf):
    return clean(spark, sf).select("title_id", F.split("countries", ", ").alias("country_list"))


@query("fn_regexp_extract")
def fn_regexp_extract(spark, sf):
    return raw(spark, sf).select(
        "title_id",
        "duration",
        F.regexp_extract("duration", X.MINUTES_PATTERN, 1).alias("minutes_text"),
        F.regexp_extract("duration", X.SEASONS_PATTERN, 1).alias("seasons_text"),
    )


@query("fn_concat")
def fn_concat(spark, sf):
    return raw(spark, sf).select(
        "title_id",
        F.expr("concat(title, ' (', release_year, ')')").alias("title_year"),
        F.concat("directors", F.lit(" - "), "title").alias("director_title"),
    )


@query("fn_round")
def fn_round(spark, sf):
    m = F.avg("duration_min")
    return clean(spark, sf).groupBy("countries").agg(
        F.round(m, 2).alias("mean_2"), F.round(m, 0).alias("mean_0")
    )


@query("fn_floor")
def fn_floor(spark, sf):
    return _combination_means(spark, sf).select(
        "countries", F.floor("mean_minutes").alias("whole_minutes")
    )


@query("fn_arith")
def fn_arith(spark, sf):
    d = F.col("duration")
    return clean(spark, sf).select(
        "title_id",
        (d - 60).alias("over_hour"),
        (d * 60).alias("seconds"),
        (F.col("release_year") + 1).alias("next_year"),
        (d / 7.0).alias("per_week"),
    )


@query("fn_array_get")
def fn_array_get(spark, sf):
    return raw(spark, sf).select("title_id", "duration", X.first_token("duration").alias("first_token"))


@query("fn_datediff")
def fn_datediff(spark, sf):
    year_start = F.make_date("release_year", F.lit(1), F.lit(1))
    return clean(spark, sf).select(
        "title_id", "added_on", F.datediff("added_on", year_start).alias("days_since_year_start")
    )


@query("explode_list")
def explode_list(spark, sf):
    return clean(spark, sf).select("title_id", F.explode(F.split("countries", ", ")).alias("country"))


@query("fn_count_items")
def fn_count_items(spark, sf):
    return clean(spark, sf).select("title_id", "countries", X.item_count("countries").alias("country_count"))


# --- 2.4 aggregation, distinct, reshape ------------------------------------


@query("agg_null_counts")
def agg_null_counts(spark, sf):
    return P.null_counts(raw(spark, sf))


@query("agg_group_avg")
def agg_group_avg(spark, sf):
    return E.avg_by(clean(spark, sf), "release_year")


@query("agg_group_count")
def agg_group_count(spark, sf):
    return E.frequent_items(clean(spark, sf))


@query("agg_count_if")
def agg_count_if(spark, sf):
    kind = F.col("kind")
    return clean(spark, sf).agg(
        F.count_if(kind == "Movie").alias("films"), F.count_if(kind == "TV Show").alias("shows")
    )


@query("agg_max_min")
def agg_max_min(spark, sf):
    return clean(spark, sf).agg(
        F.min("added_on").alias("first_added"),
        F.max("added_on").alias("last_added"),
        F.datediff(F.max("added_on"), F.min("added_on")).alias("days"),
    )


@query("dedupe_by_key")
def dedupe_by_key(spark, sf):
    return C.clean_identity(raw(spark, sf))


@query("unpivot_wide")
def unpivot_wide(spark, sf):
    wide = clean(spark, sf).groupBy("kind").agg(
        F.round(F.avg("duration_min"), 2).alias("mean_minutes"),
        F.round(F.avg("seasons"), 2).alias("mean_seasons"),
        F.round(F.avg("release_year"), 2).alias("mean_year"),
    )
    return wide.unpivot(["kind"], ["mean_minutes", "mean_seasons", "mean_year"], "metric", "value")


# --- 2.5 joins ----------------------------------------------------------------


@query("join_inner")
def join_inner(spark, sf):
    return E.compare_country_join(clean(spark, sf))


@query("join_left_outer")
def join_left_outer(spark, sf):
    titles = clean(spark, sf).select("title_id", "title")
    return E.attach_dates(titles, E.release_dates(release_pages(spark, sf)))


# --- 2.6 sort, limit, top-k -----------------------------------------------------


@query("sort_asc_limit")
def sort_asc_limit(spark, sf):
    return E.avg_by_item(clean(spark, sf), "countries", "country").orderBy("country").limit(3)


@query("topk_desc")
def topk_desc(spark, sf):
    return E.top_items(E.frequent_items(music(spark, sf)), 30)


@query("top1")
def top1(spark, sf):
    return E.top_items(E.frequent_items(music(spark, sf)), 1)


# --- 2.7 UDF surface -------------------------------------------------------------


@query("udf_count_items")
def udf_count_items(spark, sf):
    return clean(spark, sf).select("title_id", "countries", count_items("countries").alias("country_count"))


# --- 2.8 composite operations ---------------------------------------------------


@query("null_profile")
def null_profile(spark, sf):
    return P.null_profile(raw(spark, sf))


@query("null_profile_clean")
def null_profile_clean(spark, sf):
    return P.null_profile(clean(spark, sf))


def _stage_query(stage: str) -> Query:
    def run(spark, sf):
        return C.clean_until(raw(spark, sf), stage)

    return run


for _stage in C.STAGES:
    query(f"clean_{_stage}")(_stage_query(_stage))


@query("clean_catalog")
def clean_catalog(spark, sf):
    return clean(spark, sf)


@query("clean_catalog_keep")
def clean_catalog_keep(spark, sf):
    return C.clean_catalog(raw(spark, sf), null_policy="keep")


@query("clean_catalog_as_run")
def clean_catalog_as_run(spark, sf):
    return C.clean_catalog(raw(spark, sf), **AS_RUN)


@query("clean_funnel")
def clean_funnel(spark, sf):
    return C.clean_funnel(raw(spark, sf))


@query("clean_funnel_keep")
def clean_funnel_keep(spark, sf):
    return C.clean_funnel(raw(spark, sf), null_policy="keep")


@query("avg_by_combination")
def avg_by_combination(spark, sf):
    return E.avg_by(clean(spark, sf), "countries")


@query("avg_formatted")
def avg_formatted(spark, sf):
    return E.formatted(E.avg_by(clean(spark, sf), "countries"), "mean_minutes")


@query("avg_by_country")
def avg_by_country(spark, sf):
    return E.avg_by_item(clean(spark, sf), "countries", "country")


@query("avg_by_country_formatted")
def avg_by_country_formatted(spark, sf):
    return E.formatted(E.avg_by_item(clean(spark, sf), "countries", "country"), "mean_minutes")


@query("avg_by_country_mixed")
def avg_by_country_mixed(spark, sf):
    return E.avg_by_item(clean(spark, sf), "countries", "country", value="duration")


@query("compare_country")
def compare_country(spark, sf):
    return E.compare_country(clean(spark, sf), E.COMPARED_COUNTRIES, as_text=True)


@query("compare_country_all")
def compare_country_all(spark, sf):
    return E.compare_country(clean(spark, sf))


@query("compare_country_mixed")
def compare_country_mixed(spark, sf):
    # The second mean is over minutes and season counts alike.
    return E.compare_country(
        clean(spark, sf), E.COMPARED_COUNTRIES, as_text=True, participation_value="duration"
    )


@query("music_performers")
def music_performers(spark, sf):
    return E.frequent_items(music(spark, sf))


@query("top_performer")
def top_performer(spark, sf):
    return E.top_performer(music(spark, sf))


@query("top_performers_bounded")
def top_performers_bounded(spark, sf):
    stored = files.materialize(clean(spark, sf).select("performers"), "performers")
    return topk.top_items_bounded(E.explode_items(stored, "performers", "performer"), 10, "performer")


@query("top_words_bounded")
def top_words_bounded(spark, sf):
    texts = derived.load_table(spark, sf, "documents").select("text")
    return topk.top_items_bounded(E.explode_items(texts, "text", "word", sep=" "), 100, "word")


def _performer_titles(spark, sf, name=None, exact=False):
    titles = music(spark, sf)
    who = E.top_performer_name(titles) if name is None else name
    return E.performer_titles(titles, who, exact=exact)


@query("performer_titles")
def performer_titles(spark, sf):
    return _performer_titles(spark, sf)


@query("performer_titles_exact")
def performer_titles_exact(spark, sf):
    return _performer_titles(spark, sf, exact=True)


@query("performer_titles_named")
def performer_titles_named(spark, sf):
    return _performer_titles(spark, sf, name="Actor 1")


@query("performer_titles_indexed")
def performer_titles_indexed(spark, sf):
    path = substring_index.build(music(spark, sf), "performers", files.scratch_path(spark, "performer_index"))
    return substring_index.search(spark, path, "performers", ["Actor 1"]).drop("name")


@query("performer_titles_named_exact")
def performer_titles_named_exact(spark, sf):
    return _performer_titles(spark, sf, name="Actor 1", exact=True)


@query("page_release_date")
def page_release_date(spark, sf):
    return E.extract_field(release_pages(spark, sf), "span", "release", alias="release_text")


@query("page_field")
def page_field(spark, sf):
    pages = derived.load_table(spark, sf, "pages")
    return E.extract_field(pages, "div", "ad", key="page_id", status=None)


def _attached(spark, sf):
    return E.attach_dates(
        _performer_titles(spark, sf), E.release_dates(release_pages(spark, sf))
    )


@query("attach_release_date")
def attach_release_date(spark, sf):
    return _attached(spark, sf)


@query("release_span")
def release_span(spark, sf):
    return E.date_span(_attached(spark, sf))


@query("genre_array")
def genre_array(spark, sf):
    return E.item_array(raw(spark, sf).select("title_id", "genres"))


@query("genre_array_trimmed")
def genre_array_trimmed(spark, sf):
    return E.item_array(raw(spark, sf).select("title_id", "genres"), trim=True)


@query("coproduction_counts")
def coproduction_counts(spark, sf):
    return E.coproduction_counts(clean(spark, sf))


@query("coproduction_counts_music")
def coproduction_counts_music(spark, sf):
    return E.coproduction_counts(music(spark, sf))


@query("export_clean")
def export_clean(spark, sf):
    path = files.write_parquet(clean(spark, sf), files.scratch_path(spark, "clean_export"))
    return spark.read.parquet(path)


@query("export_clean_counted")
def export_clean_counted(spark, sf):
    counted = clean(spark, sf).withColumn("country_count", X.item_count("countries"))
    path = files.write_parquet(counted, files.scratch_path(spark, "clean_export"))
    return spark.read.parquet(path)


@query("export_clean_clustered")
def export_clean_clustered(spark, sf):
    path = files.scratch_path(spark, "clean_clustered")
    clustered.write_clustered(clean(spark, sf), path, "kind", "release_year")
    return clustered.read_clustered(spark, path, "release_year", 2000, 2005)


@query("clean_incremental")
def clean_incremental(spark, sf):
    # The text lands in files; each trigger cleans some of them, and all epochs but the last are folded into a base.
    path = files.scratch_path(spark, "incremental")
    files.write_catalog_text(raw(spark, sf), f"{path}/in")
    stream = incremental.catalog_stream(spark, f"{path}/in", max_files_per_trigger=4, multiline=True)
    incremental.start_clean_stream(stream, f"{path}/out", f"{path}/state").awaitTermination()
    incremental.compact(spark, f"{path}/out")
    return incremental.read_clean(spark, f"{path}/out")
