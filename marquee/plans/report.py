"""The whole analysis as one run: clean once, explore many times.

The script this library replaces ran 27 actions, each re-reading the text and
re-running the de-duplication.  Here the de-duplicated catalogue is computed
once and written as Parquet to the shared folder (``spark.checkpoint.dir``);
every exploration then reads that table, pruned to the columns it needs.
Results are returned as lazy DataFrames keyed like ``queries()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import clean as C
from marquee.operators import explore as E
from marquee.operators import profile as P
from marquee.sources import derived
from marquee.sources.files import materialize
from marquee.sources.schema import CLEAN_COLUMNS


def catalog_report(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> dict[str, DataFrame]:
    """``report_from`` the derived tables; ``partitions`` as for ``derived.raw_catalog``."""
    return report_from(
        derived.raw_catalog(spark, sf_dir, partitions), derived.release_pages(spark, sf_dir, partitions))


def report_from(raw: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """All outputs from a raw catalogue and a fetched-pages table.

    The one shuffle of the cleaning chain runs once: the de-duplicated rows are
    written with their cumulative stage flags, and both the clean catalogue
    (``valid`` rows) and the funnel are read from that table.  A raw input
    that is gzip text is best converted first (``materialize``), since the
    raw rows are read again for the null profile, funnel and genre arrays.
    """
    flagged = materialize(
        C.annotate_validity(C.clean_identity(raw), flags=True), "catalog_flagged"
    )
    clean = flagged.filter(F.col("valid")).select(*CLEAN_COLUMNS)
    music = E.music_titles(clean)
    titles = E.performer_titles(music, E.top_performer_name(music))
    dated = E.attach_dates(titles, E.release_dates(pages))
    return {
        "null_profile": P.null_profile(raw),
        "null_profile_clean": P.null_profile(clean),
        "clean_funnel": C.funnel_counts(raw, flagged),
        "avg_by_combination": E.avg_by(clean, "countries"),
        "avg_formatted": E.formatted(E.avg_by(clean, "countries"), "mean_minutes"),
        "avg_by_country": E.avg_by_item(clean, "countries", "country"),
        "avg_by_country_formatted": E.formatted(
            E.avg_by_item(clean, "countries", "country"), "mean_minutes"),
        "compare_country": E.compare_country(clean, E.COMPARED_COUNTRIES, as_text=True),
        "compare_country_all": E.compare_country(clean),
        "music_performers": E.frequent_items(music),
        "top_performer": E.top_performer(music),
        "performer_titles": titles,
        "attach_release_date": dated,
        "release_span": E.date_span(dated),
        "genre_array": E.item_array(raw.select("title_id", "genres")),
        "coproduction_counts": E.coproduction_counts(clean),
    }
