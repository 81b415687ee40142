"""Launch months, seasons and sortable launch times. All take the date they are judged from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomcat.functions.text import strip, title_case, to_int

# Months of each season, and the season words a brand may use.
SEASON_MONTHS = {
    "Winter": [12, 1, 2],
    "Spring": [3, 4, 5],
    "Summer": [6, 7, 8],
    "Fall": [9, 10, 11],
}
SEASON_WORDS = ["summer", "winter", "spring", "fall", "autumn"]
NO_SEASON = "Collection"


def launch_month(launch: Column) -> Column:
    """Number before a dot, else the second hyphen part, else the whole text; NULL if unreadable."""
    return (
        F.when(launch.contains("."), to_int(F.substring_index(launch, ".", 1)))
        .when(launch.contains("-"), to_int(F.split_part(launch, F.lit("-"), F.lit(2))))
        .otherwise(to_int(launch))
    )


def season_of_month(month: Column) -> Column:
    result = F.lit(None).cast("string")
    for season, months in SEASON_MONTHS.items():
        result = F.when(month.isin(months), F.lit(season)).otherwise(result)
    return result


def collection_label(season: Column, month: Column, as_of: Column) -> Column:
    """Season and year. The brand's season counts if it is a real season or no month tells."""
    named = F.nullif(title_case(strip(F.coalesce(season, F.lit("")))), F.lit(""))
    by_month = season_of_month(month)
    shown = F.when(F.lower(named).isin(SEASON_WORDS), named).otherwise(F.coalesce(by_month, named))
    unified = F.when(F.lower(shown) == "autumn", F.lit("Fall")).otherwise(shown)
    labelled = F.concat_ws(" ", unified, F.year(as_of).cast("string"))
    return F.when(unified.isNull(), F.lit(NO_SEASON)).otherwise(labelled)


def launch_time(month: Column, as_of: Column) -> Column:
    """YYYY-MM. Early in the year a month from October on belongs to the year before."""
    this_month, this_year = F.month(as_of), F.year(as_of)
    used = F.coalesce(F.nullif(month, F.lit(0)), this_month)
    previous = (this_month <= 3) & (used >= 10) & (this_month <= used)
    year = F.when(previous, this_year - 1).otherwise(this_year)
    return F.format_string("%d-%02d", year, used)


def file_stamp(moment: Column) -> Column:
    """Stamp used in output file names."""
    return F.date_format(moment, "yyyyMMdd_HHmmss")


def run_id(moment: Column) -> Column:
    """Run identifier: whole seconds since the epoch."""
    return F.unix_timestamp(moment).cast("string")
