"""Full analysis of one table."""

from functools import cached_property

from pyspark.sql import DataFrame

from gleaner.functions.columns import all_named, finite
from gleaner.functions.fixed import depth_limits
from gleaner.functions.storage import materialise
from gleaner.operators import anomalies, correlation, groups, insights, isolation, profile, ranking, schema, trends


class TableAnalysis:
    """Roles, statistics, groups, trends, outliers and ranked findings of a table.

    Every result is a DataFrame that is planned on first use, or None where the table lacks the columns for it. Results
    of a few rows per column that other results read are written once, so that the table is not scanned for each reader.
    """

    def __init__(self, df: DataFrame, keys: list[str], columns: list[str] | None = None, depth: int = 3, forest: bool = True):
        self.keys, self.depth, self.forest = keys, depth, forest
        wanted = columns or [c for c in df.columns if c not in keys]
        carried = [k for k in keys if k not in wanted]
        self.table, found = schema.detect_roles(finite(df.select(*all_named([*carried, *wanted]))))
        self.roles = schema.Roles(*[[c for c in role if c in wanted] for role in (found.numerical, found.categorical, found.datetime)])
        self._measured = self.table.drop(*carried)

    @cached_property
    def kpis(self) -> DataFrame:
        return profile.kpis(self._measured, self.roles)

    @cached_property
    def schema(self) -> DataFrame:
        return schema.schema_profile(self._measured)

    @cached_property
    def missing(self) -> DataFrame:
        return profile.missing_values(self._measured)

    @cached_property
    def stats(self) -> DataFrame | None:
        nums = self.roles.numerical
        return materialise(profile.numeric_stats(self.table, nums), "stats") if nums else None

    @cached_property
    def categories(self) -> DataFrame | None:
        cats = self.roles.categorical
        return profile.category_profile(self.table, cats) if cats else None

    @cached_property
    def groups(self) -> DataFrame | None:
        nums = self.roles.numerical
        narrow = profile.narrow_columns(self.table, self.roles.categorical, groups.GROUP_CARDINALITY) if nums else []
        return materialise(groups.groupby_tables(self.table, narrow, nums), "groups") if narrow else None

    @cached_property
    def trends(self) -> DataFrame | None:
        """Calendar trends, or row-order trends where there are none."""
        nums, dates = self.roles.numerical, self.roles.datetime
        if not nums:
            return None
        if dates:
            found = materialise(trends.datetime_trend(self.table, dates, nums), "trends")
            if not found.isEmpty():
                return found
        return materialise(trends.index_trend(self.table, self.keys, nums), "trends")

    @cached_property
    def _pairs(self) -> DataFrame:
        return materialise(correlation.correlations(self.table, self.roles.numerical), "correlations")

    @cached_property
    def correlation(self) -> DataFrame | None:
        nums = self.roles.numerical
        return correlation.correlation_matrix(self.table, nums, self._pairs) if len(nums) > 1 else None

    @cached_property
    def top_correlation(self) -> DataFrame | None:
        nums = self.roles.numerical
        return correlation.top_correlation(self.table, nums, self._pairs) if len(nums) > 1 else None

    @cached_property
    def flagged(self) -> DataFrame | None:
        nums = self.roles.numerical
        return isolation.flag_anomalies(self.table, self.keys, nums) if nums and self.forest else None

    @cached_property
    def anomaly_summary(self) -> DataFrame | None:
        nums = self.roles.numerical
        return materialise(anomalies.anomaly_summary(self.table, nums, self.flagged), "anomalies") if nums else None

    @cached_property
    def anomaly_warning(self) -> str | None:
        return anomalies.guard_warning(self.table, self.roles.numerical)

    @cached_property
    def anomaly_rows(self) -> DataFrame | None:
        return None if self.flagged is None else isolation.anomaly_rows(self.table, self.keys, self.roles.numerical, flagged=self.flagged)

    @cached_property
    def insights(self) -> DataFrame:
        if not self.roles.numerical:
            # Every finding about a table starts from a number.
            return self.table.sparkSession.createDataFrame([], insights.SCHEMA)
        return insights.data_insights(
            self.stats, self.trends, self.anomaly_summary, self.groups, self.top_correlation, self.depth)

    @cached_property
    def ranked(self) -> DataFrame:
        return ranking.rank_insights(self.insights, [], depth_limits(self.depth)["data_ranked"])


def analyse_table(
    df: DataFrame, keys: list[str], columns: list[str] | None = None, depth: int = 3, forest: bool = True
) -> TableAnalysis:
    """``keys`` identify and order the rows; ``columns`` limits every operator to those columns."""
    return TableAnalysis(df, keys, columns, depth, forest)
