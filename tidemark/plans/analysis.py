"""The whole analysis of many shops in one job, from events to classified anomaly groups.

Raw events are read once.  Each stage that several later ones use is written to the shared
work folder; everything after the cube has at most one row per shop, hour and series.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import baseline as B
from tidemark.operators import classify as K
from tidemark.operators import contributors as C
from tidemark.operators import cube as Q
from tidemark.operators import groups as G
from tidemark.operators import history as H
from tidemark.operators import patterns as P
from tidemark.operators import report as R
from tidemark.operators import scenarios as S
from tidemark.plans.profiles import Profile, member_table, metric_table
from tidemark.sources import sinks
from tidemark.sources.work import WorkTables


class Analysis:
    """Stages of one run; each is built when first asked for.

    ``start`` and ``end`` bound the analysis: events outside ``start <= time < end`` are left out by
    the scan, and the hour spine covers that window; without them it covers the data.
    A ``with`` block removes the work tables at its end.
    """

    def __init__(self, events: DataFrame, profile: Profile, work: WorkTables | None = None,
                 forecaster=None, gap: int = G.GAP_HOURS,
                 sign_rule: str = "first_nonzero", min_hours: int = 1, start=None, end=None):
        self.spark: SparkSession = events.sparkSession
        self.start, self.end = (None if t is None else F.lit(str(t)).cast("timestamp_ntz") for t in (start, end))
        if self.start is not None:
            events = events.where(F.col("event_timestamp") >= self.start)
        if self.end is not None:
            events = events.where(F.col("event_timestamp") < self.end)
        self.events, self.profile = events, profile
        self.work = work or WorkTables(self.spark)
        self.forecaster, self.gap, self.sign_rule, self.min_hours = forecaster, gap, sign_rule, min_hours
        self.metric_names = [m.name for m in profile.modelled]
        self.member_rows = profile.member_rows()

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *error) -> None:
        self.work.close()

    @cached_property
    def members(self) -> DataFrame:
        return member_table(self.spark, self.profile)

    @cached_property
    def metrics(self) -> DataFrame:
        return metric_table(self.spark, self.profile)

    @cached_property
    def activity(self) -> DataFrame:
        return self.work.keep(Q.activity(self.events, self.profile), "activity")

    @cached_property
    def cube(self) -> DataFrame:
        return self.work.keep(Q.kpi_cube(self.activity, self.profile), "cube")

    @cached_property
    def series(self) -> DataFrame:
        return Q.dense_series(self.cube, self.profile)

    @cached_property
    def forecast(self) -> DataFrame:
        if self.forecaster is None:
            return B.seasonal_baseline(self.series, weekday=self.profile.weekday, break_rounds=self.profile.break_rounds)
        return self.forecaster(self.series)

    @cached_property
    def scored(self) -> DataFrame:
        return self.work.keep(B.score(self.forecast), "scored")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.work.keep(C.hour_vectors(self.scored, self.profile), "vectors")

    @cached_property
    def distances(self) -> DataFrame:
        return C.nn_distance(self.vectors)

    @cached_property
    def eps(self) -> DataFrame:
        return C.knee_eps(self.distances, self.profile.knee, self.profile.sensitivity)

    @cached_property
    def by_dim(self) -> DataFrame:
        return self.work.keep(C.max_contributors(self.vectors, self.eps), "contributors")

    @cached_property
    def contributors(self) -> DataFrame:
        return C.contributors_combined(self.by_dim)

    @cached_property
    def hour_report(self) -> DataFrame:
        report = R.hour_metrics(self.scored, self.profile.metric_rows(), self.contributors, self.start, self.end)
        return self.work.keep(report, "hour_report")

    @cached_property
    def member_report(self) -> DataFrame:
        return R.member_report(self.scored, self.member_rows, self.start, self.end)

    @cached_property
    def wide_report(self) -> DataFrame:
        """Hour report with the columns of every metric and member."""
        members = R.wide_member_report(self.member_report, self.member_rows)
        return R.wide_report(self.hour_report, self.metric_names).join(members, ["tenant", "hour"], "left")

    @cached_property
    def hours(self) -> DataFrame:
        return R.hour_events(self.hour_report)

    @cached_property
    def top(self) -> DataFrame:
        return R.top_event(self.hour_report)

    @cached_property
    def signed(self) -> DataFrame:
        return R.hour_sign(self.scored, self.hour_report, self.members, self.sign_rule)

    @cached_property
    def grouped(self) -> DataFrame:
        return self.work.keep(G.anomaly_groups(self.signed, self.gap), "groups")

    @cached_property
    def spans(self) -> DataFrame:
        return G.group_spans(self.grouped, self.min_hours)

    @cached_property
    def group_metrics(self) -> DataFrame:
        return G.group_metrics(self.grouped, self.hour_report)

    @cached_property
    def group_report(self) -> DataFrame:
        return G.group_report(self.grouped, self.group_metrics, self.metric_names, self.min_hours)

    @cached_property
    def wide_group_report(self) -> DataFrame:
        """Group report with the means of every member."""
        members = G.wide_group_members(G.group_members(self.grouped, self.member_report), self.member_rows)
        return self.group_report.join(members, ["tenant", "group_id"], "left")

    @cached_property
    def group_hours(self) -> DataFrame:
        return S.group_hours(self.spans, self.top)

    @cached_property
    def scenarios(self) -> DataFrame:
        return self.work.keep(S.scenarios(self.spans, self.group_hours), "scenarios")

    def history(self, top_level_only: bool = False) -> DataFrame:
        rows = [r for r in self.member_rows if not top_level_only or r["dim"] == "total"]
        scored = B.top_level(self.scored).withColumns({
            "dim": F.lit("total"), "member": F.lit("Total")}) if top_level_only else self.scored
        return H.historical_changes(self.spans, scored, rows)

    @cached_property
    def classified(self) -> DataFrame:
        return K.classify(self.scenarios, self.history(top_level_only=True))

    @cached_property
    def summary_rows(self) -> DataFrame:
        return self.work.keep(G.summary_groups(self.top, self.gap), "summary_groups")

    @cached_property
    def summary_lines(self) -> DataFrame:
        return P.summary_lines(self.summary_rows, self.contributors, self.metrics)

    def write(self, folder: str) -> None:
        """Cube as Parquet, reports as CSV, scenarios and classes as JSON."""
        folder = folder.rstrip("/")
        sinks.write_cube(self.cube, f"{folder}/kpi_cube")
        sinks.write_report_csv(self.wide_report, f"{folder}/anomaly_report")
        sinks.write_report_csv(self.wide_group_report, f"{folder}/anomaly_group_report")
        sinks.write_report_csv(H.nested_history(self.history()), f"{folder}/historical_analysis_report")
        sinks.write_report_csv(self.summary_lines, f"{folder}/summary")
        sinks.write_json(self.scenarios, f"{folder}/anomaly_scenarios")
        sinks.write_json(K.reasons(self.classified), f"{folder}/anomaly_classifications")
