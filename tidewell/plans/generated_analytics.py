"""§2.G relational analytics over the generated public-sector tables (the ``H`` form).

The queries are the source notebook's, as DataFrame plans over the tables of
``plans.datasets``. Averages of decimals are taken as DOUBLE and rounded to
4 places so the results compare across engines; sorts get full tie-breaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.topk import top_k
from ..sources.fixtures import Tables
from . import datasets as D


def _avg(c, n=4):
    return F.round(F.avg(F.col(c).cast("double")), n)


def _share(c):
    return F.round(F.avg(F.col(c).cast("int").cast("double")), 4)


def _sum2(c):
    return F.sum(c).cast("decimal(38,2)").cast("double")


def g1_enrolments_per_semester(t: Tables) -> DataFrame:
    return (D.enrollment_events(t).filter(F.col("action") == "enroll")
            .groupBy("semester")
            .agg(F.count("*").alias("enrollments"), F.count_distinct("student_id").alias("unique_students"))
            .orderBy("semester"))


def g2_students_by_status_campus(t: Tables) -> DataFrame:
    return (D.students(t).groupBy("status", "campus")
            .agg(F.count("*").alias("students"), _avg("gpa").alias("avg_gpa"),
                 _avg("total_credits").alias("avg_credits"))
            .orderBy(F.desc("students"), "status", "campus"))


def g3_expenditure_by_fund_year(t: Tables) -> DataFrame:
    return (D.budget_transactions(t).filter(F.col("transaction_type") == "expenditure")
            .groupBy("fund_category", "fiscal_year")
            .agg(F.count("*").alias("transactions"), _sum2("amount").alias("total_spent"))
            .orderBy("fiscal_year", F.desc("total_spent"), "fund_category"))


def g4_vendor_diversity(t: Tables) -> DataFrame:
    return (D.vendors(t).groupBy("type")
            .agg(F.count("*").alias("vendors"), _share("minority_owned").alias("pct_minority"),
                 _share("small_business").alias("pct_small_biz"), _share("woman_owned").alias("pct_woman_owned"),
                 _avg("annual_revenue", 2).alias("avg_revenue"))
            .orderBy(F.desc("vendors"), "type"))


def g5_request_resolution(t: Tables) -> DataFrame:
    return (D.service_requests(t).groupBy("request_type", "priority")
            .agg(F.count("*").alias("requests"), _avg("response_time_hours").alias("avg_response_hours"),
                 _avg("satisfaction_rating").alias("avg_satisfaction"))
            .orderBy(F.desc("requests"), "request_type", "priority"))


def g6_asset_condition_by_district(t: Tables) -> DataFrame:
    return (D.assets(t).groupBy("district", "condition")
            .agg(F.count("*").alias("assets"), _avg("replacement_cost", 2).alias("avg_replacement_cost"))
            .orderBy("district", "condition"))


def g7_high_risk_by_school(t: Tables) -> DataFrame:
    """Filter before the join; the school side is one row per school (small, broadcast by AQE)."""
    k12 = D.k12_students(t).filter(F.col("risk_score") > 70).select("school_id", "risk_score", "attendance_rate")
    sch = D.schools(t).select("school_id", "name", "type")
    return (k12.join(sch, "school_id")
            .groupBy("name", "type")
            .agg(F.count("*").alias("high_risk_students"), _avg("risk_score").alias("avg_risk_score"),
                 _avg("attendance_rate").alias("avg_attendance"))
            .orderBy(F.desc("high_risk_students"), "name", "type"))


def g8_risk_by_grade(t: Tables) -> DataFrame:
    return (D.k12_students(t).groupBy("grade_level")
            .agg(F.count("*").alias("students"), _avg("risk_score").alias("avg_risk"), _avg("gpa").alias("avg_gpa"),
                 _share("free_reduced_lunch").alias("pct_frl"), _share("english_learner").alias("pct_ell"),
                 _share("special_education").alias("pct_sped"))
            .orderBy("grade_level"))


def g9_contracts_by_category_method(t: Tables) -> DataFrame:
    return (D.contracts(t).groupBy("category", "method")
            .agg(F.count("*").alias("contracts"), _sum2("amount").alias("total_value"),
                 _avg("amount", 2).alias("avg_value"), _avg("duration_months").alias("avg_duration"))
            .orderBy(F.desc("total_value"), "category", "method"))


def g10_benefits_by_program(t: Tables) -> DataFrame:
    return (D.cases(t).groupBy("program", "determination")
            .agg(F.count("*").alias("cases"), _avg("benefit_amount", 2).alias("avg_benefit"),
                 _sum2("benefit_amount").alias("total_benefits"))
            .orderBy(F.desc("total_benefits"), "program", "determination"))


def g11_client_demographics(t: Tables) -> DataFrame:
    return (D.clients(t).groupBy("income_bracket", "primary_language")
            .agg(F.count("*").alias("clients"), _avg("household_size").alias("avg_household"),
                 _share("veteran").alias("pct_veteran"), _share("disabled").alias("pct_disabled"))
            .orderBy(F.desc("clients"), "income_bracket", "primary_language"))


def g12_totals_per_table(t: Tables) -> DataFrame:
    """Row count of every generated table, one row per (use case, table)."""
    parts = []
    for use_case, tables in D.DATASETS.items():
        for name, build in tables.items():
            parts.append(build(t).agg(F.count("*").alias("row_count"))
                         .select(F.lit(use_case).alias("use_case"), F.lit(name).alias("table_name"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def g15_student_activity(t: Tables, k: int = 20) -> DataFrame:
    """Events joined to students, grouped by name, gpa, campus; top k by count.

    The fact side is pre-aggregated per student before the join, so the
    join moves one row per student instead of one per event.
    """
    ev = (D.enrollment_events(t).groupBy("student_id")
          .agg(F.count("*").alias("n"), F.sum(F.col("gpa_impact").cast("double")).alias("s")))
    st = D.students(t).select("student_id", "name", "gpa", "campus")
    j = (ev.join(st, "student_id")
         .groupBy("name", "gpa", "campus")
         .agg(F.sum("n").alias("events"), F.round(F.sum("s") / F.sum("n"), 4).alias("avg_gpa_impact")))
    return top_k(j.withColumn("gpa", F.col("gpa").cast("double")), k,
                 [F.desc("events"), "name", "gpa", "campus"])


def g13_survey_scores(t: Tables) -> DataFrame:
    from .user_tables import survey_responses
    return (survey_responses(t).groupBy("product", "category")
            .agg(F.count("*").alias("responses"), _avg("overall_score").alias("avg_score"), _avg("nps_score").alias("avg_nps"))
            .orderBy(F.desc("responses"), "product", "category"))


def g14_fleet_events(t: Tables) -> DataFrame:
    from .user_tables import vehicle_events
    return (vehicle_events(t).groupBy("vehicle_type", "event_type")
            .agg(F.count("*").alias("events"), _avg("speed_mph").alias("avg_speed"),
                 _avg("fuel_pct").alias("avg_fuel"))
            .orderBy(F.desc("events"), "vehicle_type", "event_type"))
