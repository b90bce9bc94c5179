"""Registry of named queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Tables
from . import fixture_analytics as FA

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str, fn: Callable[[Tables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir, _fn=fn: _fn(Tables(spark, sf_dir))


for _name, _fn in [
    ("g1_orders_per_priority", FA.g1_orders_per_priority),
    ("g2_customers_by_segment_nation", FA.g2_customers_by_segment_nation),
    ("g3_lineitem_by_status_year", FA.g3_lineitem_by_status_year),
    ("g4_order_status_shares", FA.g4_order_status_shares),
    ("g5_null_skipping_avg", FA.g5_null_skipping_avg),
    ("g7_big_orders_by_segment", FA.g7_big_orders_by_segment),
    ("g9_parts_by_brand_type", FA.g9_parts_by_brand_type),
    ("g15_customer_activity", FA.g15_customer_activity),
    ("g16_risk_filter", FA.g16_risk_filter),
    ("g17_sum_across_statuses", FA.g17_sum_across_statuses),
]:
    register(_name, _fn)

# §2.D: stream summaries keyed on events.event_id
from . import stream_queries as SQ  # noqa: E402

for _stream, _qname in SQ.QUERY_NAMES.items():
    register(_qname, lambda t, _s=_stream: SQ.stream_summary(t, _s))

# §2.G over the generated public-sector tables (hash recipe, whole fixture keys)
from . import generated_analytics as SA  # noqa: E402

for _name in ["g1_enrolments_per_semester", "g2_students_by_status_campus", "g3_expenditure_by_fund_year",
              "g4_vendor_diversity", "g5_request_resolution", "g6_asset_condition_by_district",
              "g7_high_risk_by_school", "g8_risk_by_grade", "g9_contracts_by_category_method",
              "g10_benefits_by_program", "g11_client_demographics", "g12_totals_per_table",
              "g13_survey_scores", "g14_fleet_events", "g15_student_activity"]:
    register("gen_" + _name, getattr(SA, _name))

# §2.H graph analytics over the generated graphs
from . import graph_queries as GQ  # noqa: E402

for _name in ["h1_department_enrolment", "h2_prerequisite_chains", "h3_program_distribution", "h4_funding_trace",
              "h5_subcontract_pairs", "h6_requests_by_priority", "h7_at_risk_assets", "h8_at_risk_students",
              "h9_school_risk_ranking", "h10_top_vendors", "h11_lobbyist_trail", "h12_multi_program_clients",
              "h13_caseload", "h14_label_counts", "h14_type_counts", "h15_office_headcount",
              "h16_reporting_chains", "h17_project_staffing", "h18_supply_chain", "h19_employee_export",
              "h20_failed_then_retaken", "h21_low_attendance", "h22_any_pattern_sample",
              "h23_export_enrolment", "h24_export_degree_pathways", "h25_export_fund_flows",
              "h26_export_vendor_subcontracts", "h27_export_citizen_services", "h28_export_early_warning",
              "h29_export_procurement", "h30_export_case_management", "h31_shared_courses",
              "h32_subcontract_closure", "h33_caseworker_communities", "h33_caseworker_modularity", "f17_edge_properties", "h34_avg_gpa_by_department"]:
    register("graph_" + _name, getattr(GQ, _name))

# §2.H pattern shapes over the fixture tables as a graph
from . import fixture_graph as FG  # noqa: E402

for _name in ["t_h1_region_customers", "t_h4_region_supplier_trace", "t_h10_supplier_revenue",
              "t_h12_multi_priority_customers", "t_h18_supplier_part_orders", "t_h20_returned_then_reordered", "t_h31_shared_parts"]:
    register("graph_" + _name, getattr(FG, _name))

# §2.I table contracts
from . import contract_queries as CQ  # noqa: E402

for _name in ["i_documents", "i_pages", "i_events", "i_conversations_default_rules", "i_event_transitions",
              "i_event_transitions_by_id", "i_orders_unique", "i_requirement_coverage", "i_text_search", "i_sample_rows"]:
    register("contract_" + _name, getattr(CQ, _name))

# §2.J stream analytics (batch form over events, plus one streaming run)
from . import stream_analytics_queries as JQ  # noqa: E402

for _name in ["j2_error_rate", "j2_stream_error_rate", "j3_sliding_mean", "j3_zscore_outliers", "j4_sessions",
              "j5_velocity", "j6_impossible_travel", "j7_low_battery", "j8_funnel", "j9_shares",
              "j10_firmware_rollout", "j11_dedupe", "j12_enrich", "j13_dead_letters",
              "j5_stream_velocity", "j6_stream_impossible_travel", "j7_stream_low_battery", "j12_stream_normalized_ids"]:
    register("stream_" + _name, getattr(JQ, _name))

# §2.A sources, sinks and table operations
from . import source_queries as AQ  # noqa: E402

for _name in ["a8_upsert_customers", "a11_table_copy", "a14_inventory", "a20_describe_orders", "a21_sample_rows",
              "a24_audit_query", "a25_bounded_consume", "a26_latest_value_per_key", "a27_federated_sql", "e_table_defaults", "e_text_columns", "f15_only_missing_edges"]:
    register("source_" + _name, getattr(AQ, _name))

# F19 user graph job counts and B15/B17 JSON records
from . import user_graphs as UG  # noqa: E402

register("graph_f19_org_chart_counts", lambda t: UG.graph_counts(UG.build_graph(t, UG.ORG_CHART)))
register("d1_record_json", lambda t: SQ.record_json(t, "fraud_detection"))

for _name in ["i_embeddings", "i_conversation_text", "i_device_records", "i_requirement_lists"]:
    register("contract_" + _name, getattr(CQ, _name))
