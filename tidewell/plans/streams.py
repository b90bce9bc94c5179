"""The twelve event streams (nine fixed use cases, three user specs) as column specs.

Each stream is a spec for ``tidewell.functions.spec``; its rows are a pure
function of a global row id, so the batch form (over ``spark.range`` or a
fixture key) and the streaming form (over a rate source, continuing ids
across micro-batches) produce the same records.

FIXED VALUES: the value lists, weights, id prefixes/widths and numeric
ranges below reproduce the source data-sandbox streams as stated there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import apply_spec, generate


def _pick(name, values, weights=None, type_="string"):
    c = {"name": name, "type": type_, "values": values, "random": True}
    if weights:
        c["weights"] = weights
    return c


def _rng(name, type_, lo, hi):
    return {"name": name, "type": type_, "min": lo, "max": hi, "random": True}


def _seq(name, type_, lo, hi):
    return {"name": name, "type": type_, "min": lo, "max": hi}


def _rid(name, prefix, lo, hi, pad):
    return {"name": name, "type": "string", "parts": [prefix, {"min": lo, "max": hi, "pad": pad}]}


def _flag(name, p):
    return {"name": name, "type": "boolean", "probability": p}


def _uuid(name):
    return {"name": name, "type": "string", "uuid": True}


def _ipv4(name):
    return {"name": name, "type": "string",
            "parts": [{"min": 1, "max": 223}, ".", {"min": 0, "max": 255}, ".", {"min": 0, "max": 255}, ".",
                      {"min": 0, "max": 255}]}


# ----------------------------------------------------------------- FIXED VALUES
STREAMS: dict[str, dict] = {
    "fraud_detection": {"topic": "streaming-fraud-transactions", "spec": [
        _uuid("transaction_id"),
        _seq("user_id", "int", 1, 5000),
        _seq("merchant_id", "int", 1, 500),
        _rng("amount", "decimal(10,2)", 0.50, 15000.00),
        _pick("currency", ["USD", "EUR", "GBP", "CAD", "AUD"], [5, 2, 1, 1, 1]),
        _pick("merchant_category", ["grocery", "electronics", "gas_station", "restaurant", "online_retail",
                                    "travel", "entertainment", "healthcare", "atm_withdrawal", "money_transfer"]),
        _pick("payment_method", ["chip", "contactless", "online", "swipe", "mobile_wallet"], [3, 3, 3, 1, 2]),
        _ipv4("ip_address"),
        {"name": "device_id", "type": "string",
         "parts": ["dev-", {"min": 0, "max": 9999, "pad": 4}, "-", {"min": 0, "max": 9999, "pad": 4}]},
        _rng("latitude", "decimal(8,5)", -90.0, 90.0),
        _rng("longitude", "decimal(9,5)", -180.0, 180.0),
        _pick("card_type", ["visa", "mastercard", "amex", "discover"], [4, 3, 2, 1]),
    ]},
    "telemetry": {"topic": "streaming-device-telemetry", "spec": [
        _uuid("event_id"),
        {"name": "device_id", "type": "string",
         "parts": ["iot-", {"min": 0, "max": 9999, "pad": 4}, "-", {"min": 0, "max": 9999, "pad": 4}]},
        _pick("device_type", ["temperature_sensor", "pressure_sensor", "humidity_sensor", "motion_detector",
                              "air_quality", "vibration_sensor", "light_sensor", "flow_meter"]),
        _rng("reading_value", "decimal(10,4)", -50.0, 500.0),
        _pick("unit", ["celsius", "psi", "percent", "boolean", "ppm", "mm_s", "lux", "l_min"]),
        _rng("battery_level", "decimal(5,2)", 0.0, 100.0),
        _rng("signal_strength_dbm", "int", -120, -30),
        _pick("firmware_version", ["1.0.0", "1.1.0", "1.2.3", "2.0.0", "2.1.0"]),
        _rng("facility_id", "int", 1, 50),
        _rng("latitude", "decimal(8,5)", 25.0, 48.0),
        _rng("longitude", "decimal(9,5)", -125.0, -70.0),
        _flag("anomaly_flag", 0.05),
    ]},
    "web_traffic": {"topic": "streaming-web-traffic", "spec": [
        _uuid("event_id"),
        {"name": "session_id", "type": "string",
         "parts": ["sess-", {"min": 0, "max": 9999, "pad": 4}, "-", {"min": 0, "max": 9999, "pad": 4}, "-",
                   {"min": 0, "max": 9999, "pad": 4}]},
        _seq("user_id", "int", 1, 10000),
        _pick("page_url", ["/home", "/products", "/products/detail", "/cart", "/checkout", "/account", "/search",
                           "/blog", "/support", "/api/v1/data"], [5, 4, 3, 2, 1, 2, 3, 2, 1, 1]),
        _pick("referrer", ["direct", "google", "bing", "facebook", "twitter", "linkedin", "email_campaign",
                           "affiliate", "internal"], [3, 4, 1, 2, 1, 1, 2, 1, 3]),
        _pick("user_agent", ["Chrome/125", "Firefox/130", "Safari/18", "Edge/125", "Mobile-Chrome/125",
                             "Mobile-Safari/18", "Bot/1.0"], [4, 2, 2, 1, 3, 2, 1]),
        _ipv4("ip_address"),
        _pick("country", ["US", "UK", "DE", "FR", "CA", "AU", "JP", "BR", "IN", "MX"], [5, 2, 2, 2, 1, 1, 1, 1, 1, 1]),
        _pick("device_type", ["desktop", "mobile", "tablet"], [4, 5, 1]),
        _pick("action", ["page_view", "click", "scroll", "form_submit", "add_to_cart", "purchase", "search",
                         "logout"], [5, 3, 2, 1, 1, 1, 2, 1]),
        _rng("duration_ms", "int", 100, 30000),
        _pick("http_status", [200, 301, 304, 400, 403, 404, 500], [20, 2, 3, 1, 1, 2, 1], "int"),
    ]},
    "student_enrollment": {"topic": "streaming-student-enrollment", "spec": [
        _uuid("event_id"),
        _rid("student_id", "STU-", 1, 15000, 6),
        _rid("course_id", "CRS-", 1, 2000, 4),
        _pick("action", ["enroll", "drop", "transfer", "grade_posted", "waitlist"], [5, 2, 1, 3, 1]),
        _pick("semester", ["Fall 2024", "Spring 2025", "Summer 2025", "Fall 2025"]),
        _pick("department", ["Computer Science", "Mathematics", "English", "Biology", "Chemistry", "Physics",
                             "History", "Psychology", "Business", "Engineering", "Nursing", "Education", "Art",
                             "Music", "Philosophy", "Political Science", "Sociology", "Economics"]),
        _pick("grade", ["A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F", "W", "IP"],
              [2, 2, 2, 3, 2, 2, 2, 1, 1, 1, 1, 5]),
        _rng("credits", "int", 1, 4),
        _pick("campus", ["Main", "North", "Online", "Downtown", "West"], [4, 2, 3, 2, 1]),
        _rng("gpa_impact", "decimal(3,1)", -4.0, 4.0),
    ]},
    "grant_budget": {"topic": "streaming-grant-budget", "spec": [
        _uuid("transaction_id"),
        _rid("fund_source_id", "FUND-", 1, 200, 3),
        _rid("agency_id", "AGY-", 1, 50, 3),
        _rid("program_id", "PGM-", 1, 500, 4),
        _rid("vendor_id", "VND-", 1, 2000, 4),
        _pick("transaction_type", ["allocation", "expenditure", "transfer", "encumbrance", "reimbursement",
                                   "adjustment"], [2, 5, 2, 2, 1, 1]),
        _rng("amount", "decimal(14,2)", 100.0, 5000000.0),
        _pick("fund_category", ["federal_grant", "state_appropriation", "local_revenue", "bond_proceeds",
                                "tuition_fees", "endowment", "auxiliary"], [4, 3, 2, 1, 3, 1, 1]),
        _pick("fiscal_year", ["2023", "2024", "2025", "2026"], [1, 3, 4, 2]),
        _pick("quarter", ["Q1", "Q2", "Q3", "Q4"]),
        _rid("cost_center", "CC-", 1, 300, 4),
        {"name": "account_code", "type": "string", "parts": [{"min": 1000, "max": 9999, "pad": 4}]},
        _pick("description", ["Professional services for", "Equipment purchase -", "Personnel costs -",
                              "Travel and training -", "Facilities maintenance -", "Software licensing -",
                              "Consulting fees for", "Capital improvement -"]),
    ]},
    "citizen_services": {"topic": "streaming-citizen-services", "spec": [
        _uuid("request_id"),
        _rid("citizen_id", "CIT-", 1, 50000, 5),
        _pick("request_type", ["pothole_repair", "streetlight_outage", "water_main_break", "noise_complaint",
                               "illegal_dumping", "graffiti_removal", "tree_trimming", "sidewalk_repair",
                               "traffic_signal", "building_inspection", "permit_application", "animal_control",
                               "park_maintenance", "snow_removal"], [5, 3, 2, 3, 2, 2, 2, 3, 2, 2, 3, 1, 2, 1]),
        _pick("department", ["Public Works", "Transportation", "Water", "Code Enforcement", "Parks", "Building",
                             "Police", "Fire", "Health", "Environmental"], [4, 3, 2, 2, 2, 2, 1, 1, 1, 1]),
        _pick("status", ["opened", "assigned", "in_progress", "pending_review", "resolved", "closed", "reopened"],
              [3, 3, 4, 2, 3, 4, 1]),
        _pick("priority", ["critical", "high", "medium", "low"], [1, 2, 4, 3]),
        _rng("district", "int", 1, 15),
        _rid("asset_id", "AST-", 1, 10000, 5),
        _rng("latitude", "decimal(8,5)", 38.0, 42.0),
        _rng("longitude", "decimal(9,5)", -78.0, -73.0),
        _rng("response_time_hours", "int", 1, 720),
        _pick("satisfaction_rating", [1, 2, 3, 4, 5], [1, 1, 2, 3, 3], "int"),
    ]},
    "k12_early_warning": {"topic": "streaming-k12-early-warning", "spec": [
        _uuid("event_id"),
        _rid("student_id", "K12-", 1, 25000, 5),
        _rid("school_id", "SCH-", 1, 100, 3),
        _pick("event_type", ["attendance", "discipline", "assessment", "intervention", "counselor_note",
                             "parent_contact", "iep_review", "health_screening"], [5, 3, 3, 2, 1, 2, 1, 1]),
        _rng("grade_level", "int", 1, 12),
        _rid("teacher_id", "TCH-", 1, 3000, 4),
        _rng("risk_score", "decimal(5,2)", 0.0, 100.0),
        _rng("attendance_rate", "decimal(5,2)", 50.0, 100.0),
        _rng("gpa", "decimal(3,2)", 0.0, 4.0),
        _rng("behavior_incidents_ytd", "int", 0, 25),
        _pick("intervention_type", ["tutoring", "mentoring", "counseling", "parent_conference", "schedule_change",
                                    "behavioral_plan", "none"], [2, 2, 2, 1, 1, 1, 5]),
        _pick("school_type", ["elementary", "middle", "high"], [5, 3, 4]),
        _flag("free_reduced_lunch", 0.45),
        _flag("english_learner", 0.15),
        _flag("special_education", 0.13),
    ]},
    "procurement": {"topic": "streaming-procurement", "spec": [
        _uuid("event_id"),
        _rid("agency_id", "AGY-", 1, 50, 3),
        _rid("vendor_id", "VND-", 1, 3000, 4),
        _pick("event_type", ["rfp_posted", "bid_submitted", "bid_withdrawn", "contract_awarded", "purchase_order",
                             "invoice_submitted", "invoice_paid", "contract_amended", "contract_terminated"],
              [2, 4, 1, 2, 3, 3, 3, 1, 1]),
        _rid("contract_id", "CTR-", 1, 5000, 5),
        _rng("amount", "decimal(12,2)", 500.0, 25000000.0),
        _pick("procurement_method", ["competitive_bid", "sole_source", "emergency", "cooperative",
                                     "micro_purchase", "rfq"], [5, 2, 1, 2, 2, 3]),
        {"name": "commodity_code", "type": "string", "parts": [{"min": 100, "max": 999, "pad": 3}]},
        _pick("category", ["construction", "professional_services", "it_services", "equipment", "supplies",
                           "facilities", "consulting", "staffing", "transportation", "utilities"],
              [3, 4, 4, 2, 2, 2, 3, 2, 1, 1]),
        _flag("minority_owned", 0.18),
        _flag("small_business", 0.35),
        _flag("local_vendor", 0.40),
        _rng("contract_duration_months", "int", 1, 60),
        _pick("payment_terms", ["net_30", "net_45", "net_60", "upon_delivery"], [5, 3, 2, 1]),
    ]},
    "case_management": {"topic": "streaming-case-management", "spec": [
        _uuid("event_id"),
        _rid("client_id", "CLT-", 1, 40000, 5),
        _rid("case_id", "CASE-", 1, 60000, 5),
        _rid("caseworker_id", "CW-", 1, 1500, 4),
        _pick("event_type", ["intake", "referral", "eligibility_determination", "benefit_disbursement", "review",
                             "closure", "appeal", "transfer"], [3, 3, 3, 4, 3, 2, 1, 1]),
        _pick("program", ["SNAP", "Medicaid", "TANF", "WIC", "CHIP", "housing_assistance", "energy_assistance",
                          "childcare_subsidy", "unemployment", "disability"], [4, 5, 2, 2, 2, 3, 1, 2, 3, 1]),
        _rid("agency_id", "HHS-", 1, 30, 3),
        _rng("benefit_amount", "decimal(10,2)", 0.0, 15000.0),
        _pick("household_size", [1, 2, 3, 4, 5, 6, 7, 8], [2, 4, 4, 3, 2, 1, 1, 1], "int"),
        _pick("income_bracket", ["below_poverty", "low_income", "moderate_income"], [4, 4, 2]),
        {"name": "county", "type": "string", "parts": ["County-", {"min": 1, "max": 80}]},
        _pick("determination", ["approved", "denied", "pending", "deferred", "conditional"], [5, 2, 3, 1, 2]),
        _pick("referral_source", ["self", "agency", "community_org", "healthcare", "school", "court"],
              [4, 3, 2, 2, 1, 1]),
        _pick("priority", ["emergency", "urgent", "standard", "low"], [1, 2, 5, 2]),
    ]},
    # the three user-defined streams of the examples (rows per batch / interval kept as settings)
    "iot_sensors": {"topic": "custom-iot-sensors", "rows_per_batch": 50, "interval": 2.0, "spec": [
        _rid("device_id", "DEV-", 1, 500, 4),
        _pick("device_type", ["temperature", "humidity", "pressure", "air_quality", "motion"], [4, 3, 2, 2, 1]),
        _rng("reading", "decimal(8,3)", -40.0, 150.0),
        _pick("unit", ["celsius", "percent", "hpa", "ppm", "boolean"]),
        _rng("battery_pct", "int", 0, 100),
        _rng("signal_dbm", "int", -120, -20),
        _pick("facility", ["Building-A", "Building-B", "Warehouse-1", "Warehouse-2", "Field-Site"]),
        _flag("anomaly", 0.05),
        _rng("latitude", "decimal(8,5)", 38.0, 42.0),
        _rng("longitude", "decimal(9,5)", -78.0, -73.0),
    ]},
    "ecommerce_clicks": {"topic": "custom-clickstream", "rows_per_batch": 200, "interval": 0.5, "spec": [
        _uuid("click_id"),
        _rid("session_id", "sess-", 1, 50000, 6),
        _rng("user_id", "int", 1, 100000),
        _pick("page", ["/home", "/products", "/product/detail", "/cart", "/checkout", "/search", "/account",
                       "/wishlist", "/reviews", "/support"], [5, 4, 3, 2, 1, 3, 1, 1, 1, 1]),
        _pick("action", ["view", "click", "scroll", "add_to_cart", "remove_from_cart", "purchase", "search",
                         "filter", "sort"], [5, 3, 2, 2, 1, 1, 2, 1, 1]),
        _pick("product_category", ["electronics", "clothing", "home", "books", "sports", "beauty", "food", "toys",
                                   "automotive"]),
        _rng("price", "decimal(8,2)", 0.99, 2999.99),
        _pick("device", ["mobile", "desktop", "tablet"], [5, 4, 1]),
        _pick("referrer", ["direct", "google", "facebook", "instagram", "email", "affiliate"], [3, 4, 2, 2, 2, 1]),
        _rng("duration_ms", "int", 100, 60000),
    ]},
    "patient_vitals": {"topic": "custom-patient-vitals", "rows_per_batch": 30, "interval": 3.0, "spec": [
        _uuid("reading_id"),
        _rid("patient_id", "PAT-", 1, 2000, 5),
        _pick("ward", ["ICU", "ER", "General", "Pediatrics", "Cardiology", "Oncology"], [2, 3, 5, 2, 2, 1]),
        _rng("heart_rate", "int", 40, 180),
        _rng("systolic_bp", "int", 80, 200),
        _rng("diastolic_bp", "int", 50, 130),
        _rng("temperature_f", "decimal(4,1)", 95.0, 105.0),
        _rng("spo2", "int", 85, 100),
        _rng("respiratory_rate", "int", 8, 40),
        _pick("pain_level", [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [10, 5, 5, 4, 4, 3, 3, 2, 2, 1, 1], "int"),
        _flag("alert", 0.08),
        _rid("nurse_id", "RN-", 1, 200, 3),
    ]},
}
# --------------------------------------------------------------- end FIXED VALUES


def stream_spec(name: str) -> list[dict]:
    return STREAMS[name]["spec"]


def batch(spark: SparkSession, name: str, rows: int, partitions: int | None = None, seed=42,
          offset: int = 0, fast: bool = False) -> DataFrame:
    """``rows`` records of a stream with global ids from ``offset`` (batch form)."""
    return generate(spark, stream_spec(name), rows, partitions, seed, offset, fast=fast)


def over_keys(df: DataFrame, key: str, name: str, ts: Column | None = None, seed=42,
              carry: dict[str, str] | None = None) -> DataFrame:
    """Stream records keyed by an existing column (e.g. ``events.event_id``).

    ``ts`` (optional) is carried as ``event_time`` so event-time operators can
    use it, and ``carry`` (new name -> column) keeps more columns of ``df`` beside
    the record, so that no join has to bring them back; the work scales with ``df``.
    """
    more = dict(carry or {})
    base = df.select(F.col(key).alias("_key"), *([ts.alias("event_time")] if ts is not None else []),
                     *(F.col(c).alias(n) for n, c in more.items()))
    out = apply_spec(base, stream_spec(name), key="_key", seed=seed,
                     keep=["_key"] + (["event_time"] if ts is not None else []) + list(more))
    return out.withColumnRenamed("_key", "row_id")
