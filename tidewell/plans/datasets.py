"""The six public-sector relational datasets (E1-E6), bound to fixture keys.

Every table is generated from a whole fixture table, one row per key, so its
size grows with the input and each row is a pure function of (seed, table,
key):

    students / citizens / clients / k12_students  <- customer.c_custkey
    agencies / schools                            <- nation.n_nationkey
    vendors                                       <- supplier.s_suppkey
    courses / assets / contracts                  <- part.p_partkey
    enrollment / budget / request / k12 / procurement events, cases <- orders.o_orderkey

Foreign keys follow a real fixture foreign key where one exists
(``orders.o_custkey``); otherwise they are uniform over the parent's rows,
with the parent's row count taken from a scalar subquery (a metadata-only
count), never collected on the driver. Keys are 1-based padded text as in
the source (``STU-000001``).

FIXED VALUES: value pools, weights and ranges are the source dataset's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pools
from ..functions.spec import apply_spec
from ..sources.fixtures import Tables


def _pick(name, values, weights=None, type_="string"):
    c = {"name": name, "type": type_, "values": values, "random": True}
    if weights:
        c["weights"] = weights
    return c


def _rng(name, type_, lo, hi, **kw):
    return {"name": name, "type": type_, "min": lo, "max": hi, "random": True, **kw}


def _flag(name, p):
    return {"name": name, "type": "boolean", "probability": p}


def _key(name, prefix, col, width):
    return {"name": name, "type": "string", "parts": [prefix, {"col": col, "offset": 1, "pad": width}]}


def _fk(name, prefix, parent: str, width, **kw):
    """Uniform foreign key over the rows of fixture table ``parent``."""
    return {"name": name, "type": "string", "parts": [prefix, {"mod_table": parent, "offset": 1, "pad": width}], **kw}


def _person(name):
    return {"name": name, "type": "string", "person": True}


def _date(name, y0, y1, type_="date"):
    return {"name": name, "type": type_, "begin": f"{y0}-01-01", "end": f"{y1}-12-31", "interval": "days=1",
            "random": True}


def _epoch_of(text: str) -> int:
    from datetime import datetime, timezone
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp())


def rows(df: DataFrame) -> Column:
    """Row count of a table as a scalar-subquery Column (evaluated once, metadata only for parquet)."""
    return df.select(F.count("*")).scalar()


SPECS: dict[str, tuple[str, str, list[dict]]] = {}


def resolve(spec: list[dict], t: Tables) -> list[dict]:
    """Replace ``mod_table`` parent references by the parent's row count (scalar subquery)."""
    out = []
    for c in spec:
        if c.get("parts"):
            parts = [({**p, "mod": rows(t[p["mod_table"]])} if isinstance(p, dict) and "mod_table" in p else p)
                     for p in c["parts"]]
            c = {**c, "parts": parts}
        out.append(c)
    return out


def build_table(t: Tables, table: str, seed=42) -> DataFrame:
    """Generate ``table`` with one row per key of its fixture source table."""
    src, key, spec = SPECS[table]
    return apply_spec(t[src], resolve(spec, t), key=key, seed=f"{seed}/{table}")


# ------------------------------------------------------------------ FIXED VALUES
DEPARTMENTS = ["Computer Science", "Mathematics", "English", "Biology", "Chemistry", "Physics", "History",
               "Psychology", "Business Administration", "Engineering", "Nursing", "Education", "Art", "Music",
               "Philosophy", "Political Science", "Sociology", "Economics"]
CAMPUSES = ["Main", "North", "Online", "Downtown", "West"]
SEMESTERS = ["Fall 2023", "Spring 2024", "Summer 2024", "Fall 2024", "Spring 2025", "Summer 2025", "Fall 2025"]
GRADES = ["A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F", "W", "IP"]
GRADE_WEIGHTS = [8, 6, 7, 10, 6, 5, 8, 4, 3, 2, 3, 15]
STUDENT_STATUSES = ["active", "graduated", "on_leave", "suspended", "withdrawn"]
STUDENT_STATUS_WEIGHTS = [60, 15, 10, 5, 10]
COURSE_PREFIXES = ["Introduction to", "Principles of", "Advanced", "Topics in", "Seminar in", "Research Methods in",
                   "Applied", "Foundations of", "Survey of", "Theory of"]
FUND_CATEGORIES = ["federal_grant", "state_appropriation", "local_revenue", "bond_proceeds", "tuition_fees",
                   "endowment", "auxiliary", "research_grant"]
TX_TYPES = ["allocation", "expenditure", "transfer", "encumbrance", "reimbursement", "adjustment"]
TX_WEIGHTS = [2, 5, 1, 2, 1, 1]
AGENCY_TYPES = ["School District", "County", "City", "State Agency", "Authority", "University"]
VENDOR_TYPES = ["Contractor", "Supplier", "Consultant", "Technology", "Services", "Construction"]
REQUEST_TYPES = ["pothole_repair", "streetlight_outage", "water_main_break", "noise_complaint", "illegal_dumping",
                 "graffiti_removal", "tree_trimming", "sidewalk_repair", "traffic_signal", "building_inspection",
                 "permit_application", "animal_control", "park_maintenance", "snow_removal", "sewer_backup",
                 "abandoned_vehicle"]
SERVICE_DEPARTMENTS = ["Public Works", "Transportation", "Water", "Code Enforcement", "Parks", "Building", "Police",
                       "Fire", "Health", "Environmental"]
REQUEST_STATUSES = ["opened", "assigned", "in_progress", "pending_review", "resolved", "closed", "reopened"]
REQUEST_STATUS_WEIGHTS = [2, 2, 3, 1, 4, 5, 1]
PRIORITIES = ["critical", "high", "medium", "low"]
PRIORITY_WEIGHTS = [1, 2, 4, 3]
CHANNELS = ["phone", "web", "mobile_app", "walk_in", "email", "social_media"]
ASSET_TYPES = ["Road Segment", "Bridge", "Building", "Park", "Water Main", "Sewer Line", "Traffic Signal",
               "Streetlight", "Fire Hydrant", "Playground"]
CONDITIONS = ["good", "fair", "poor", "critical"]
CONDITION_WEIGHTS = [4, 3, 2, 1]
SCHOOL_TYPES = ["elementary", "middle", "high"]
SCHOOL_TYPE_WEIGHTS = [5, 3, 2]
SCHOOL_PREFIXES = ["Washington", "Lincoln", "Jefferson", "Roosevelt", "King", "Kennedy", "Franklin", "Oakwood",
                   "Riverside", "Lakewood"]
K12_EVENT_TYPES = ["attendance", "discipline", "assessment", "intervention", "counselor_note", "parent_contact",
                   "iep_review", "health_screening"]
K12_EVENT_WEIGHTS = [10, 3, 5, 2, 2, 2, 1, 1]
INTERVENTIONS = ["tutoring", "mentoring", "counseling", "parent_conference", "schedule_change", "behavioral_plan",
                 "after_school", "none"]
INTERVENTION_WEIGHTS = [2, 2, 2, 2, 1, 1, 1, 8]
INCIDENTS = list(range(15))
INCIDENT_WEIGHTS = [50, 10, 8, 6, 5, 4, 3, 2, 2, 2, 1, 1, 1, 1, 1]
PROC_EVENT_TYPES = ["rfp_posted", "bid_submitted", "bid_withdrawn", "contract_awarded", "purchase_order",
                    "invoice_submitted", "invoice_paid", "contract_amended", "contract_terminated"]
PROC_EVENT_WEIGHTS = [2, 4, 1, 2, 3, 4, 3, 1, 1]
METHODS = ["competitive_bid", "sole_source", "emergency", "cooperative", "micro_purchase", "rfq"]
METHOD_WEIGHTS = [5, 2, 1, 2, 3, 2]
CATEGORIES = ["construction", "professional_services", "it_services", "equipment", "supplies", "facilities",
              "consulting", "staffing", "transportation", "utilities"]
TERMS = ["net_30", "net_45", "net_60", "upon_delivery"]
CONTRACT_STATUSES = ["active", "completed", "pending", "terminated", "expired"]
CONTRACT_STATUS_WEIGHTS = [4, 3, 1, 1, 1]
DURATIONS = [3, 6, 12, 18, 24, 36, 48, 60]
CASE_EVENT_TYPES = ["intake", "referral", "eligibility_determination", "benefit_disbursement", "review", "closure",
                    "appeal", "transfer"]
CASE_EVENT_WEIGHTS = [3, 2, 3, 4, 2, 2, 1, 1]
PROGRAMS = ["SNAP", "Medicaid", "TANF", "WIC", "CHIP", "housing_assistance", "energy_assistance",
            "childcare_subsidy", "unemployment", "disability"]
PROGRAM_WEIGHTS = [5, 5, 3, 3, 2, 2, 2, 2, 2, 2]
DETERMINATIONS = ["approved", "denied", "pending", "deferred", "conditional"]
DETERMINATION_WEIGHTS = [5, 2, 2, 1, 1]
REFERRALS = ["self", "agency", "community_org", "healthcare", "school", "court"]
REFERRAL_WEIGHTS = [3, 3, 2, 2, 1, 1]
CASE_PRIORITIES = ["emergency", "urgent", "standard", "low"]
CASE_PRIORITY_WEIGHTS = [1, 2, 5, 2]
CASE_STATUSES = ["open", "under_review", "approved", "denied", "closed", "appealed"]
CASE_STATUS_WEIGHTS = [3, 2, 4, 2, 3, 1]
LANGUAGES = ["English", "Spanish", "Chinese", "Vietnamese", "Arabic", "French", "Korean", "Russian"]
LANGUAGE_WEIGHTS = [60, 20, 5, 3, 3, 3, 3, 3]
CITIZEN_LANGUAGES = ["English", "Spanish", "Chinese", "Vietnamese", "Arabic"]
CITIZEN_LANGUAGE_WEIGHTS = [65, 20, 5, 5, 5]
HOUSEHOLD = [1, 2, 3, 4, 5, 6, 7, 8]
HOUSEHOLD_WEIGHTS = [15, 25, 20, 20, 10, 5, 3, 2]
INCOME = ["below_poverty", "low_income", "moderate_income"]
INCOME_WEIGHTS = [4, 4, 2]
COST_DESCRIPTIONS = ["Personnel costs -", "Equipment purchase -", "Professional services for", "Facilities maintenance -",
                     "Software licensing -", "Travel and training -", "Capital improvement -", "Consulting fees for",
                     "Research equipment -", "Program supplies for", "Building renovation -", "IT infrastructure for"]
COST_PROGRAMS = ["Infrastructure", "Public Safety", "Youth Development", "Senior Services", "Education Technology",
                 "Workforce Training", "Community Health", "Housing Development", "Digital Equity", "Economic Development"]
# -------------------------------------------------------------- end FIXED VALUES
_SCHOOL_PREFIX_ARRAY = "array(" + ", ".join(f"'{p}'" for p in SCHOOL_PREFIXES) + ")"


# ---------------------------------------------------------------- E1 enrolment
SPECS["students"] = ("customer", "c_custkey", [
        _key("student_id", "STU-", "c_custkey", 6),
        _person("name"),
        {"name": "email", "type": "string", "parts": ["student", {"col": "c_custkey", "offset": 1}, "@university.edu"]},
        _pick("enrollment_year", [2020, 2021, 2022, 2023, 2024, 2025], type_="int"),
        _pick("campus", CAMPUSES),
        _rng("gpa", "decimal(3,2)", 1.5, 4.0),
        _rng("total_credits", "int", 0, 132),
        _pick("status", STUDENT_STATUSES, STUDENT_STATUS_WEIGHTS),
        _pick("major", DEPARTMENTS),
        _person("advisor"),
        _pick("state", pools.STATES),
])


SPECS["courses"] = ("part", "p_partkey", [
        _key("course_id", "CRS-", "p_partkey", 4),
        {**_pick("_prefix", COURSE_PREFIXES), "omit": True},
        {**_pick("_subject", DEPARTMENTS), "omit": True},
        {**_pick("_base", [100, 200, 300, 400, 500], type_="int"), "omit": True},
        {**_rng("_off", "int", 0, 9), "omit": True},
        {"name": "name", "type": "string",
         "expr": "concat(_prefix, ' ', _subject, ' ', lpad(cast(_base + _off as string), 3, '0'))"},
        _pick("department", DEPARTMENTS),
        _pick("level", [100, 200, 300, 400, 500], type_="int"),
        _pick("credits", [1, 2, 3, 3, 3, 4, 4], type_="int"),
        _pick("max_enrollment", [25, 30, 35, 40, 50, 100, 150, 200], type_="int"),
        _pick("semester", SEMESTERS),
        _person("instructor"),
        _pick("delivery_mode", ["in_person", "online", "hybrid"]),
])


SPECS["enrollment_events"] = ("orders", "o_orderkey", [
        _key("event_id", "EVT-", "o_orderkey", 8),
        _key("student_id", "STU-", "o_custkey", 6),
        _fk("course_id", "CRS-", "part", 4),
        _pick("action", ["enroll", "drop", "transfer", "grade_posted", "waitlist"], [5, 2, 1, 3, 1]),
        _pick("semester", SEMESTERS),
        _pick("grade", GRADES, GRADE_WEIGHTS),
        _pick("credits", [1, 2, 3, 3, 3, 4, 4], type_="int"),
        _pick("campus", CAMPUSES),
        _rng("gpa_impact", "decimal(4,2)", -2.0, 2.0),
        {"name": "event_timestamp", "type": "timestamp", "expr": "o_orderdate"},
])


# ------------------------------------------------------------------ E2 grants
SPECS["agencies"] = ("nation", "n_nationkey", [
        _key("agency_id", "AGY-", "n_nationkey", 3),
        {**_pick("_city", pools.CITIES), "omit": True},
        {**_pick("_kind", AGENCY_TYPES), "omit": True},
        {"name": "name", "type": "string", "expr": "concat(_city, ' ', _kind)"},
        _pick("type", AGENCY_TYPES),
        _pick("jurisdiction", pools.CITIES),
        _rng("employee_count", "int", 20, 5000),
        _rng("annual_budget", "decimal(14,2)", 500000, 500000000),
        _pick("state", pools.STATES),
])


SPECS["vendors"] = ("supplier", "s_suppkey", [
        _key("vendor_id", "VND-", "s_suppkey", 4),
        {**_pick("_last", pools.LAST_NAMES), "omit": True},
        {**_pick("_kind", VENDOR_TYPES), "omit": True},
        {**_pick("_suffix", ["LLC", "Inc.", "Corp."]), "omit": True},
        {"name": "name", "type": "string", "expr": "concat_ws(' ', _last, _kind, _suffix)"},
        _pick("type", VENDOR_TYPES),
        _pick("state", pools.STATES),
        _flag("minority_owned", 0.18),
        _flag("small_business", 0.35),
        _flag("woman_owned", 0.15),
        {"name": "duns_number", "type": "string", "parts": [{"min": 100000000, "max": 999999999}]},
        _rng("annual_revenue", "decimal(14,2)", 100000, 100000000),
])


SPECS["budget_transactions"] = ("orders", "o_orderkey", [
        _key("transaction_id", "TXN-", "o_orderkey", 8),
        {"name": "fund_source_id", "type": "string", "parts": ["FUND-", {"min": 1, "max": 200, "pad": 3}]},
        _fk("agency_id", "AGY-", "nation", 3),
        {"name": "program_id", "type": "string", "parts": ["PGM-", {"min": 1, "max": 500, "pad": 4}]},
        _fk("vendor_id", "VND-", "supplier", 4),
        _pick("transaction_type", TX_TYPES, TX_WEIGHTS),
        _rng("amount", "decimal(14,2)", 100, 5000000),
        _pick("fund_category", FUND_CATEGORIES),
        _pick("fiscal_year", [2023, 2024, 2025, 2026], type_="int"),
        _pick("quarter", ["Q1", "Q2", "Q3", "Q4"]),
        {"name": "cost_center", "type": "string", "parts": ["CC-", {"min": 1, "max": 300, "pad": 4}]},
        {"name": "account_code", "type": "string", "parts": [{"min": 1000, "max": 9999}]},
        {**_pick("_what", COST_DESCRIPTIONS), "omit": True},
        {**_pick("_for", COST_PROGRAMS), "omit": True},
        {"name": "description", "type": "string", "expr": "concat(_what, ' ', _for)"},
        _person("approved_by"),
        {"name": "event_timestamp", "type": "timestamp", "expr": "o_orderdate"},
])


# ------------------------------------------------------------ E3 citizen services
SPECS["citizens"] = ("customer", "c_custkey", [
        _key("citizen_id", "CIT-", "c_custkey", 5),
        _person("name"),
        {"name": "email", "type": "string", "parts": ["citizen", {"col": "c_custkey", "offset": 1}, "@email.com"]},
        {"name": "phone", "type": "string", "parts": ["(", {"min": 200, "max": 999}, ") ", {"min": 200, "max": 999},
                                                      "-", {"min": 1000, "max": 9999}]},
        _rng("district", "int", 1, 15),
        {**_rng("_no", "int", 100, 9999), "omit": True},
        {**_pick("_street", pools.STREET_NAMES), "omit": True},
        {**_pick("_city", pools.CITIES), "omit": True},
        {"name": "address", "type": "string", "expr": "concat(_no, ' ', _street, ', ', _city)"},
        _date("registered_date", 2018, 2025),
        _pick("preferred_language", CITIZEN_LANGUAGES, CITIZEN_LANGUAGE_WEIGHTS),
])


SPECS["assets"] = ("part", "p_partkey", [
        _key("asset_id", "AST-", "p_partkey", 5),
        _pick("type", ASSET_TYPES),
        _pick("condition", CONDITIONS, CONDITION_WEIGHTS),
        _rng("district", "int", 1, 15),
        _rng("install_year", "int", 1970, 2024),
        _date("last_inspection", 2022, 2025),
        _rng("latitude", "decimal(8,5)", 38.8, 39.4),
        _rng("longitude", "decimal(9,5)", -77.2, -76.6),
        _rng("replacement_cost", "decimal(12,2)", 5000, 2000000),
])


SPECS["service_requests"] = ("orders", "o_orderkey", [
        _key("request_id", "REQ-", "o_orderkey", 8),
        _key("citizen_id", "CIT-", "o_custkey", 5),
        _pick("request_type", REQUEST_TYPES),
        _pick("department", SERVICE_DEPARTMENTS),
        _pick("status", REQUEST_STATUSES, REQUEST_STATUS_WEIGHTS),
        _pick("priority", PRIORITIES, PRIORITY_WEIGHTS),
        _rng("district", "int", 1, 15),
        _fk("asset_id", "AST-", "part", 5, percent_nulls=30),
        _rng("latitude", "decimal(8,5)", 38.8, 39.4),
        _rng("longitude", "decimal(9,5)", -77.2, -76.6),
        {**_pick("_what", REQUEST_TYPES), "omit": True},
        {**_rng("_no", "int", 100, 9999), "omit": True},
        {**_pick("_street", pools.STREET_NAMES), "omit": True},
        {"name": "description", "type": "string", "expr": "concat(initcap(replace(_what, '_', ' ')), ' at ', _no, ' ', _street)"},
        _rng("response_time_hours", "int", 1, 720),
        _rng("satisfaction_rating", "int", 1, 5, percent_nulls=40),
        _pick("channel", CHANNELS),
        {"name": "event_timestamp", "type": "timestamp", "expr": "o_orderdate"},
])


# --------------------------------------------------------------- E4 early warning
SPECS["schools"] = ("nation", "n_nationkey", [
        _key("school_id", "SCH-", "n_nationkey", 3),
        {**_pick("_kind", SCHOOL_TYPES), "omit": True},
        {"name": "name", "type": "string",
         "expr": f"concat(element_at({_SCHOOL_PREFIX_ARRAY}, cast(pmod(n_nationkey, {len(SCHOOL_PREFIXES)}) + 1 as int)), ' ', "
                 f"initcap(_kind), ' School')"},
        _pick("type", SCHOOL_TYPES, SCHOOL_TYPE_WEIGHTS),
        _rng("enrollment", "int", 200, 2500),
        _flag("title_i", 0.55),
        _rng("graduation_rate", "decimal(4,1)", 65, 99, percent_nulls=30),
        _person("principal"),
        {**_pick("_city", pools.CITIES), "omit": True},
        {"name": "district", "type": "string", "expr": "concat(_city, ' School District')"},
        _pick("state", pools.STATES),
])


SPECS["k12_students"] = ("customer", "c_custkey", [
        _key("student_id", "K12-", "c_custkey", 5),
        _person("name"),
        _rng("grade_level", "int", 1, 12),
        _fk("school_id", "SCH-", "nation", 3),
        _rng("gpa", "decimal(3,2)", 0.5, 4.0),
        _rng("attendance_rate", "decimal(5,1)", 60, 100),
        _pick("behavior_incidents_ytd", INCIDENTS, INCIDENT_WEIGHTS, "int"),
        _rng("risk_score", "decimal(5,1)", 0, 100),
        _flag("free_reduced_lunch", 0.45),
        _flag("english_learner", 0.15),
        _flag("special_education", 0.13),
        _flag("gifted", 0.08),
        _pick("cohort_year", [2020, 2021, 2022, 2023, 2024], type_="int"),
])


SPECS["k12_events"] = ("orders", "o_orderkey", [
        _key("event_id", "KEV-", "o_orderkey", 8),
        _key("student_id", "K12-", "o_custkey", 5),
        _fk("school_id", "SCH-", "nation", 3),
        _pick("event_type", K12_EVENT_TYPES, K12_EVENT_WEIGHTS),
        _rng("grade_level", "int", 1, 12),
        {"name": "teacher_id", "type": "string", "parts": ["TCH-", {"min": 1, "max": 3000, "pad": 4}]},
        {**_pick("_what", K12_EVENT_TYPES, K12_EVENT_WEIGHTS), "omit": True},
        {"name": "details", "type": "string", "expr": "concat(initcap(replace(_what, '_', ' ')), ' event recorded')"},
        _rng("risk_score_delta", "decimal(5,2)", -10, 15),
        _pick("intervention_type", INTERVENTIONS, INTERVENTION_WEIGHTS),
        {"name": "event_timestamp", "type": "timestamp", "expr": "o_orderdate"},
])


# ------------------------------------------------------------------ E5 procurement
SPECS["contracts"] = ("part", "p_partkey", [
        _key("contract_id", "CTR-", "p_partkey", 5),
        {**_pick("_what", CATEGORIES), "omit": True},
        {**_rng("_no", "int", 1, 999), "omit": True},
        {"name": "title", "type": "string", "expr": "concat(initcap(replace(_what, '_', ' ')), ' - Project ', _no)"},
        _fk("agency_id", "AGY-", "nation", 3),
        _fk("vendor_id", "VND-", "supplier", 4),
        _rng("amount", "decimal(14,2)", 5000, 25000000),
        _pick("method", METHODS, METHOD_WEIGHTS),
        _pick("category", CATEGORIES),
        _pick("status", CONTRACT_STATUSES, CONTRACT_STATUS_WEIGHTS),
        _date("start_date", 2022, 2025),
        _date("end_date", 2024, 2028),
        _pick("duration_months", DURATIONS, type_="int"),
        _pick("payment_terms", TERMS),
])


SPECS["procurement_events"] = ("orders", "o_orderkey", [
        _key("event_id", "PEV-", "o_orderkey", 8),
        _fk("agency_id", "AGY-", "nation", 3),
        _fk("vendor_id", "VND-", "supplier", 4),
        _pick("event_type", PROC_EVENT_TYPES, PROC_EVENT_WEIGHTS),
        _fk("contract_id", "CTR-", "part", 5),
        _rng("amount", "decimal(14,2)", 500, 25000000),
        _pick("procurement_method", METHODS, METHOD_WEIGHTS),
        {"name": "commodity_code", "type": "string", "parts": [{"min": 100, "max": 999}]},
        _pick("category", CATEGORIES),
        _flag("minority_owned", 0.18),
        _flag("small_business", 0.35),
        _flag("local_vendor", 0.40),
        _pick("contract_duration_months", DURATIONS, type_="int"),
        _pick("payment_terms", TERMS),
        {"name": "event_timestamp", "type": "timestamp", "expr": "o_orderdate"},
])


# ---------------------------------------------------------------- E6 case management
SPECS["clients"] = ("customer", "c_custkey", [
        _key("client_id", "CLT-", "c_custkey", 5),
        _person("name"),
        {"name": "dob", "type": "date", "begin": "1945-01-01", "end": "2008-12-28", "interval": "days=1",
         "random": True},
        _pick("household_size", HOUSEHOLD, HOUSEHOLD_WEIGHTS, "int"),
        _pick("income_bracket", INCOME, INCOME_WEIGHTS),
        {**_pick("_city", pools.CITIES), "omit": True},
        {"name": "county", "type": "string", "expr": "concat(_city, ' County')"},
        {"name": "zip_code", "type": "string", "parts": [{"min": 10000, "max": 99999}]},
        _pick("primary_language", LANGUAGES, LANGUAGE_WEIGHTS),
        _flag("veteran", 0.08),
        _flag("disabled", 0.15),
])


SPECS["cases"] = ("orders", "o_orderkey", [
        _key("case_id", "CASE-", "o_orderkey", 5),
        _key("client_id", "CLT-", "o_custkey", 5),
        _fk("caseworker_id", "CW-", "supplier", 4),
        _pick("status", CASE_STATUSES, CASE_STATUS_WEIGHTS),
        _date("opened_date", 2022, 2025),
        {**_date("closed_date", 2023, 2026), "percent_nulls": 40},
        _pick("priority", CASE_PRIORITIES, CASE_PRIORITY_WEIGHTS),
        _pick("determination", DETERMINATIONS, DETERMINATION_WEIGHTS),
        _pick("referral_source", REFERRALS, REFERRAL_WEIGHTS),
        _rng("benefit_amount", "decimal(10,2)", 0, 15000),
        _pick("program", PROGRAMS, PROGRAM_WEIGHTS),
        _date("review_date", 2024, 2026),
])


SPECS["case_events"] = ("orders", "o_orderkey", [
        _key("event_id", "CEV-", "o_orderkey", 8),
        _key("client_id", "CLT-", "o_custkey", 5),
        _fk("case_id", "CASE-", "orders", 5),
        _fk("caseworker_id", "CW-", "supplier", 4),
        _pick("event_type", CASE_EVENT_TYPES, CASE_EVENT_WEIGHTS),
        _pick("program", PROGRAMS, PROGRAM_WEIGHTS),
        {"name": "agency_id", "type": "string", "parts": ["HHS-", {"min": 1, "max": 30, "pad": 3}]},
        _rng("benefit_amount", "decimal(10,2)", 0, 15000),
        _pick("household_size", HOUSEHOLD, HOUSEHOLD_WEIGHTS, "int"),
        _pick("income_bracket", INCOME, INCOME_WEIGHTS),
        {**_pick("_city", pools.CITIES), "omit": True},
        {"name": "county", "type": "string", "expr": "concat(_city, ' County')"},
        _pick("determination", DETERMINATIONS, DETERMINATION_WEIGHTS),
        _pick("referral_source", REFERRALS, REFERRAL_WEIGHTS),
        _pick("priority", CASE_PRIORITIES, CASE_PRIORITY_WEIGHTS),
        {"name": "event_timestamp", "type": "timestamp", "expr": "o_orderdate"},
])


def students(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "students", seed)

def courses(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "courses", seed)

def enrollment_events(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "enrollment_events", seed)

def agencies(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "agencies", seed)

def vendors(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "vendors", seed)

def budget_transactions(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "budget_transactions", seed)

def citizens(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "citizens", seed)

def assets(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "assets", seed)

def service_requests(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "service_requests", seed)

def schools(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "schools", seed)

def k12_students(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "k12_students", seed)

def k12_events(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "k12_events", seed)

def contracts(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "contracts", seed)

def procurement_events(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "procurement_events", seed)

def clients(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "clients", seed)

def cases(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "cases", seed)

def case_events(t: Tables, seed=42) -> DataFrame:
    return build_table(t, "case_events", seed)


DATASETS = {
    "student_enrollment": {"students": students, "courses": courses, "enrollment_events": enrollment_events},
    "grant_budget": {"agencies": agencies, "vendors": vendors, "budget_transactions": budget_transactions},
    "citizen_services": {"citizens": citizens, "assets": assets, "service_requests": service_requests},
    "k12_early_warning": {"schools": schools, "k12_students": k12_students, "k12_events": k12_events},
    "procurement": {"contracts": contracts, "procurement_events": procurement_events},
    "case_management": {"clients": clients, "cases": cases, "case_events": case_events},
}


def create_statement(table: str, name: str, location: str) -> str:
    """``CREATE TABLE IF NOT EXISTS`` of a generated table: the spec's columns, and ``created_at``, which rows do not carry and
    the table fills with the time of their writing."""
    _src, _key_, spec = SPECS[table]
    cols = [f"`{c['name']}` {c.get('type', 'string')}" for c in spec if not c.get("omit")]
    return (f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(cols)}, created_at TIMESTAMP DEFAULT current_timestamp()) "
            f"USING parquet LOCATION '{location}'")
