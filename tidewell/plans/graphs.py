"""The six public-sector property graphs (F1-F6), built from fixture keys.

Scaled node sets come from whole fixture tables (one node per key; the key
is the node's dense ordinal), fixed-size catalogues (18 departments, 12 risk
indicators, ...) from ``spark.range``. Node properties use the column-spec
engine; relationships use the O(edges) builders of ``operators.edges``.
Node ids are the source's padded text ids (``STU-000001``); every edge table
has ``src, dst`` (node ids) plus its properties.

Where the source's Cypher picks "one per source" with a global ``LIMIT``
(which creates one edge in total) the documented per-source intent is built.

FIXED VALUES: pools, weights, probabilities and ranges are the source's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pools
from ..functions.hashing import int_between, padded, pick, unif
from ..functions.spec import apply_spec
from ..operators import edges as E
from ..operators.graph import Graph
from ..sources.fixtures import Tables
from .datasets import rows
from .node_properties import with_more

SEED = 42


def _arr(values) -> str:
    return "array(" + ", ".join("'" + str(v).replace("'", "\\'") + "'" for v in values) + ")"


def _by_index(name: str, values, key: str) -> dict:
    """Value ``values[key mod n]`` (the source cycles fixed lists by row number)."""
    return {"name": name, "type": "string",
            "expr": f"element_at({_arr(values)}, cast(pmod({key}, {len(values)}) + 1 as int))"}


def _pick(name, values, weights=None, type_="string", **kw):
    c = {"name": name, "type": type_, "values": values, "random": True, **kw}
    if weights:
        c["weights"] = weights
    return c


def _rng(name, type_, lo, hi, **kw):
    return {"name": name, "type": type_, "min": lo, "max": hi, "random": True, **kw}


def _flag(name, p):
    return {"name": name, "type": "boolean", "probability": p}


def _id(name, prefix, width, key="_ord"):
    return {"name": name, "type": "string", "parts": [prefix, {"col": key, "offset": 1, "pad": width}]}


def _person(name):
    return {"name": name, "type": "string", "person": True}


def node_table(src: DataFrame, key: str, spec: list[dict], label: str, seed=SEED) -> DataFrame:
    """Nodes of ``label``: ``_ord`` (dense ordinal = the fixture key) + spec properties."""
    base = src.select(F.col(key).cast("bigint").alias("_ord"))
    return apply_spec(base, with_more(label, spec), key="_ord", seed=f"{seed}/{label}", keep=["_ord"])


def range_nodes(spark, n: int, spec: list[dict], label: str, seed=SEED) -> DataFrame:
    base = spark.range(n).select(F.col("id").alias("_ord"))
    return apply_spec(base, with_more(label, spec), key="_ord", seed=f"{seed}/{label}", keep=["_ord"])


def _node_values(edges: DataFrame, ord_col: str, label: str, cols: list[dict], seed=SEED) -> DataFrame:
    """``edges`` with properties of the node at ``ord_col``, drawn as the node draws them, so no join is needed."""
    return apply_spec(edges, cols, key=ord_col, seed=f"{seed}/{label}", keep=edges.columns)


def _more(label: str, name: str) -> list[dict]:
    """The spec of one of a label's further properties (``node_properties``)."""
    return [c for c in with_more(label, []) if c["name"] == name]


def _ids(df: DataFrame, ord_col: str, prefix: str, width: int) -> Column:
    return padded(prefix, F.col(ord_col) + 1, width)


def _u(seed, rel, tag, *cols):
    return unif(seed, f"{rel}#{tag}", *cols)


#: "Today" of properties that are dates relative to it; fixed, as every value is a function of seed and key.
AS_OF = "2025-12-31"


# ------------------------------------------------------------------ FIXED VALUES
SUBMIT_CHANNELS = ["phone", "web", "app", "walk_in"]
DEPARTMENTS = ["Computer Science", "Mathematics", "English", "Biology", "Chemistry", "Physics", "History",
               "Psychology", "Business Administration", "Engineering", "Nursing", "Education", "Art", "Music",
               "Philosophy", "Political Science", "Sociology", "Economics"]
COLLEGES = ["Engineering", "Arts & Sciences", "Business", "Health Sciences", "Education", "Fine Arts"]
DEGREE_TYPES = ["BS", "BA", "MS", "MA", "PhD", "MBA", "MEd", "BSN", "BFA", "MFA"]
CAMPUSES = ["Main", "North", "Online", "Downtown", "West"]
SEMESTERS = ["Fall 2023", "Spring 2024", "Summer 2024", "Fall 2024", "Spring 2025", "Summer 2025", "Fall 2025"]
COURSE_LEVELS = [100, 200, 300, 400, 500, 600]
COURSE_PREFIXES = ["Introduction to", "Principles of", "Advanced", "Topics in", "Seminar in", "Research Methods in",
                   "Applied", "Foundations of", "Survey of", "Theory of"]
GRADES12 = ["A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F", "W", "IP"]
ENROLL_STATUS = ["completed", "in_progress", "dropped", "completed"]
START_SEMESTERS = ["Fall 2022", "Spring 2023", "Fall 2023", "Spring 2024"]
GRADUATIONS = ["Spring 2026", "Spring 2027", "Spring 2028"]
FUND_CATEGORIES = ["Federal Grant", "State Appropriation", "Local Revenue", "Bond Proceeds", "Tuition & Fees",
                   "Endowment", "Auxiliary Revenue", "Research Grant", "Foundation Gift", "Fee-for-Service"]
FEDERAL_PROGRAMS = ["Title I", "IDEA", "Title II-A", "Title III", "Title IV-A", "ESSER I", "ESSER II", "ESSER III",
                    "Perkins V", "GEAR UP", "TRIO", "Pell Grant", "Work-Study", "SEOG", "AmeriCorps", "CDBG", "HOME",
                    "WIOA", "Head Start", "SNAP-Ed"]
GRANT_AGENCY_TYPES = ["School District", "County", "City", "State Agency", "Authority", "Commission", "University",
                      "Community College"]
PROGRAM_NAMES = ["Infrastructure", "Public Safety", "Youth Development", "Senior Services", "Education Technology",
                 "Workforce Training", "Community Health", "Housing Development", "Digital Equity",
                 "Economic Development"]
VENDOR_TYPES = ["Contractor", "Supplier", "Consultant", "Technology", "Services", "Construction"]
VENDOR_SUFFIXES = ["LLC", "Inc.", "Corp.", "& Associates", "Group", "Partners", "Solutions", "Enterprises"]
MANAGE_ROLES = ["lead", "partner", "fiscal_agent"]
SERVICE_DEPARTMENTS = ["Public Works", "Transportation", "Water", "Code Enforcement", "Parks", "Building", "Police",
                       "Fire", "Health", "Environmental"]
REQUEST_TYPES = ["pothole_repair", "streetlight_outage", "water_main_break", "noise_complaint", "illegal_dumping",
                 "graffiti_removal", "tree_trimming", "sidewalk_repair", "traffic_signal", "building_inspection",
                 "permit_application", "animal_control", "park_maintenance", "snow_removal", "sewer_backup",
                 "abandoned_vehicle"]
ASSET_TYPES = ["Road Segment", "Bridge", "Building", "Park", "Water Main", "Sewer Line", "Traffic Signal",
               "Streetlight", "Fire Hydrant", "Playground"]
SCHOOL_PREFIXES = ["Washington", "Lincoln", "Jefferson", "Roosevelt", "Martin Luther King Jr.", "Kennedy",
                   "Franklin", "Madison", "Adams", "Hamilton", "Oakwood", "Riverside", "Lakewood", "Hillcrest",
                   "Westfield", "Northview", "Southgate", "Eastport", "Meadowbrook", "Pinecrest"]
RISK_INDICATORS = ["Chronic Absenteeism", "Failing Grades", "Behavioral Issues", "Social Isolation", "Family Crisis",
                   "Substance Abuse Risk", "Mental Health Concern", "Bullying Involvement", "Learning Disability",
                   "Language Barrier", "Homelessness", "Trauma Exposure"]
INTERVENTION_TYPES = ["Academic Tutoring", "Peer Mentoring", "School Counseling", "Parent Conference",
                      "Schedule Modification", "Behavioral Plan", "After-School Program", "Community Mentoring",
                      "Restorative Justice", "Social-Emotional Learning", "Reading Intervention", "Math Support",
                      "Attendance Contract"]
SUBJECTS = ["Mathematics", "English Language Arts", "Science", "Social Studies", "Special Education", "Art", "Music",
            "Physical Education", "ESL/ELL", "Technology", "Reading Specialist", "Counselor"]
REFERRERS = ["teacher", "counselor", "parent"]
PROC_AGENCY_NAMES = ["Department of Transportation", "Department of Education", "Public Safety",
                     "Health & Human Services", "Environmental Protection", "General Services",
                     "Information Technology", "Finance & Administration", "Parks & Recreation", "Housing Authority",
                     "Water Authority", "Port Authority", "Transit Authority", "Corrections Department",
                     "Labor Department", "Agriculture Department"]
COMMODITY_CATEGORIES = ["Construction", "Professional Services", "IT Services & Equipment", "Office Supplies",
                        "Facilities Management", "Consulting", "Staffing & Temp Services", "Transportation & Fleet",
                        "Utilities", "Medical & Lab Supplies", "Security Services", "Food Services",
                        "Janitorial Services", "Legal Services", "Marketing & Communications"]
PROC_VENDOR_KINDS = ["Construction", "Services", "Solutions", "Technologies", "Consulting", "Group", "Industries",
                     "Associates"]
PROC_VENDOR_SUFFIXES = ["LLC", "Inc.", "Corp.", "LP"]
FIRM_KINDS = ["Government Relations", "Public Affairs", "Advocacy Group", "Policy Advisors"]
CONTRACT_UNITS = ["Phase", "Project", "Program", "Initiative", "Contract"]
EFFECTIVENESS = ["highly_effective", "effective", "moderate", "ineffective", "too_early"]
EFFECTIVENESS_WEIGHTS = [1, 3, 3, 2, 2]
METHODS = ["competitive_bid", "sole_source", "emergency", "cooperative", "micro_purchase", "rfq"]
METHOD_WEIGHTS = [5, 2, 1, 2, 3, 2]
HHS_PROGRAMS = ["SNAP", "Medicaid", "TANF", "WIC", "CHIP", "Housing Assistance", "Energy Assistance (LIHEAP)",
                "Childcare Subsidy (CCDF)", "Unemployment Insurance", "Disability (SSDI)", "SSI", "Veterans Benefits",
                "Foster Care", "Adoption Assistance", "Refugee Resettlement", "Substance Abuse Treatment",
                "Mental Health Services", "Domestic Violence Services", "Homeless Prevention", "Job Training (WIOA)"]
HHS_AGENCY_NAMES = ["County Social Services", "Family & Children Services", "Aging Services", "Disability Services",
                    "Behavioral Health", "Community Action Agency", "Public Health Department", "Veterans Affairs",
                    "Refugee Services", "Housing Authority", "Workforce Development", "Child Protective Services"]
SPECIALIZATIONS = ["generalist", "child_welfare", "mental_health", "disability", "elderly", "substance_abuse",
                   "housing", "employment"]
INCOME = ["below_poverty", "low_income", "moderate_income"]
INCOME_WEIGHTS = [4, 4, 2]
HOUSEHOLD = [1, 2, 3, 4, 5, 6, 7, 8]
HOUSEHOLD_WEIGHTS = [15, 25, 20, 20, 10, 5, 3, 2]
#: properties of a case that its relationships carry too
CASE_OPENED = {"name": "opened_date", "type": "date", "begin": "2022-01-01", "end": "2025-12-31", "interval": "days=1", "random": True}
CASE_BENEFIT = {"name": "benefit_amount", "type": "decimal(10,2)", "min": 0, "max": 15000, "random": True}
# -------------------------------------------------------------- end FIXED VALUES


# ---------------------------------------------------------------- F1 enrolment
def enrolment_graph(t: Tables, seed=SEED) -> Graph:
    spark = t.spark
    g = Graph()
    g.add_nodes("Department", lambda: range_nodes(spark, len(DEPARTMENTS), [
        _id("department_id", "DEPT-", 3),
        _by_index("name", DEPARTMENTS, "_ord"),
        _by_index("college", COLLEGES, "_ord"),
        _rng("faculty_count", "int", 15, 80),
    ], "Department", seed), "department_id")
    g.add_nodes("DegreeProgram", lambda: range_nodes(spark, 45, [
        _id("program_id", "PGM-", 3),
        {"name": "name", "type": "string",
         "expr": f"concat(element_at({_arr(DEPARTMENTS)}, cast(pmod(_ord, 18) + 1 as int)), ' ', "
                 f"element_at({_arr(DEGREE_TYPES)}, cast(pmod(_ord, 10) + 1 as int)))"},
        _by_index("degree_type", DEGREE_TYPES, "_ord"),
        {"name": "dept_id", "type": "string", "expr": "concat('DEPT-', lpad(cast(pmod(_ord, 18) + 1 as string), 3, '0'))"},
        _pick("total_credits", [30, 36, 42, 60, 120, 128, 132], type_="int"),
        _flag("accredited", 0.9),
    ], "DegreeProgram", seed), "program_id")
    g.add_nodes("Course", lambda: node_table(t.part, "p_partkey", [
        _id("course_id", "CRS-", 4),
        {**_pick("_prefix", COURSE_PREFIXES), "omit": True},
        {**_pick("_lvl", COURSE_LEVELS, type_="int"), "omit": True},
        {**_rng("_off", "int", 0, 9), "omit": True},
        {"name": "name", "type": "string",
         "expr": f"concat(_prefix, ' ', element_at({_arr(DEPARTMENTS)}, cast(pmod(_ord, 18) + 1 as int)), ' ', "
                 f"lpad(cast(_lvl + _off as string), 3, '0'))"},
        _pick("level", COURSE_LEVELS, type_="int"),
        _pick("credits", [1, 2, 3, 3, 3, 4, 4], type_="int"),
        _pick("max_enrollment", [25, 30, 35, 40, 50, 100, 150, 200], type_="int"),
        _pick("semester", SEMESTERS),
        {"name": "dept_id", "type": "string", "expr": "concat('DEPT-', lpad(cast(pmod(_ord, 18) + 1 as string), 3, '0'))"},
    ], "Course", seed), "course_id")
    g.add_nodes("Student", lambda: node_table(t.customer, "c_custkey", [
        _id("student_id", "STU-", 6),
        _person("name"),
        {"name": "email", "type": "string", "parts": ["student", {"col": "_ord", "offset": 1}, "@university.edu"]},
        _pick("enrollment_year", [2020, 2021, 2022, 2023, 2024, 2025], type_="int"),
        _pick("campus", CAMPUSES),
        _rng("gpa", "decimal(3,2)", 1.5, 4.0),
        _rng("total_credits", "int", 0, 132),
        _pick("status", ["active", "graduated", "on_leave", "suspended", "withdrawn"], [60, 15, 10, 5, 10]),
    ], "Student", seed), "student_id")
    def _offered_by_degreeprogram() -> DataFrame:
        return E.fk_edges(g.node("DegreeProgram"), "program_id", "dept_id", g.node("Department"), "department_id")
    g.add_edges("OFFERED_BY", "DegreeProgram", "Department", _offered_by_degreeprogram)
    def _offered_by_course() -> DataFrame:
        return E.fk_edges(g.node("Course"), "course_id", "dept_id", g.node("Department"), "department_id")
    g.add_edges("OFFERED_BY", "Course", "Department", _offered_by_course)
    def _requires_course() -> DataFrame:
        return E.lower_parent(g.node("Course").select("course_id", "level"), "course_id", "level", 0.6, 200, seed, "REQUIRES")
    g.add_edges("REQUIRES", "Course", "Course", _requires_course)
    def _pursuing_student() -> DataFrame:
        rel = "PURSUING"
        pur = E.k_targets(g.node("Student").select("_ord"), "_ord", 45, 1, 1, seed, rel)
        return pur.select(
        _ids(pur, "src", "STU-", 6).alias("src"), _ids(pur, "dst_ord", "PGM-", 3).alias("dst"),
        pick(_u(seed, rel, "start_semester", F.col("src")), START_SEMESTERS).alias("start_semester"),
        pick(_u(seed, rel, "grad", F.col("src")), GRADUATIONS).alias("expected_graduation"),
        (_u(seed, rel, "adv", F.col("src")) > 0.2).alias("advisor_assigned"))
    g.add_edges("PURSUING", "Student", "DegreeProgram", _pursuing_student)
    def _enrolled_in_student() -> DataFrame:
        rel = "ENROLLED_IN"
        enr = E.k_targets(g.node("Student").select("_ord"), "_ord", rows(t.part), 2, 5, seed, rel)
        enr = enr.join(g.node("Course").select(F.col("_ord").alias("dst_ord"), F.col("semester")), "dst_ord")
        return enr.select(
        _ids(enr, "src", "STU-", 6).alias("src"), _ids(enr, "dst_ord", "CRS-", 4).alias("dst"), "semester",
        pick(_u(seed, rel, "grade", F.col("src"), F.col("j")), GRADES12).alias("grade"),
        pick(_u(seed, rel, "status", F.col("src"), F.col("j")), ENROLL_STATUS).alias("status"))
    g.add_edges("ENROLLED_IN", "Student", "Course", _enrolled_in_student)
    return g


# ------------------------------------------------------------------ F2 grants
def grants_graph(t: Tables, seed=SEED) -> Graph:
    g = Graph()
    g.add_nodes("FundingSource", lambda: node_table(t.nation, "n_nationkey", [
        _id("fund_id", "FUND-", 3),
        {**_pick("_prog", FEDERAL_PROGRAMS), "omit": True},
        {**_pick("_fy", [2023, 2024, 2025, 2026], type_="int"), "omit": True},
        {"name": "name", "type": "string", "expr": "concat(_prog, ' - FY', _fy)"},
        _pick("category", FUND_CATEGORIES),
        _rng("total_budget", "decimal(14,2)", 50000, 50000000),
        _pick("fiscal_year", [2023, 2024, 2025, 2026], type_="int"),
    ], "FundingSource", seed), "fund_id")
    g.add_nodes("Agency", lambda: node_table(t.nation, "n_nationkey", [
        _id("agency_id", "AGY-", 3),
        {**_pick("_city", pools.CITIES), "omit": True},
        {**_pick("_kind", GRANT_AGENCY_TYPES), "omit": True},
        {"name": "name", "type": "string", "expr": "concat(_city, ' ', _kind)"},
        _pick("type", GRANT_AGENCY_TYPES),
    ], "Agency", seed), "agency_id")
    g.add_nodes("Program", lambda: node_table(t.part, "p_partkey", [
        _id("program_id", "PGM-", 4),
        {**_pick("_pname", PROGRAM_NAMES), "omit": True},
        {**_rng("_phase", "int", 1, 5), "omit": True},
        {"name": "name", "type": "string", "expr": "concat(_pname, ' Phase ', _phase)"},
        _rng("budget_allocated", "decimal(12,2)", 10000, 5000000),
        _pick("status", ["active", "completed", "pending", "suspended"], [5, 2, 2, 1]),
    ], "Program", seed), "program_id")
    g.add_nodes("Vendor", lambda: node_table(t.supplier, "s_suppkey", [
        _id("vendor_id", "VND-", 4),
        {**_pick("_last", pools.LAST_NAMES), "omit": True},
        {**_pick("_kind", VENDOR_TYPES), "omit": True},
        {**_pick("_suffix", VENDOR_SUFFIXES), "omit": True},
        {"name": "name", "type": "string", "expr": "concat_ws(' ', _last, _kind, _suffix)"},
        _pick("type", VENDOR_TYPES),
        _pick("state", pools.STATES),
        _flag("minority_owned", 0.18),
        _flag("small_business", 0.35),
    ], "Vendor", seed), "vendor_id")
    g.add_nodes("LineItem", lambda: node_table(t.orders, "o_orderkey", [
        _id("line_item_id", "LI-", 6),
        _rng("amount", "decimal(12,2)", 100, 500000),
        _pick("type", ["expenditure", "encumbrance", "allocation", "transfer"], [5, 2, 2, 1]),
    ], "LineItem", seed), "line_item_id")
    def _funds_fundingsource() -> DataFrame:
        rel = "FUNDS"
        fe = E.bernoulli_edges(g.node("FundingSource").select("_ord", "fiscal_year"), "_ord", rows(t.nation), 0.3, seed, rel)
        fe = fe.join(g.node("FundingSource").select(F.col("_ord").alias("src"), "fiscal_year"), "src")
        return fe.select(
        _ids(fe, "src", "FUND-", 3).alias("src"), _ids(fe, "dst_ord", "AGY-", 3).alias("dst"),
        int_between(_u(seed, rel, "amount", F.col("src"), F.col("dst_ord")), 0, 4999999).alias("amount"),
        "fiscal_year")
    g.add_edges("FUNDS", "FundingSource", "Agency", _funds_fundingsource)
    def _manages_agency() -> DataFrame:
        return manages_edges(t, g.node("Agency").select("_ord"), seed)
    g.add_edges("MANAGES", "Agency", "Program", _manages_agency)
    def _awards_program() -> DataFrame:
        return awards_edges(t, g.node("Program").select("_ord"), seed)
    g.add_edges("AWARDS", "Program", "Vendor", _awards_program)
    def _subcontracts_vendor() -> DataFrame:
        rel = "SUBCONTRACTS"
        se = E.bernoulli_edges(g.node("Vendor").select("_ord", F.col("_ord").alias("_me")), "_ord", rows(t.supplier), 0.008, seed,
                               rel, exclude_self_ordinal="_me")
        return se.select(
        _ids(se, "src", "VND-", 4).alias("src"), _ids(se, "dst_ord", "VND-", 4).alias("dst"),
        int_between(_u(seed, rel, "pct", F.col("src"), F.col("dst_ord")), 5, 44).alias("percentage"))
    g.add_edges("SUBCONTRACTS", "Vendor", "Vendor", _subcontracts_vendor)
    def _has_line_item_program() -> DataFrame:
        rel = "HAS_LINE_ITEM"
        # one (program, line item) pair per line item
        hp = E.distinct_pairs(t.orders, "o_orderkey", rows(t.part), rows(t.orders), seed, rel)
        return hp.select(
        _ids(hp, "a_ord", "PGM-", 4).alias("src"), _ids(hp, "b_ord", "LI-", 6).alias("dst"))
    g.add_edges("HAS_LINE_ITEM", "Program", "LineItem", _has_line_item_program)
    return g


def manages_edges(t: Tables, agency_ords: DataFrame, seed=SEED) -> DataFrame:
    """MANAGES (Agency -> Program, p = 0.15) for the given agency ordinals (a subset gives the subset)."""
    rel = "MANAGES"
    me = E.bernoulli_edges(agency_ords.select("_ord"), "_ord", rows(t.part), 0.15, seed, rel)
    return me.select(
        _ids(me, "src", "AGY-", 3).alias("src"), _ids(me, "dst_ord", "PGM-", 4).alias("dst"),
        pick(_u(seed, rel, "role", F.col("src"), F.col("dst_ord")), MANAGE_ROLES).alias("role"))


def awards_edges(t: Tables, program_ords: DataFrame, seed=SEED) -> DataFrame:
    """AWARDS (Program -> Vendor, p = 0.05) for the given program ordinals.

    Edges are a pure function of (seed, program), so the edges of any subset
    of programs are exactly the subset of the full relationship: a query that
    needs only a few programs regenerates only their edges.
    """
    rel = "AWARDS"
    ae = E.bernoulli_edges(program_ords.select("_ord"), "_ord", rows(t.supplier), 0.05, seed, rel)
    return ae.select(
        _ids(ae, "src", "PGM-", 4).alias("src"), _ids(ae, "dst_ord", "VND-", 4).alias("dst"),
        int_between(_u(seed, rel, "amount", F.col("src"), F.col("dst_ord")), 0, 1999999).alias("contract_amount"),
        F.date_add(F.lit("2023-01-01").cast("date"), int_between(_u(seed, rel, "date", F.col("src"), F.col("dst_ord")), 0, 1094).cast("int")).alias("award_date"))


# ------------------------------------------------------------ F3 citizen services
def citizen_graph(t: Tables, seed=SEED) -> Graph:
    spark = t.spark
    g = Graph()
    g.add_nodes("District", lambda: range_nodes(spark, 15, [
        _id("district_id", "DIST-", 2),
        {"name": "name", "type": "string", "expr": "concat('District ', _ord + 1)"},
    ], "District", seed), "district_id")
    g.add_nodes("ServiceDepartment", lambda: range_nodes(spark, len(SERVICE_DEPARTMENTS), [
        _id("dept_id", "SDEPT-", 2),
        _by_index("name", SERVICE_DEPARTMENTS, "_ord"),
    ], "ServiceDepartment", seed), "dept_id")
    g.add_nodes("Asset", lambda: node_table(t.part, "p_partkey", [
        _id("asset_id", "AST-", 5),
        _pick("type", ASSET_TYPES),
        _pick("condition", ["good", "fair", "poor", "critical"], [4, 3, 2, 1]),
        _rng("install_year", "int", 1970, 2024),
        _rng("_dist", "int", 1, 15),
    ], "Asset", seed).withColumn("district_id", padded("DIST-", F.col("_dist"), 2)).drop("_dist"), "asset_id")
    g.add_nodes("Citizen", lambda: node_table(t.customer, "c_custkey", [
        _id("citizen_id", "CIT-", 5),
        _person("name"),
        _rng("district", "int", 1, 15),
    ], "Citizen", seed), "citizen_id")
    g.add_nodes("ServiceRequest", lambda: _requests(t, seed), "request_id")
    def _in_district_asset() -> DataFrame:
        return E.fk_edges(g.node("Asset"), "asset_id", "district_id", g.node("District"),
                                                              "district_id")
    g.add_edges("IN_DISTRICT", "Asset", "District", _in_district_asset)
    def _submitted_citizen() -> DataFrame:
        rel = "SUBMITTED"
        sp = E.distinct_pairs(t.orders, "o_orderkey", rows(t.customer), rows(t.orders), seed, rel)
        return sp.select(
        _ids(sp, "a_ord", "CIT-", 5).alias("src"), _ids(sp, "b_ord", "SR-", 6).alias("dst"),
        pick(_u(seed, rel, "channel", F.col("a_ord"), F.col("b_ord")), SUBMIT_CHANNELS).alias("channel"))
    g.add_edges("SUBMITTED", "Citizen", "ServiceRequest", _submitted_citizen)
    def _assigned_to_servicerequest() -> DataFrame:
        rel = "ASSIGNED_TO"
        asg = E.k_targets(g.node("ServiceRequest").select("_ord", "created_date"), "_ord", len(SERVICE_DEPARTMENTS), 1, 1, seed, rel)
        asg = asg.join(g.node("ServiceRequest").select(F.col("_ord").alias("src"), "created_date"), "src")
        return asg.select(
        _ids(asg, "src", "SR-", 6).alias("src"), _ids(asg, "dst_ord", "SDEPT-", 2).alias("dst"),
        F.col("created_date").alias("assigned_date"))
    g.add_edges("ASSIGNED_TO", "ServiceRequest", "ServiceDepartment", _assigned_to_servicerequest)
    def _affects_servicerequest() -> DataFrame:
        rel = "AFFECTS"
        # the source keeps ~30% of requests and gives each one asset
        src = g.node("ServiceRequest").filter(_u(seed, rel, "keep", F.col("_ord")) < 0.3).select("_ord")
        af = E.k_targets(src, "_ord", rows(t.part), 1, 1, seed, rel)
        return af.select(
        _ids(af, "src", "SR-", 6).alias("src"), _ids(af, "dst_ord", "AST-", 5).alias("dst"))
    g.add_edges("AFFECTS", "ServiceRequest", "Asset", _affects_servicerequest)
    return g


def _requests(t: Tables, seed) -> DataFrame:
    base = t.orders.select(F.col("o_orderkey").cast("bigint").alias("_ord"), "o_orderdate")
    spec = [
        _id("request_id", "SR-", 6),
        _pick("type", REQUEST_TYPES),
        _pick("status", ["opened", "assigned", "in_progress", "pending_review", "resolved", "closed", "reopened"],
              [2, 2, 3, 1, 4, 5, 1]),
        _pick("priority", ["critical", "high", "medium", "low"], [1, 2, 4, 3]),
        {"name": "created_date", "type": "date", "expr": "cast(o_orderdate as date)"},
    ]
    return apply_spec(base, with_more("ServiceRequest", spec), key="_ord", seed=f"{seed}/ServiceRequest", keep=["_ord"])


# --------------------------------------------------------------- F4 early warning
def early_warning_graph(t: Tables, seed=SEED) -> Graph:
    spark = t.spark
    g = Graph()
    g.add_nodes("School", lambda: node_table(t.nation, "n_nationkey", [
        _id("school_id", "SCH-", 3),
        {**_pick("_kind", ["Elementary", "Middle", "High"]), "omit": True},
        {"name": "name", "type": "string",
         "expr": f"concat(element_at({_arr(SCHOOL_PREFIXES)}, cast(pmod(_ord, {len(SCHOOL_PREFIXES)}) + 1 as int)), ' ', _kind, ' School')"},
        _pick("type", ["elementary", "middle", "high"], [5, 3, 2]),
        _rng("enrollment", "int", 200, 2500),
        _flag("title_i", 0.55),
    ], "School", seed), "school_id")
    n_school = rows(t.nation)
    g.add_nodes("Teacher", lambda: node_table(t.supplier, "s_suppkey", [
        _id("teacher_id", "TCH-", 4),
        _person("name"),
        _pick("subject", SUBJECTS),
        {"name": "school_id", "type": "string", "parts": ["SCH-", {"mod": n_school, "offset": 1, "pad": 3}]},
    ], "Teacher", seed), "teacher_id")
    g.add_nodes("RiskIndicator", lambda: range_nodes(spark, len(RISK_INDICATORS), [
        _id("indicator_id", "RI-", 2),
        _by_index("name", RISK_INDICATORS, "_ord"),
        _pick("category", ["academic", "behavioral", "social_emotional", "environmental"]),
    ], "RiskIndicator", seed), "indicator_id")
    g.add_nodes("K12Student", lambda: node_table(t.customer, "c_custkey", [
        _id("student_id", "K12-", 5),
        _person("name"),
        _rng("grade_level", "int", 1, 12),
        _rng("gpa", "decimal(3,2)", 0.5, 4.0),
        _rng("attendance_rate", "decimal(5,1)", 60, 100),
        _rng("risk_score", "decimal(5,1)", 0, 100),
        _pick("behavior_incidents_ytd", list(range(15)), [50, 10, 8, 6, 5, 4, 3, 2, 2, 2, 1, 1, 1, 1, 1], "int"),
        _flag("gifted", 0.08),
        _flag("free_reduced_lunch", 0.45),
        _flag("english_learner", 0.15),
        _flag("special_education", 0.13),
    ], "K12Student", seed), "student_id")
    g.add_nodes("Intervention", lambda: node_table(t.part, "p_partkey", [
        _id("intervention_id", "INT-", 5),
        _pick("effectiveness", EFFECTIVENESS, EFFECTIVENESS_WEIGHTS),
        _pick("type", INTERVENTION_TYPES),
        _pick("status", ["active", "completed", "discontinued", "pending"], [4, 3, 2, 1]),
    ], "Intervention", seed), "intervention_id")
    def _works_at_teacher() -> DataFrame:
        return E.fk_edges(g.node("Teacher"), "teacher_id", "school_id", g.node("School"), "school_id")
    g.add_edges("WORKS_AT", "Teacher", "School", _works_at_teacher)
    def _attends_raw() -> DataFrame:
        at = E.k_targets(g.node("K12Student").select("_ord"), "_ord", n_school, 1, 1, seed, "ATTENDS")
        return at.withColumn("school_id", _ids(at, "dst_ord", "SCH-", 3))

    def _attends_k12student() -> DataFrame:
        at = _attends_raw()
        back = int_between(_u(seed, "ATTENDS", "days", F.col("src")), 0, 999).cast("int")
        return at.select(_ids(at, "src", "K12-", 5).alias("src"), F.col("school_id").alias("dst"),
                         F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), back), "yyyy-MM-dd").alias("enrollment_date"))
    g.add_edges("ATTENDS", "K12Student", "School", _attends_k12student)

    def _taught_by_k12student() -> DataFrame:
        rel = "TAUGHT_BY"
        st = _attends_raw().select(F.col("src").alias("_s"), "school_id")
        tb = E.two_hop_targets(st, "_s", "school_id", g.node("Teacher"), "teacher_id", "school_id", 3, seed, rel)
        # teachers of the student's own school, drawn inside the school (no student x teacher pairs)
        tb = tb.join(g.node("Teacher").select(F.col("teacher_id").alias("dst"), "subject"), "dst")
        return tb.select(
            _ids(tb, "src", "K12-", 5).alias("src"), F.col("dst"), "subject",
            int_between(_u(seed, rel, "period", F.col("src"), F.col("dst")), 1, 8).alias("period"))
    g.add_edges("TAUGHT_BY", "K12Student", "Teacher", _taught_by_k12student)
    def _targets_intervention() -> DataFrame:
        rel = "TARGETS"
        te = E.bernoulli_edges(g.node("Intervention").select("_ord"), "_ord", len(RISK_INDICATORS), 0.15, seed, rel)
        return te.select(
        _ids(te, "src", "INT-", 5).alias("src"), _ids(te, "dst_ord", "RI-", 2).alias("dst"))
    g.add_edges("TARGETS", "Intervention", "RiskIndicator", _targets_intervention)
    def _received_k12student() -> DataFrame:
        rel = "RECEIVED"
        risky = g.node("K12Student").filter(F.col("risk_score") > 40).select("_ord")
        re_ = E.k_targets(risky, "_ord", rows(t.part), 1, 2, seed, rel)
        return re_.select(
        _ids(re_, "src", "K12-", 5).alias("src"), _ids(re_, "dst_ord", "INT-", 5).alias("dst"),
        pick(_u(seed, rel, "ref", F.col("src"), F.col("j")), REFERRERS).alias("referred_by"))
    g.add_edges("RECEIVED", "K12Student", "Intervention", _received_k12student)
    return g


# ----------------------------------------------------------------- F5 procurement
def procurement_graph(t: Tables, seed=SEED) -> Graph:
    g = Graph()
    g.add_nodes("ProcAgency", lambda: node_table(t.nation, "n_nationkey", [
        _id("agency_id", "PAGY-", 3),
        {**_pick("_city", pools.CITIES), "omit": True},
        {"name": "name", "type": "string",
         "expr": f"concat(_city, ' ', element_at({_arr(PROC_AGENCY_NAMES)}, "
                 f"cast(pmod(_ord, {len(PROC_AGENCY_NAMES)}) + 1 as int)))"},
        _pick("state", pools.STATES),
    ], "ProcAgency", seed), "agency_id")
    g.add_nodes("ProcVendor", lambda: node_table(t.supplier, "s_suppkey", [
        _id("vendor_id", "PVND-", 4),
        {**_pick("_last", pools.LAST_NAMES), "omit": True},
        {**_pick("_kind", PROC_VENDOR_KINDS), "omit": True},
        {**_pick("_suffix", PROC_VENDOR_SUFFIXES), "omit": True},
        {"name": "name", "type": "string", "expr": "concat_ws(' ', _last, _kind, _suffix)"},
        _pick("state", pools.STATES),
        _flag("minority_owned", 0.18),
        _flag("woman_owned", 0.15),
        _flag("small_business", 0.35),
    ], "ProcVendor", seed), "vendor_id")
    g.add_nodes("Contract", lambda: node_table(t.part, "p_partkey", [
        _id("contract_id", "CTR-", 5),
        {**_pick("_what", COMMODITY_CATEGORIES), "omit": True},
        {**_pick("_unit", CONTRACT_UNITS), "omit": True},
        {**_rng("_number", "int", 1, 999), "omit": True},
        {"name": "title", "type": "string", "expr": "concat(_what, ' - ', _unit, ' ', _number)"},
        _rng("amount", "decimal(14,2)", 5000, 25000000),
        _pick("method", METHODS, METHOD_WEIGHTS),
        _pick("category", COMMODITY_CATEGORIES),
        _pick("status", ["active", "completed", "pending", "terminated", "expired"], [4, 3, 1, 1, 1]),
    ], "Contract", seed), "contract_id")
    g.add_nodes("Lobbyist", lambda: node_table(t.supplier, "s_suppkey", [
        _id("lobbyist_id", "LOB-", 4),
        _person("name"),
        {**_pick("_l1", pools.LAST_NAMES), "omit": True},
        {**_pick("_l2", pools.LAST_NAMES), "omit": True},
        {**_pick("_fk", FIRM_KINDS), "omit": True},
        {"name": "firm", "type": "string", "expr": "concat(_l1, ' & ', _l2, ' ', _fk)"},
    ], "Lobbyist", seed), "lobbyist_id")
    def _issued_procagency() -> DataFrame:
        rel = "ISSUED"
        iss = E.distinct_pairs(t.part, "p_partkey", rows(t.nation), rows(t.part), seed, rel)
        return iss.select(
        _ids(iss, "a_ord", "PAGY-", 3).alias("src"), _ids(iss, "b_ord", "CTR-", 5).alias("dst"),
        int_between(_u(seed, rel, "year", F.col("a_ord"), F.col("b_ord")), 2023, 2025).alias("fiscal_year"))
    g.add_edges("ISSUED", "ProcAgency", "Contract", _issued_procagency)
    def _awarded_to_contract() -> DataFrame:
        rel = "AWARDED_TO"
        aw = E.k_targets(g.node("Contract").select("_ord"), "_ord", rows(t.supplier), 1, 1, seed, rel)
        aw = _node_values(aw, "src", "Contract", _more("Contract", "start_date"), seed)
        return aw.select(
        _ids(aw, "src", "CTR-", 5).alias("src"), _ids(aw, "dst_ord", "PVND-", 4).alias("dst"), F.col("start_date").alias("award_date"),
        int_between(_u(seed, rel, "bids", F.col("src")), 1, 12).alias("bid_count"))
    g.add_edges("AWARDED_TO", "Contract", "ProcVendor", _awarded_to_contract)
    def _subcontracts_to_procvendor() -> DataFrame:
        rel = "SUBCONTRACTS_TO"
        sc = E.bernoulli_edges(g.node("ProcVendor").select("_ord", F.col("_ord").alias("_me")), "_ord", rows(t.supplier), 0.005, seed,
                               rel, exclude_self_ordinal="_me")
        sc = _node_values(sc, "dst_ord", "ProcVendor", _more("ProcVendor", "specialty"), seed)
        return sc.select(
        _ids(sc, "src", "PVND-", 4).alias("src"), _ids(sc, "dst_ord", "PVND-", 4).alias("dst"), F.col("specialty").alias("scope"),
        int_between(_u(seed, rel, "pct", F.col("src"), F.col("dst_ord")), 5, 44).alias("percentage"))
    g.add_edges("SUBCONTRACTS_TO", "ProcVendor", "ProcVendor", _subcontracts_to_procvendor)
    def _represents_lobbyist() -> DataFrame:
        rel = "REPRESENTS"
        rp = E.bernoulli_edges(g.node("Lobbyist").select("_ord"), "_ord", rows(t.supplier), 0.02, seed, rel)
        rp = _node_values(rp, "src", "Lobbyist", _more("Lobbyist", "registration_date"), seed)
        return rp.select(
        _ids(rp, "src", "LOB-", 4).alias("src"), _ids(rp, "dst_ord", "PVND-", 4).alias("dst"), F.col("registration_date").alias("since"))
    g.add_edges("REPRESENTS", "Lobbyist", "ProcVendor", _represents_lobbyist)
    return g


# ---------------------------------------------------------------- F6 benefit cases
def benefits_graph(t: Tables, seed=SEED) -> Graph:
    spark = t.spark
    g = Graph()
    g.add_nodes("HHSAgency", lambda: node_table(t.nation, "n_nationkey", [
        _id("agency_id", "HHS-", 3),
        {**_pick("_city", pools.CITIES), "omit": True},
        {**_pick("_kind", HHS_AGENCY_NAMES), "omit": True},
        {"name": "name", "type": "string", "expr": "concat(_city, ' ', _kind)"},
        _pick("type", HHS_AGENCY_NAMES),
    ], "HHSAgency", seed), "agency_id")
    g.add_nodes("HHSProgram", lambda: range_nodes(spark, len(HHS_PROGRAMS), [
        _id("program_id", "HHSP-", 2),
        _by_index("name", HHS_PROGRAMS, "_ord"),
        _pick("category", ["nutrition", "healthcare", "cash_assistance", "housing", "employment", "disability",
                           "child_welfare"]),
    ], "HHSProgram", seed), "program_id")
    n_ag = rows(t.nation)
    g.add_nodes("Caseworker", lambda: node_table(t.supplier, "s_suppkey", [
        _id("caseworker_id", "CW-", 4),
        _person("name"),
        _pick("specialization", SPECIALIZATIONS),
        {"name": "agency_id", "type": "string", "parts": ["HHS-", {"mod": n_ag, "offset": 1, "pad": 3}]},
    ], "Caseworker", seed), "caseworker_id")
    g.add_nodes("Client", lambda: node_table(t.customer, "c_custkey", [
        _id("client_id", "CLT-", 5),
        _person("name"),
        _pick("household_size", HOUSEHOLD, HOUSEHOLD_WEIGHTS, "int"),
        _pick("income_bracket", INCOME, INCOME_WEIGHTS),
        {**_pick("_city", pools.CITIES), "omit": True},
        {"name": "county", "type": "string", "expr": "concat(_city, ' County')"},
    ], "Client", seed), "client_id")
    g.add_nodes("Case", lambda: node_table(t.orders, "o_orderkey", [
        _id("case_id", "CASE-", 6),
        _pick("status", ["open", "under_review", "approved", "denied", "closed", "appealed"], [3, 2, 4, 2, 3, 1]),
        _pick("priority", ["emergency", "urgent", "standard", "low"], [1, 2, 5, 2]),
        _pick("determination", ["approved", "denied", "pending", "deferred", "conditional"], [5, 2, 2, 1, 1]),
        _rng("benefit_amount", "decimal(10,2)", 0, 15000),
    ], "Case", seed), "case_id")
    def _works_at_caseworker() -> DataFrame:
        return E.fk_edges(g.node("Caseworker"), "caseworker_id", "agency_id", g.node("HHSAgency"),
                                                                  "agency_id")
    g.add_edges("WORKS_AT", "Caseworker", "HHSAgency", _works_at_caseworker)
    def _administers_hhsagency() -> DataFrame:
        rel = "ADMINISTERS"
        ad = E.bernoulli_edges(g.node("HHSAgency").select("_ord"), "_ord", len(HHS_PROGRAMS), 0.25, seed, rel)
        return ad.select(
        _ids(ad, "src", "HHS-", 3).alias("src"), _ids(ad, "dst_ord", "HHSP-", 2).alias("dst"))
    g.add_edges("ADMINISTERS", "HHSAgency", "HHSProgram", _administers_hhsagency)
    def _has_case_client() -> DataFrame:
        rel = "HAS_CASE"
        hc = E.distinct_pairs(t.orders, "o_orderkey", rows(t.customer), rows(t.orders), seed, rel)
        hc = _node_values(hc, "b_ord", "Case", [CASE_OPENED], seed)
        return hc.select(
        _ids(hc, "a_ord", "CLT-", 5).alias("src"), _ids(hc, "b_ord", "CASE-", 6).alias("dst"), F.col("opened_date").alias("intake_date"))
    g.add_edges("HAS_CASE", "Client", "Case", _has_case_client)
    def _managed_by_case() -> DataFrame:
        rel = "MANAGED_BY"
        mb = E.k_targets(g.node("Case").select("_ord"), "_ord", rows(t.supplier), 1, 1, seed, rel)
        mb = _node_values(mb, "src", "Case", [CASE_OPENED], seed)
        return mb.select(
        _ids(mb, "src", "CASE-", 6).alias("src"), _ids(mb, "dst_ord", "CW-", 4).alias("dst"), F.col("opened_date").alias("assigned_date"))
    g.add_edges("MANAGED_BY", "Case", "Caseworker", _managed_by_case)
    def _enrolled_in_case() -> DataFrame:
        rel = "ENROLLED_IN"
        appr = g.node("Case").filter(F.col("determination") == "approved").select("_ord")
        en = E.k_targets(appr, "_ord", len(HHS_PROGRAMS), 1, 2, seed, rel)
        en = _node_values(en, "src", "Case", [CASE_OPENED, CASE_BENEFIT], seed)
        return en.select(
        _ids(en, "src", "CASE-", 6).alias("src"), _ids(en, "dst_ord", "HHSP-", 2).alias("dst"),
        F.col("opened_date").alias("start_date"), F.col("benefit_amount").alias("monthly_benefit"),
        pick(_u(seed, rel, "status", F.col("src"), F.col("dst_ord")), ["active", "suspended", "active"]).alias("status"))
    g.add_edges("ENROLLED_IN", "Case", "HHSProgram", _enrolled_in_case)
    def _referred_client() -> DataFrame:
        rel = "REFERRED"
        # Bernoulli 0.003 inside each county, no self pairs: ordinals inside the county block
        cl = E.ordinals(g.node("Client").select("_ord", "county"), "_ord", ["county"], "_bo")
        sizes = cl.groupBy("county").agg(F.count("*").alias("_bn"))
        src = cl.join(sizes, "county")
        rf = E.bernoulli_edges(src.select("_ord", "county", "_bn", F.col("_bo").alias("_me")), "_ord", F.col("_bn"),
                               0.003, seed, rel, block="county", exclude_self_ordinal="_me")
        rf = rf.join(cl.select(F.col("_ord").alias("_dst"), "county", F.col("_bo").alias("dst_ord")), ["county", "dst_ord"])
        return rf.select(
        _ids(rf, "src", "CLT-", 5).alias("src"), _ids(rf, "_dst", "CLT-", 5).alias("dst"), F.lit("community").alias("source"),
        F.lit(AS_OF).alias("date"))
    g.add_edges("REFERRED", "Client", "Client", _referred_client)
    return g


GRAPHS = {
    "student_enrollment": enrolment_graph,
    "grant_budget": grants_graph,
    "citizen_services": citizen_graph,
    "k12_early_warning": early_warning_graph,
    "procurement": procurement_graph,
    "case_management": benefits_graph,
}
