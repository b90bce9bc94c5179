"""§2.H graph analytics: the source's Cypher patterns as DataFrame joins.

Each function builds the graph it needs (lazily; only the node and edge
tables a pattern touches are planned) and expresses the pattern with
``operators.graph``: ``hop`` for each relationship, a left join of the whole
optional part for OPTIONAL MATCH, ``var_length_paths`` for ``*1..n``.
``collect`` results are sorted (Cypher's encounter order is unspecified) and
every ``ORDER BY .. LIMIT`` gets a full tie-break so results are stable.
Grouping columns are kept exactly as written in the source (names, not ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.communities import co_membership, communities, modularity
from ..operators.graph import Graph, connected_components, hop, reachable, var_length_paths
from ..operators.topk import top_k
from ..session import settled
from ..sources.fixtures import Tables
from . import datasets as D
from . import graphs as G
from . import user_graphs as U


def _r(c, n):
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), n)


# ------------------------------------------------------------------- enrolment
def h1_department_enrolment(t: Tables) -> DataFrame:
    g = G.enrolment_graph(t)
    x = g.rel("ENROLLED_IN").select(F.col("src").alias("student_id"), F.col("dst").alias("course_id"))
    x = hop(x, "course_id", g.rel("OFFERED_BY", "Course"), g.node("Department"), "department_id",
            target_cols={"name": "department"})
    return (x.groupBy("department")
            .agg(F.count_distinct("student_id").alias("students"), F.count("*").alias("enrollments"))
            .orderBy(F.desc("students"), "department"))


def h2_prerequisite_chains(t: Tables, k: int = 20) -> DataFrame:
    g = G.enrolment_graph(t)
    course = g.node("Course")
    p = var_length_paths(course.select("course_id"), "course_id", g.rel("REQUIRES"), 1, 5,
                         node_names=course, name_key="course_id", name_col="name")
    p = p.join(course.select(F.col("course_id").alias("start"), F.col("name").alias("course"), "level"), "start")
    out = p.select("course", "level", F.col("depth").alias("prereq_depth"),
                   F.array_join("chain", " > ").alias("chain"))
    return top_k(out, k, [F.desc("prereq_depth"), "course", "chain", "level"])


def h3_program_distribution(t: Tables, k: int = 20) -> DataFrame:
    g = G.enrolment_graph(t)
    s = g.node("Student").select("student_id", "gpa")
    x = hop(s, "student_id", g.rel("PURSUING"), g.node("DegreeProgram"), "program_id",
            target_cols={"degree_type": "degree"})
    x = hop(x, "program_id", g.rel("OFFERED_BY", "DegreeProgram"), g.node("Department"), "department_id",
            target_cols={"name": "department"})
    out = x.groupBy("degree", "department").agg(F.count("*").alias("students"),
                                                _r(F.avg(F.col("gpa").cast("double")), 2).alias("avg_gpa"))
    return top_k(out, k, [F.desc("students"), "degree", "department", "avg_gpa"])


def h20_failed_then_retaken(t: Tables) -> DataFrame:
    """Two enrolments of one (student, course): grade F first, a later semester second.

    The enrolment events are searched, where a student may meet a course again (in the graph a student has a course
    once). Semesters compare by (year, term order), not as text.
    """
    g = G.enrolment_graph(t)
    term = F.when(F.col("semester").startswith("Spring"), 1).when(F.col("semester").startswith("Summer"), 2).otherwise(3)
    key = (F.regexp_extract("semester", r"(\d{4})", 1).cast("int") * 10 + term)
    e = D.enrollment_events(t).select("student_id", "course_id", "semester", "grade", key.alias("_sk"))
    e1 = e.filter(F.col("grade") == "F").select("student_id", "course_id", F.col("semester").alias("failed_semester"),
                                                F.col("_sk").alias("_k1"))
    e2 = e.select("student_id", "course_id", F.col("semester").alias("retake_semester"), F.col("grade").alias("retake_grade"),
                  F.col("_sk").alias("_k2"))
    j = e1.join(e2, ["student_id", "course_id"]).filter(F.col("_k2") > F.col("_k1"))
    j = j.join(g.node("Student").select("student_id", F.col("name").alias("student")), "student_id")
    j = j.join(g.node("Course").select("course_id", F.col("name").alias("course")), "course_id")
    return j.select("student", "course", "failed_semester", "retake_semester", "retake_grade")


def h31_shared_courses(t: Tables, flagged: str = "STU-000001", min_shared: int = 3) -> DataFrame:
    """Students sharing >= ``min_shared`` courses with one flagged student.

    Only the flagged student's courses are joined against the enrolment edges,
    so the work is O(enrolments in those courses), not all pairs of students.
    """
    g = G.enrolment_graph(t)
    e = g.rel("ENROLLED_IN").select("src", "dst")
    mine = e.filter(F.col("src") == flagged).select("dst").distinct()
    return (e.join(mine, "dst").filter(F.col("src") != flagged)
            .groupBy(F.col("src").alias("student_id")).agg(F.count_distinct("dst").alias("shared_courses"))
            .filter(F.col("shared_courses") >= min_shared))


def h34_avg_gpa_by_department(t: Tables) -> DataFrame:
    g = G.enrolment_graph(t)
    x = g.rel("ENROLLED_IN").select(F.col("src").alias("student_id"), F.col("dst").alias("course_id")).distinct()
    x = hop(x, "course_id", g.rel("OFFERED_BY", "Course"), g.node("Department"), "department_id",
            target_cols={"name": "department"})
    x = x.select("student_id", "department").distinct().join(g.node("Student").select("student_id", "gpa"),
                                                             "student_id")
    return (x.groupBy("department").agg(F.count("*").alias("students"),
                                        _r(F.sum("gpa").cast("double") / F.count("*"), 4).alias("avg_gpa"))
            .orderBy("department"))


# ---------------------------------------------------------------------- grants
def _ords(col: str, prefix_len: int):
    """Ordinal back from a padded text id such as ``AGY-007`` (id = prefix + ordinal + 1)."""
    return F.expr(f"CAST(substring({col}, {prefix_len + 1}) AS BIGINT) - 1").alias("_ord")


def h4_funding_trace(t: Tables, k: int = 25, ranges: int = 1024) -> DataFrame:
    """Top k paths FundingSource-FUNDS->Agency-MANAGES->Program-AWARDS->Vendor by FUNDS.amount.

    The ranking key sits on the first edge, so the plan prunes before it
    widens, and runs nothing while it is built. The continuations of every
    agency (programs it manages times vendors those programs award) are
    counted, FUNDS edges are dealt into ``ranges`` equal ranges of the amount,
    and the running total of continuations over the ranges, one row for each,
    tells how far down k paths are reached. FUNDS edges down to that range
    (whole, so ties are included) are expanded, regenerating just the MANAGES
    and AWARDS edges of the agencies and programs involved (edges are functions
    of their source), and the top k paths are taken. Exact: every other path
    ranks below k others.
    """
    g = G.grants_graph(t)
    funds = g.rel("FUNDS").select(F.col("src").alias("fund_id"), F.col("dst").alias("agency_id"), "amount")
    managed = G.manages_edges(t, g.node("Agency").select("_ord"))
    per_program = G.awards_edges(t, managed.select(_ords("dst", 4)).distinct()).groupBy(F.col("src").alias("program_id")).agg(F.count("*").alias("_nv"))
    cont = (managed.select(F.col("src").alias("agency_id"), F.col("dst").alias("program_id"))
            .join(per_program, "program_id").groupBy("agency_id").agg(F.sum("_nv").alias("_cont")))
    top, low = funds.agg(F.max("amount")).scalar(), funds.agg(F.min("amount")).scalar()
    dealt = funds.withColumn("_range", F.floor((top - F.col("amount")) * ranges / (top - low + 1)))
    totals = dealt.join(cont, "agency_id").groupBy("_range").agg(F.sum("_cont").alias("_n"))
    running = totals.withColumn("_so_far", F.sum("_n").over(Window.orderBy("_range")))  # ``ranges`` rows at most
    last = running.filter(F.col("_so_far") >= k).agg(F.coalesce(F.min("_range"), F.lit(ranges))).scalar()
    top_funds = dealt.filter(F.col("_range") <= last).drop("_range")
    f = g.node("FundingSource").select("fund_id", F.col("name").alias("fund_source"), "category")
    x = f.join(top_funds, "fund_id")
    x = x.join(g.node("Agency").select("agency_id", F.col("name").alias("agency")), "agency_id")
    manages = G.manages_edges(t, top_funds.select(_ords("agency_id", 4)).distinct())
    x = hop(x, "agency_id", manages, g.node("Program"), "program_id", target_cols={"name": "program"})
    awards = G.awards_edges(t, manages.select(_ords("dst", 4)).distinct())
    x = hop(x, "program_id", awards, g.node("Vendor"), "vendor_id", target_cols={"name": "vendor"})
    out = x.select("fund_source", "category", "agency", "program", "vendor", "amount")
    return top_k(out, k, [F.desc("amount"), "fund_source", "category", "agency", "program", "vendor"])


def h5_subcontract_pairs(t: Tables, k: int = 25) -> DataFrame:
    g = G.grants_graph(t)
    v = g.node("Vendor")
    e = g.rel("SUBCONTRACTS")
    x = (e.join(v.select(F.col("vendor_id").alias("src"), F.col("name").alias("prime_vendor"),
                         F.col("state").alias("prime_state")), "src")
         .join(v.select(F.col("vendor_id").alias("dst"), F.col("name").alias("subcontractor"),
                        F.col("state").alias("sub_state")), "dst"))
    out = x.select("prime_vendor", "subcontractor", F.col("percentage").alias("subcontract_pct"), "prime_state",
                   "sub_state")
    return top_k(out, k, [F.desc("subcontract_pct"), "prime_vendor", "subcontractor", "prime_state", "sub_state"])


def h32_subcontract_closure(t: Tables, prime: str | None = None, max_depth: int | None = None) -> DataFrame:
    """Every vendor reachable from one prime vendor over SUBCONTRACTS, with its shortest depth (any, unless limited).

    Without ``prime`` the vendor with the most subcontracts (lowest id on ties) is traced.
    """
    g = G.grants_graph(t)
    e = g.rel("SUBCONTRACTS")
    if prime is None:
        start = (e.groupBy(F.col("src").alias("vendor_id")).agg(F.count("*").alias("_n"))
                 .orderBy(F.desc("_n"), "vendor_id").limit(1).select("vendor_id"))
    else:
        start = g.node("Vendor").filter(F.col("vendor_id") == prime).select("vendor_id")
    r = reachable(start, "vendor_id", e, max_depth)
    return r.select(F.col("start").alias("prime_vendor"), F.col("node").alias("vendor_id"), "depth")


# ------------------------------------------------------------ citizen services
def h6_requests_by_priority(t: Tables) -> DataFrame:
    g = G.citizen_graph(t)
    sr = g.node("ServiceRequest").select("request_id", "priority", "type")
    x = hop(sr, "request_id", g.rel("SUBMITTED"), direction="in", out_key="citizen_id")
    return (x.groupBy("priority")
            .agg(F.count("*").alias("requests"),
                 F.array_join(F.slice(F.array_sort(F.collect_set("type")), 1, 5), ",").alias("sample_types"))
            .orderBy(F.desc("requests"), "priority"))


def h7_at_risk_assets(t: Tables, k: int = 20) -> DataFrame:
    g = G.citizen_graph(t)
    a = g.node("Asset").filter(F.col("condition").isin("poor", "critical")).select(
        F.col("asset_id"), F.col("type").alias("asset_type"), "condition")
    a = hop(a, "asset_id", g.rel("IN_DISTRICT"), g.node("District"), "district_id", target_cols={"name": "district"})
    x = hop(a, "asset_id", g.rel("AFFECTS"), direction="in", out_key="request_id")
    out = (x.groupBy(F.col("asset_id").alias("asset"), "asset_type", "condition", "district")
           .agg(F.count("*").alias("open_requests")))
    return top_k(out, k, [F.desc("open_requests"), "asset", "asset_type", "condition", "district"])


# ---------------------------------------------------------------- early warning
def _at_risk_students(g: Graph, cond) -> DataFrame:
    s = g.node("K12Student").filter(cond)
    return hop(s, "student_id", g.rel("ATTENDS"), g.node("School"), "school_id", target_cols={"name": "school"},
               out_key="school_key")


def _collect_interventions(g: Graph, x: DataFrame, cols: list[str]) -> DataFrame:
    opt = hop(x.select("student_id").distinct(), "student_id", g.rel("RECEIVED"), g.node("Intervention"),
              "intervention_id", target_cols={"type": "itype"}, optional=True)
    agg = opt.groupBy("student_id").agg(F.array_join(F.array_sort(F.collect_list("itype")), ",").alias("interventions"))
    return x.select(*cols).join(agg, "student_id")


def h8_at_risk_students(t: Tables, k: int = 25) -> DataFrame:
    g = G.early_warning_graph(t)
    x = _at_risk_students(g, F.col("risk_score") > 70)
    cols = ["student_id", "grade_level", "risk_score", "attendance_rate", "gpa", "school"]
    out = _collect_interventions(g, x, cols).select(
        F.col("student_id").alias("student"), F.col("grade_level").alias("grade"),
        F.col("risk_score").cast("double").alias("risk_score"),
        F.col("attendance_rate").cast("double").alias("attendance"), F.col("gpa").cast("double").alias("gpa"),
        "school", "interventions")
    return top_k(out, k, [F.desc("risk_score"), "student"])


def h21_low_attendance(t: Tables) -> DataFrame:
    g = G.early_warning_graph(t)
    x = _at_risk_students(g, (F.col("attendance_rate") < 80) & (F.col("behavior_incidents_ytd") > 5))
    out = _collect_interventions(g, x, ["student_id", "name", "attendance_rate", "gpa", "school"])
    return out.select("student_id", "name", F.col("attendance_rate").cast("double").alias("attendance_rate"),
                      F.col("gpa").cast("double").alias("gpa"), "school", "interventions").orderBy(
        "attendance_rate", "student_id")


def h9_school_risk_ranking(t: Tables, k: int = 15) -> DataFrame:
    g = G.early_warning_graph(t)
    s = g.node("K12Student").select("student_id", "risk_score", "attendance_rate")
    x = hop(s, "student_id", g.rel("ATTENDS"), g.node("School"), "school_id",
            target_cols={"name": "school", "type": "school_type", "title_i": "title_i"})
    out = (x.groupBy("school", "school_type", "title_i")
           .agg(_r(F.avg(F.col("risk_score").cast("double")), 1).alias("avg_risk"),
                _r(F.avg(F.col("attendance_rate").cast("double")), 1).alias("avg_attendance"),
                F.count("*").alias("student_count")))
    return top_k(out, k, [F.desc("avg_risk"), "school", "school_type", "title_i"])


# ------------------------------------------------------------------ procurement
def h10_top_vendors(t: Tables, k: int = 20) -> DataFrame:
    g = G.procurement_graph(t)
    ct = g.node("Contract").select("contract_id", "amount")
    x = hop(ct, "contract_id", g.rel("ISSUED"), direction="in", out_key="agency_id")
    x = hop(x, "contract_id", g.rel("AWARDED_TO"), g.node("ProcVendor"), "vendor_id",
            target_cols={"name": "vendor", "minority_owned": "mbe", "small_business": "sbe"})
    out = (x.groupBy("vendor", "mbe", "sbe")
           .agg(F.count("*").alias("contracts"), F.round(F.sum(F.col("amount").cast("double")), 0).alias("total_value")))
    return top_k(out, k, [F.desc("total_value"), "vendor", "mbe", "sbe"])


def h11_lobbyist_trail(t: Tables, k: int = 20) -> DataFrame:
    g = G.procurement_graph(t)
    lb = g.node("Lobbyist").select("lobbyist_id", F.col("name").alias("lobbyist"), "firm")
    x = hop(lb, "lobbyist_id", g.rel("REPRESENTS"), g.node("ProcVendor"), "vendor_id",
            target_cols={"name": "vendor"})
    x = hop(x, "vendor_id", g.rel("AWARDED_TO"), g.node("Contract"), "contract_id", direction="in",
            target_cols={"amount": "contract_value", "method": "procurement_method"})
    x = hop(x, "contract_id", g.rel("ISSUED"), g.node("ProcAgency"), "agency_id", direction="in",
            target_cols={"name": "agency"})
    out = x.select("lobbyist", "firm", "vendor", "agency", F.col("contract_value").cast("double").alias("contract_value"),
                   "procurement_method")
    return top_k(out, k, [F.desc("contract_value"), "lobbyist", "firm", "vendor", "agency", "procurement_method"])


# ---------------------------------------------------------------- benefit cases
def h12_multi_program_clients(t: Tables, k: int = 20) -> DataFrame:
    g = G.benefits_graph(t)
    x = g.rel("HAS_CASE").select(F.col("src").alias("client_id"), F.col("dst").alias("case_id"))
    x = hop(x, "case_id", g.rel("ENROLLED_IN", "Case"), g.node("HHSProgram"), "program_id",
            target_cols={"name": "program"})
    per = (x.groupBy("client_id").agg(F.array_sort(F.collect_set("program")).alias("programs"),
                                      F.count_distinct("case_id").alias("cases"))
           .filter(F.size("programs") > 1))
    cl = g.node("Client").select("client_id", F.col("income_bracket").alias("income"), "household_size")
    out = per.join(cl, "client_id").select(F.col("client_id").alias("client"), "income", "household_size", "cases",
                                           F.size("programs").alias("n_programs"),
                                           F.array_join("programs", ",").alias("programs"))
    return top_k(out, k, [F.desc("n_programs"), "client"])


def h13_caseload(t: Tables, k: int = 20) -> DataFrame:
    g = G.benefits_graph(t)
    cs = g.node("Case").select("case_id", "benefit_amount")
    x = hop(cs, "case_id", g.rel("MANAGED_BY"), g.node("Caseworker"), "caseworker_id",
            target_cols={"name": "caseworker", "specialization": "specialization"})
    x = hop(x, "caseworker_id", g.rel("WORKS_AT"), g.node("HHSAgency"), "agency_id", target_cols={"name": "agency"})
    out = (x.groupBy("caseworker", "specialization", "agency")
           .agg(F.count("*").alias("active_cases"),
                _r(F.avg(F.col("benefit_amount").cast("double")), 2).alias("avg_benefit")))
    return top_k(out, k, [F.desc("active_cases"), "caseworker", "specialization", "agency"])


def h33_caseworker_communities(t: Tables) -> DataFrame:
    """Caseworkers linked through shared clients: components of the client-caseworker graph.

    The bipartite graph (client -- case -- caseworker collapsed to client --
    caseworker) is labelled with min-label propagation, so no caseworker pairs
    are ever enumerated; components are reported with their caseworker count.
    """
    g = G.benefits_graph(t)
    cw = hop(g.rel("HAS_CASE").select(F.col("src").alias("client_id"), F.col("dst").alias("case_id")), "case_id",
             g.rel("MANAGED_BY"), out_key="caseworker_id")
    e = cw.select(F.col("client_id").alias("src"), F.col("caseworker_id").alias("dst")).distinct()
    lab = connected_components(e)
    workers = lab.filter(F.col("node").startswith("CW-"))
    return (workers.groupBy("component").agg(F.count("*").alias("caseworkers"))
            .groupBy("caseworkers").agg(F.count("*").alias("communities")).orderBy("caseworkers"))


def h33_caseworker_modularity(t: Tables, rounds: int = 8) -> DataFrame:
    """Communities of caseworkers who share clients, by local moves that raise modularity, with their size and share."""
    g = G.benefits_graph(t)
    cw = hop(g.rel("HAS_CASE").select(F.col("src").alias("client_id"), F.col("dst").alias("case_id")), "case_id",
             g.rel("MANAGED_BY"), out_key="caseworker_id")
    links, names = co_membership(cw, "client_id", "caseworker_id", numbered=True)
    links = settled(links, "links")
    out = modularity(links, communities(links, rounds, names=names))
    return out.join(names.select(F.col("node").alias("community"), "name"), "community").select(F.col("name").alias("community"), *out.columns[1:]).orderBy("community")


# ----------------------------------------------------------------- H14 / H22
def h14_label_counts(t: Tables) -> DataFrame:
    parts = []
    for name, build in G.GRAPHS.items():
        parts.append(build(t).label_counts().withColumn("graph", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("count"), "graph", "label")


def h14_type_counts(t: Tables) -> DataFrame:
    parts = []
    for name, build in G.GRAPHS.items():
        parts.append(build(t).type_counts().withColumn("graph", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("count"), "graph", "relationship_type")


def h22_any_pattern_sample(t: Tables) -> DataFrame:
    return G.procurement_graph(t).pattern_sample(100)


# ------------------------------------------------------------------ user graphs
def h15_office_headcount(t: Tables) -> DataFrame:
    g = U.build_graph(t, U.ORG_CHART)
    e = g.node("Employee").select("_ord", "department")
    x = hop(e, "_ord", g.rel("WORKS_IN"), g.node("Office"), "_ord", target_cols={"city": "office"}, out_key="_off")
    return (x.groupBy("office").agg(F.count("*").alias("employees"),
                                    F.array_join(F.array_sort(F.collect_set("department")), ",").alias("departments"))
            .orderBy(F.desc("employees"), "office"))


def h16_reporting_chains(t: Tables, k: int = 20) -> DataFrame:
    g = U.build_graph(t, U.ORG_CHART)
    emp = g.node("Employee")
    p = var_length_paths(emp.select("_ord"), "_ord", g.rel("REPORTS_TO"), 1, 4)
    a = emp.select(F.col("_ord").alias("start"), F.col("name").alias("employee"), F.col("title"))
    b = emp.select(F.col("_ord").alias("end"), F.col("name").alias("reports_to"), F.col("title").alias("manager_title"))
    out = p.join(a, "start").join(b, "end").select("employee", "title", F.col("depth").alias("chain_depth"),
                                                   "reports_to", "manager_title", F.col("start").alias("emp_ord"))
    return top_k(out, k, [F.desc("chain_depth"), "emp_ord", "reports_to"]).drop("emp_ord")


def h17_project_staffing(t: Tables) -> DataFrame:
    g = U.build_graph(t, U.ORG_CHART)
    a = g.rel("ASSIGNED_TO")
    pr = g.node("Project").select(F.col("_ord").alias("dst"), F.col("name").alias("project"), "status", "budget")
    x = a.join(pr, "dst")
    return (x.groupBy("project", "status", "budget")
            .agg(F.count("*").alias("team_size"),
                 F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
            .orderBy(F.desc("team_size"), "project", "budget"))


def h18_supply_chain(t: Tables, k: int = 25) -> DataFrame:
    g = U.build_graph(t, U.SUPPLY_CHAIN)
    s = g.node("Supplier").select("_ord", F.col("name").alias("supplier"), "country",
                                  F.col("reliability_score").alias("reliability"))
    x = hop(s, "_ord", g.rel("SUPPLIES"), g.node("Product"), "_ord", edge_props={"contract_price": "price"},
            target_cols={"sku": "sku", "category": "category"}, out_key="_p")
    x = hop(x, "_p", g.rel("STORED_IN"), g.node("Warehouse"), "_ord", edge_props={"quantity": "stock"},
            target_cols={"location": "warehouse"}, out_key="_w")
    out = x.select("supplier", "country", "reliability", "sku", "category", "price", "warehouse", "stock")
    return top_k(out, k, [F.desc("stock"), "sku", "supplier", "warehouse", "price"])


def h19_employee_export(t: Tables) -> DataFrame:
    g = U.build_graph(t, U.ORG_CHART)
    e = g.node("Employee")
    x = hop(e, "_ord", g.rel("WORKS_IN"), g.node("Office"), "_ord", target_cols={"city": "office_city"},
            optional=True, out_key="_off")
    return x.select("emp_id", "name", "department", "title", "salary", "hire_date", "remote", "office_city")


# ---------------------------------------------------------------------- exports
def h23_export_enrolment(t: Tables) -> DataFrame:
    g = G.enrolment_graph(t)
    s = g.node("Student").select("student_id", F.col("name").alias("student_name"), "gpa", "campus", "status")
    x = hop(s, "student_id", g.rel("ENROLLED_IN"), g.node("Course"), "course_id",
            target_cols={"name": "course_name", "level": "course_level", "credits": "credits"})
    return hop(x, "course_id", g.rel("OFFERED_BY", "Course"), g.node("Department"), "department_id",
               target_cols={"name": "department", "college": "college"}).drop("department_id")


def h24_export_degree_pathways(t: Tables) -> DataFrame:
    g = G.enrolment_graph(t)
    s = g.node("Student").select("student_id", F.col("name").alias("student_name"))
    x = hop(s, "student_id", g.rel("PURSUING"), g.node("DegreeProgram"), "program_id",
            edge_props={"start_semester": "start_semester", "expected_graduation": "expected_graduation"},
            target_cols={"name": "program_name", "degree_type": "degree_type"})
    return hop(x, "program_id", g.rel("OFFERED_BY", "DegreeProgram"), g.node("Department"), "department_id",
               target_cols={"name": "department"}).drop("department_id")


def h25_export_fund_flows(t: Tables) -> DataFrame:
    g = G.grants_graph(t)
    f = g.node("FundingSource").select("fund_id", F.col("name").alias("fund_name"), F.col("category").alias("fund_category"),
                                       "total_budget")
    x = hop(f, "fund_id", g.rel("FUNDS"), g.node("Agency"), "agency_id", edge_props={"amount": "funded_amount"},
            target_cols={"name": "agency_name", "type": "agency_type"})
    return hop(x, "agency_id", g.rel("MANAGES"), g.node("Program"), "program_id",
               target_cols={"name": "program_name", "budget_allocated": "program_budget"})


def h26_export_vendor_subcontracts(t: Tables) -> DataFrame:
    g = G.grants_graph(t)
    v = g.node("Vendor")
    prime = v.select(F.col("vendor_id").alias("prime_vendor_id"), F.col("name").alias("prime_vendor"), F.col("state").alias("prime_state"))
    return hop(prime, "prime_vendor_id", g.rel("SUBCONTRACTS"), v, "vendor_id", edge_props={"percentage": "subcontract_pct"},
               target_cols={"name": "subcontractor", "state": "sub_state"}, out_key="sub_vendor_id")


def h27_export_citizen_services(t: Tables) -> DataFrame:
    """citizen x request x department? x (asset, district)?: the 2-hop optional part is joined first, as one unit."""
    g = G.citizen_graph(t)
    c = g.node("Citizen").select("citizen_id", F.col("name").alias("citizen_name"))
    x = hop(c, "citizen_id", g.rel("SUBMITTED"), g.node("ServiceRequest"), "request_id",
            target_cols={"type": "request_type", "status": "status", "priority": "priority"})
    x = hop(x, "request_id", g.rel("ASSIGNED_TO"), g.node("ServiceDepartment"), "dept_id",
            target_cols={"name": "department"}, optional=True).drop("dept_id")
    ad = hop(g.rel("AFFECTS").select(F.col("src").alias("_req"), F.col("dst").alias("asset_id")), "asset_id",
             g.rel("IN_DISTRICT"), g.node("District"), "district_id", target_cols={"name": "district"}).drop("district_id")
    ad = ad.join(g.node("Asset").select("asset_id", F.col("type").alias("asset_type"),
                                        F.col("condition").alias("asset_condition")), "asset_id")
    return x.join(ad, x["request_id"] == ad["_req"], "left").drop("_req")


def h28_export_early_warning(t: Tables) -> DataFrame:
    g = G.early_warning_graph(t)
    s = g.node("K12Student").select("student_id", F.col("name").alias("student_name"), "grade_level", "risk_score",
                                    "attendance_rate", "gpa", F.col("free_reduced_lunch").alias("frl"),
                                    F.col("english_learner").alias("ell"), F.col("special_education").alias("sped"))
    x = hop(s, "student_id", g.rel("ATTENDS"), g.node("School"), "school_id",
            target_cols={"name": "school_name", "type": "school_type", "title_i": "title_i"})
    return hop(x, "student_id", g.rel("RECEIVED"), g.node("Intervention"), "intervention_id",
               target_cols={"type": "intervention_type", "status": "intervention_status", "effectiveness": "effectiveness"},
               optional=True)


def h29_export_procurement(t: Tables) -> DataFrame:
    """agency x contract x vendor x lobbyist?: one row per (contract, lobbyist); sums over it double count (kept grain)."""
    g = G.procurement_graph(t)
    a = g.node("ProcAgency").select("agency_id", F.col("name").alias("agency_name"))
    x = hop(a, "agency_id", g.rel("ISSUED"), g.node("Contract"), "contract_id",
            target_cols={"title": "contract_title", "amount": "amount", "method": "procurement_method",
                         "category": "category", "status": "contract_status"})
    x = hop(x, "contract_id", g.rel("AWARDED_TO"), g.node("ProcVendor"), "vendor_id",
            target_cols={"name": "vendor_name", "minority_owned": "mbe", "small_business": "sbe", "woman_owned": "wbe"})
    return hop(x, "vendor_id", g.rel("REPRESENTS"), g.node("Lobbyist"), "lobbyist_id", direction="in",
               target_cols={"name": "lobbyist_name", "firm": "lobbyist_firm"}, optional=True).drop("lobbyist_id")


def h30_export_case_management(t: Tables) -> DataFrame:
    g = G.benefits_graph(t)
    c = g.node("Client").select("client_id", F.col("name").alias("client_name"), "income_bracket", "household_size")
    x = hop(c, "client_id", g.rel("HAS_CASE"), g.node("Case"), "case_id",
            target_cols={"status": "case_status", "priority": "priority", "determination": "determination",
                         "benefit_amount": "benefit_amount"})
    x = hop(x, "case_id", g.rel("MANAGED_BY"), g.node("Caseworker"), "caseworker_id",
            target_cols={"name": "caseworker_name", "specialization": "specialization"})
    x = hop(x, "caseworker_id", g.rel("WORKS_AT"), g.node("HHSAgency"), "agency_id",
            target_cols={"name": "agency_name"}).drop("agency_id")
    return hop(x, "case_id", g.rel("ENROLLED_IN", "Case"), g.node("HHSProgram"), "program_id",
               target_cols={"name": "program_name"}, optional=True).drop("program_id")


def f17_edge_properties(t: Tables) -> DataFrame:
    """rows, distinct values, least and greatest value of the properties of six relationships that are drawn per edge
    or taken from one end."""
    c, k, p = G.citizen_graph(t), G.early_warning_graph(t), G.procurement_graph(t)
    wanted = [(c, "SUBMITTED", "channel"), (k, "ATTENDS", "enrollment_date"), (p, "ISSUED", "fiscal_year"), (p, "AWARDED_TO", "award_date"),
              (p, "AWARDED_TO", "bid_count"), (p, "SUBCONTRACTS_TO", "scope"), (p, "REPRESENTS", "since")]
    parts = [g.rel(rel).agg(F.count(x).alias("n"), F.count_distinct(x).alias("values"), F.min(x).cast("string").alias("least"), F.max(x).cast("string").alias("greatest"))
             .select(F.lit(rel).alias("relationship_type"), F.lit(x).alias("property"), "*") for g, rel, x in wanted]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
