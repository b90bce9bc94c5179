"""Edge builders and graph operators: distinctness, caps, rates, acyclicity, paths, components."""

from pyspark.sql import functions as F

from tidewell.operators import edges as E
from tidewell.operators.graph import Graph, connected_components, hop, var_length_paths
from tidewell.plans import graphs as G
from tidewell.sources.fixtures import Tables

from .conftest import SF_SMALL


def test_bernoulli_rate_and_no_self_pairs(spark):
    src = spark.range(400).select(F.col("id").alias("k"), F.col("id").alias("me"))
    e = E.bernoulli_edges(src, "k", 500, 0.05, 7, "T", exclude_self_ordinal="me")
    n = e.count()
    mean, sd = 400 * 500 * 0.05, (400 * 500 * 0.05 * 0.95) ** 0.5
    assert abs(n - mean) < 5 * sd
    assert e.filter(F.col("src") == F.col("dst_ord")).count() == 0
    assert e.select("src", "dst_ord").distinct().count() == n
    assert e.filter((F.col("dst_ord") < 0) | (F.col("dst_ord") >= 500)).count() == 0


def test_bernoulli_p_one_is_all_pairs_and_cap(spark):
    src = spark.range(5).select(F.col("id").alias("k"))
    assert E.bernoulli_edges(src, "k", 7, 1.0, 1, "ALL").count() == 35
    capped = E.bernoulli_edges(src, "k", 1000, 0.5, 1, "CAP", max_per_source=3)
    per = capped.groupBy("src").count().collect()
    assert all(r["count"] == 3 for r in per) and len(per) == 5


def test_distinct_pairs(spark):
    idx = spark.range(1000).select(F.col("id").alias("i"))
    p = E.distinct_pairs(idx, "i", 30, 50, 3, "P")
    assert p.count() == 1000 == p.distinct().count()
    assert p.filter((F.col("a_ord") >= 30) | (F.col("b_ord") >= 50)).count() == 0
    # more indexes than pairs: every pair exactly once
    assert E.distinct_pairs(idx, "i", 3, 4, 3, "P").distinct().count() == 12


def test_k_targets_distinct_and_capped(spark):
    src = spark.range(200).select(F.col("id").alias("k"))
    e = E.k_targets(src, "k", 4, 2, 9, 5, "K")
    per = e.groupBy("src").agg(F.count("*").alias("n"), F.count_distinct("dst_ord").alias("d")).collect()
    assert all(r["n"] == r["d"] and 2 <= r["n"] <= 4 for r in per)


def test_lower_parent_is_acyclic(spark):
    nodes = spark.range(300).select(F.col("id").alias("key"), (F.col("id") % 5 * 100 + 100).alias("level"))
    e = E.lower_parent(nodes, "key", "level", 1.0, 200, 1, "REQ")
    j = e.join(nodes.select(F.col("key").alias("src"), F.col("level").alias("ls")), "src").join(
        nodes.select(F.col("key").alias("dst"), F.col("level").alias("ld")), "dst")
    assert j.filter(F.col("ld") >= F.col("ls")).count() == 0
    assert e.count() == nodes.filter(F.col("level") >= 200).count()


def test_var_length_paths_edge_unique_on_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    starts = spark.createDataFrame([(1,)], "k long")
    p = var_length_paths(starts, "k", edges, 1, 6)
    depths = sorted(r["depth"] for r in p.collect())
    assert depths == [1, 2, 3]  # the cycle closes once; no edge is reused


def test_connected_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 20)], "src long, dst long")
    comp = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[10] == comp[11] == 10


def test_optional_hop_keeps_unmatched(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    e = spark.createDataFrame([(1, 9)], "src long, dst long")
    tgt = spark.createDataFrame([(9, "x")], "id long, name string")
    out = hop(left, "k", e, tgt, "id", optional=True, target_cols={"name": "name"}).collect()
    assert sorted((r["k"], r["name"]) for r in out) == [(1, "x"), (2, None)]


def test_graph_stats_and_clear(spark):
    t = Tables(spark, SF_SMALL)
    g = G.procurement_graph(t)
    labels = {r["label"]: r["count"] for r in g.label_counts().collect()}
    assert labels["Contract"] == t.part.count()
    g2 = g.without_label("Lobbyist")
    assert "Lobbyist" not in g2.nodes and not any("Lobbyist" in k for k in g2.edges)
    assert isinstance(g2, Graph)


def test_plans_have_no_cartesian_or_python(spark):
    t = Tables(spark, SF_SMALL)
    from tidewell.plans import graph_queries as GQ
    for fn in [GQ.h1_department_enrolment, GQ.h4_funding_trace, GQ.h12_multi_program_clients]:
        plan = fn(t)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


def test_long_chain_is_one_component(spark):
    edges = spark.range(130).selectExpr("id + 1 AS src", "id AS dst")
    comp = connected_components(edges).collect()
    assert len(comp) == 131 and {r["component"] for r in comp} == {0}


def test_long_chain_is_reached_to_its_end(spark):
    from tidewell.operators.graph import reachable
    edges = spark.range(40).selectExpr("id AS src", "id + 1 AS dst")
    got = {r["node"]: r["depth"] for r in reachable(spark.createDataFrame([(0,)], "k long"), "k", edges).collect()}
    assert got == {i: i for i in range(1, 41)}


def test_pairs_reach_all_sources_of_a_large_table(spark):
    p = E.distinct_pairs(spark.range(100_000), "id", 15_000_000_000, 150_000_000_000, 3, "P")
    r = p.selectExpr("count(DISTINCT struct(a_ord, b_ord)) AS n", "count(DISTINCT floor(a_ord / 150000000)) AS a",
                     "count(DISTINCT floor(b_ord / 1500000000)) AS b").first()
    assert r["n"] == 100_000 and r["a"] == 100 and r["b"] == 100
    degree = E.distinct_pairs(spark.range(3000), "id", 1000, 3000, 3, "Q").groupBy("a_ord").count().selectExpr("max(count) AS m", "count(*) AS n").first()
    assert degree["m"] >= 7 and 900 <= degree["n"] < 1000  # as many as uniform draws reach, not one each


def test_targets_are_not_neighbours(spark):
    e = E.k_targets(spark.range(500), "id", 10_000, 4, 4, 5, "K").orderBy("src", "j").collect()
    near = sum(abs(a["dst_ord"] - b["dst_ord"]) <= 2 for a, b in zip(e, e[1:]) if a["src"] == b["src"])
    assert len(e) == 2000 and near < 30
    assert len({r["dst_ord"] // 1000 for r in e}) == 10


def test_cap_and_no_self_pairs_together(spark):
    src = spark.range(300).selectExpr("id AS k", "id AS me")
    e = E.bernoulli_edges(src, "k", 300, 0.2, 1, "R", exclude_self_ordinal="me", max_per_source=1).collect()
    assert all(r["src"] != r["dst_ord"] for r in e) and len({r["src"] for r in e}) == len(e) >= 299


def test_edges_grow_with_the_sources(spark):
    n = [E.bernoulli_edges(spark.range(s), "id", s, 0.05, 1, "G").count() for s in (2000, 8000)]
    assert 0.9 * 200_000 < n[0] < 1.1 * 200_000 and 3.8 < n[1] / n[0] < 4.2


def test_clear_counts_what_it_removes(spark):
    from tidewell.operators.graph import clear_label
    t = Tables(spark, SF_SMALL)
    g = G.procurement_graph(t)
    g2, gone = clear_label(g, "Lobbyist")
    assert gone["deleted_nodes"] == t.supplier.count() and gone["deleted_edges"] == g.rel("REPRESENTS").count()
    assert "Lobbyist" not in g2.nodes
    assert clear_label(g2, "Lobbyist")[1] == {"deleted_nodes": 0, "deleted_edges": 0}


def test_nodes_have_all_their_properties(spark):
    t = Tables(spark, SF_SMALL)
    want = {
        "enrolment_graph": {"Department": "building faculty_count college", "Course": "max_enrollment credits", "DegreeProgram": "accredited total_credits"},
        "grants_graph": {"FundingSource": "cfda_number total_budget", "Agency": "jurisdiction employee_count type", "Program": "budget_allocated start_date status",
                         "Vendor": "duns_number state", "LineItem": "account_code description fiscal_quarter amount"},
        "citizen_graph": {"District": "council_member population area_sq_miles", "ServiceDepartment": "staff_count avg_response_hours",
                          "Asset": "last_inspection latitude longitude condition", "Citizen": "email phone registered_date",
                          "ServiceRequest": "description resolved_date latitude longitude created_date"},
        "early_warning_graph": {"School": "graduation_rate principal title_i", "Teacher": "years_experience certification", "RiskIndicator": "severity_weight",
                                "K12Student": "free_reduced_lunch english_learner special_education gifted", "Intervention": "start_date end_date notes effectiveness"},
        "procurement_graph": {"ProcAgency": "annual_procurement_budget procurement_officer state",
                              "ProcVendor": "specialty woman_owned local_vendor years_in_business bonded annual_revenue",
                              "Contract": "title start_date end_date duration_months payment_terms", "Lobbyist": "firm registration_date specialization total_compensation"},
        "benefits_graph": {"HHSAgency": "county case_load annual_budget", "HHSProgram": "federal_funded max_benefit eligibility_criteria",
                           "Caseworker": "caseload years_experience license", "Client": "dob zip_code primary_language veteran disabled",
                           "Case": "opened_date closed_date referral_source review_date"},
    }
    for graph, labels in want.items():
        g = getattr(G, graph)(t)
        for label, names in labels.items():
            assert set(names.split()) <= set(g.node(label).columns), label
            row = g.node(label).select(*names.split()).agg(*(F.count(c).alias(c) for c in names.split())).first()
            assert all(row[c] > 0 for c in names.split()), (label, row)


def test_edges_carry_the_values_of_their_case(spark):
    g = G.benefits_graph(Tables(spark, SF_SMALL))
    case = g.node("Case").select("case_id", "opened_date", "benefit_amount")
    for rel, key, col in (("MANAGED_BY", "src", "assigned_date"), ("HAS_CASE", "dst", "intake_date"), ("ENROLLED_IN", "src", "start_date")):
        e = g.rel(rel, "Case") if rel != "HAS_CASE" else g.rel(rel)
        j = e.join(case, e[key] == case["case_id"])
        assert j.count() == e.count() > 0 and j.filter(F.col(col) != F.col("opened_date")).count() == 0
    en = g.rel("ENROLLED_IN", "Case").join(case, F.col("src") == F.col("case_id"))
    assert en.filter(F.col("monthly_benefit") != F.col("benefit_amount")).count() == 0
