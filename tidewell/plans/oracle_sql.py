"""DuckDB SQL for each registered query (the independent oracle).

The fixture tables are views named after the tables. Generated attributes
are recomputed here from the same portable hash recipe, written in DuckDB
syntax: ``u(seed, name, key) = ('0x' || substr(md5(seed:name:key), 1, 13))::BIGINT / 2**52``.
"""

from __future__ import annotations

SEED = 42


# --- DuckDB text helpers for the hash recipe ---------------------------------
def du(name: str, key: str, seed=SEED) -> str:
    return (f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{name}', CAST({key} AS VARCHAR))), 1, 13))::BIGINT"
            f" / CAST(4503599627370496 AS DOUBLE))")


def dint(u: str, lo: int, hi: int) -> str:
    return f"CAST({lo} + floor({u} * {hi - lo + 1}) AS BIGINT)"


def dpick(u: str, values, weights=None) -> str:
    def q(v):
        return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
    if not weights:
        weights = [1] * len(values)
        # uniform pick = floor(u * n)
        arms = " ".join(f"WHEN floor({u} * {len(values)}) = {i} THEN {q(v)}" for i, v in enumerate(values[:-1]))
        return f"(CASE {arms} ELSE {q(values[-1])} END)"
    total = float(sum(weights))
    acc = 0.0
    arms = []
    for v, w in zip(values[:-1], weights[:-1]):
        acc += float(w)
        arms.append(f"WHEN {u} * {total!r} < {acc!r} THEN {q(v)}")
    return f"(CASE {' '.join(arms)} ELSE {q(values[-1])} END)"


def ddec(u: str, lo, hi, scale: int) -> str:
    """Decimal grid draw as DOUBLE-free DECIMAL value (exact)."""
    f = 10 ** scale
    lo_u, hi_u = round(lo * f), round(hi * f)
    return f"(CAST({dint(u, lo_u, hi_u)} AS DECIMAL(38,0)) / {f})::DECIMAL(38,{scale})"


ORACLE: dict[str, str] = {}

# --- §2.G relational analytics over the fixture tables ------------------------
ORACLE["g1_orders_per_priority"] = """
SELECT o_orderpriority, count(*) AS orders, count(DISTINCT o_custkey) AS unique_customers
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY o_orderpriority
"""

ORACLE["g2_customers_by_segment_nation"] = """
SELECT c_mktsegment, c_nationkey, count(*) AS customers, round(avg(c_acctbal), 4) AS avg_acctbal,
       round(max(c_acctbal), 4) AS max_acctbal
FROM customer GROUP BY c_mktsegment, c_nationkey ORDER BY customers DESC, c_mktsegment, c_nationkey
"""

ORACLE["g3_lineitem_by_status_year"] = """
SELECT l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS lineitems,
       round(sum(l_extendedprice), 2) AS total_price
FROM lineitem WHERE l_returnflag = 'R'
GROUP BY l_linestatus, year(l_shipdate) ORDER BY ship_year, total_price DESC
"""

ORACLE["g4_order_status_shares"] = """
SELECT o_orderpriority, count(*) AS orders,
       round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 4) AS pct_finished,
       round(avg(CAST(o_orderstatus = 'O' AS INTEGER)), 4) AS pct_open,
       round(avg(CAST(o_orderstatus = 'P' AS INTEGER)), 4) AS pct_partial,
       round(avg(o_totalprice), 2) AS avg_totalprice
FROM orders GROUP BY o_orderpriority ORDER BY orders DESC, o_orderpriority
"""

ORACLE["g5_null_skipping_avg"] = """
SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS events,
       round(avg(CASE WHEN event_type = 'purchase' THEN value END), 4) AS avg_purchase_value,
       round(avg(value), 4) AS avg_value
FROM events GROUP BY event_type, hour(ts) ORDER BY events DESC, event_type, hour
"""

ORACLE["g7_big_orders_by_segment"] = """
SELECT c_mktsegment, c_nationkey, count(*) AS big_orders, round(avg(o_totalprice), 2) AS avg_totalprice,
       round(avg(c_acctbal), 2) AS avg_acctbal
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_totalprice > 300000
GROUP BY c_mktsegment, c_nationkey ORDER BY big_orders DESC, c_mktsegment, c_nationkey
"""

ORACLE["g9_parts_by_brand_type"] = """
SELECT p_brand, p_type, count(*) AS parts, round(sum(p_retailprice), 2) AS total_value,
       round(avg(p_retailprice), 4) AS avg_value, round(avg(p_size), 4) AS avg_size
FROM part GROUP BY p_brand, p_type ORDER BY total_value DESC, p_brand, p_type
"""

ORACLE["g15_customer_activity"] = """
SELECT c_name, c_acctbal, c_mktsegment, sum(n) AS orders, round(sum(s) / sum(n), 2) AS avg_order_value
FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) a
JOIN customer ON o_custkey = c_custkey
GROUP BY c_name, c_acctbal, c_mktsegment
ORDER BY orders DESC, avg_order_value DESC, c_name, c_acctbal, c_mktsegment
LIMIT 20
"""

ORACLE["g16_risk_filter"] = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 450000
"""

ORACLE["g17_sum_across_statuses"] = """
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS statuses
FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus)
"""


# --- §2.D streams: DuckDB rendering of the column-spec semantics --------------
def dpad(x: str, width: int) -> str:
    s = f"CAST({x} AS VARCHAR)"
    return f"lpad({s}, CAST(greatest({width}, length({s})) AS INTEGER), '0')"


def dspec(c: dict, key: str, seed=SEED) -> str:
    """One spec column as DuckDB SQL (random picks, ranges, flags, id parts, nulls)."""
    name = c["name"]
    v = _dspec_value(c, key, seed)
    pn = c.get("percent_nulls")
    if pn:
        v = f"(CASE WHEN {du(name + '#null', key, seed)} >= {pn / 100.0!r} THEN {v} END)"
    return v


def dhash(name: str, key: str, seed=SEED) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{name}', CAST({key} AS VARCHAR))), 1, 15))::BIGINT)"


def _dspec_value(c: dict, key: str, seed=SEED) -> str:
    from ..functions import pools
    name, typ = c["name"], c.get("type", "string")
    lo = c.get("min", c.get("min_value"))
    hi = c.get("max", c.get("max_value"))
    rnd = c.get("random") or c.get("weights") is not None
    if c.get("person"):
        return (f"concat_ws(' ', {dpick(du(name + '#first', key, seed), pools.FIRST_NAMES)}, "
                f"{dpick(du(name + '#last', key, seed), pools.LAST_NAMES)})")
    if c.get("probability") is not None:
        return f"({du(name, key, seed)} < {float(c['probability'])!r})"
    if c.get("begin") is not None:
        from .datasets import _epoch_of
        lo_s, hi_s = _epoch_of(c["begin"]), _epoch_of(c.get("end") or c["begin"])
        steps = (hi_s - lo_s) // 86400
        ts = f"make_timestamp(CAST({lo_s} + {dint(du(name, key, seed), 0, steps)} * 86400 AS BIGINT) * 1000000)"
        return f"CAST({ts} AS DATE)" if typ == "date" else ts
    if c.get("parts") is not None:
        out = []
        for i, p in enumerate(c["parts"]):
            if isinstance(p, dict) and "col" in p:
                v = f"({p['col']} + {int(p.get('offset', 0))})"
                out.append(dpad(v, p["pad"]) if p.get("pad") else f"CAST({v} AS VARCHAR)")
            elif isinstance(p, dict) and "mod_table" in p:
                v = f"({dhash(f'{name}#{i}', key, seed)} % (SELECT count(*) FROM {p['mod_table']}) + {int(p.get('offset', 1))})"
                out.append(dpad(v, p["pad"]) if p.get("pad") else f"CAST({v} AS VARCHAR)")
            elif isinstance(p, dict):
                v = dint(du(f"{name}#{i}", key, seed), p["min"], p["max"])
                out.append(dpad(v, p["pad"]) if p.get("pad") else f"CAST({v} AS VARCHAR)")
            else:
                out.append("'" + str(p) + "'")
        return "concat(" + ", ".join(out) + ")"
    if c.get("values") is not None:
        return dpick(du(name, key, seed), c["values"], c.get("weights"))
    if lo is not None:
        if not rnd:
            return f"({int(lo)} + ({key}) % {int(hi) - int(lo) + 1})"
        if typ.startswith("decimal"):
            scale = int(typ.split(",")[1].rstrip(")"))
            return ddec(du(name, key, seed), lo, hi, scale)
        if typ in ("double", "float"):
            return f"({float(lo)!r} + {du(name, key, seed)} * {float(hi) - float(lo)!r})"
        return dint(du(name, key, seed), int(lo), int(hi))
    raise ValueError(f"no oracle form for {c}")


def _stream_oracle(stream: str) -> str:
    from .stream_queries import PROFILES
    from .streams import stream_spec
    group, measures = PROFILES[stream]
    cols = {c["name"]: c for c in stream_spec(stream)}
    needed = list(dict.fromkeys(group + [m[1] for m in measures]))
    sel = ", ".join(f"{dspec(cols[n], 'event_id')} AS {n}" for n in needed)
    aggs = []
    for kind, col in measures:
        if kind == "sum":
            aggs.append(f"CAST(CAST(sum({col}) AS DECIMAL(38,2)) AS DOUBLE) AS total_{col}")
        elif kind == "avg":
            aggs.append(f"round(avg(CAST({col} AS DOUBLE)), 4) AS avg_{col}")
        else:
            aggs.append(f"round(avg(CAST(CAST({col} AS INTEGER) AS DOUBLE)), 4) AS share_{col}")
    g = ", ".join(group)
    return (f"SELECT {g}, count(*) AS records, {', '.join(aggs)} FROM (SELECT {sel} FROM events) r "
            f"GROUP BY {g} ORDER BY records DESC, {g}")


def _add_stream_oracles():
    from .stream_queries import QUERY_NAMES
    for stream, qname in QUERY_NAMES.items():
        ORACLE[qname] = _stream_oracle(stream)


_add_stream_oracles()


# --- §2.E/G generated public-sector tables ------------------------------------
_HAND = {
    # Spark-SQL ``expr`` columns, re-expressed in DuckDB
    ("schools", "name"): None,
}


def dtable(table: str, cols: list[str], seed=SEED) -> str:
    """``(SELECT cols FROM source)`` regenerating the needed columns of a generated table."""
    from .datasets import SCHOOL_PREFIXES, SCHOOL_TYPES, SPECS
    src, key, spec = SPECS[table]
    by = {c["name"]: c for c in spec}
    tseed = f"{seed}/{table}"
    sel = []
    for n in cols:
        if (table, n) == ("schools", "name"):
            pre = "[" + ", ".join(f"'{p}'" for p in SCHOOL_PREFIXES) + "]"
            kind = dpick(du("_kind", key, tseed), SCHOOL_TYPES)
            sel.append(f"concat({pre}[{key} % {len(SCHOOL_PREFIXES)} + 1], ' ', upper(substr({kind}, 1, 1)) || "
                       f"substr({kind}, 2), ' School') AS name")
        else:
            sel.append(f"{dspec(by[n], key, tseed)} AS {n}")
    return f"(SELECT {', '.join(sel)} FROM {src})"


def _sum2(c):
    return f"CAST(CAST(sum({c}) AS DECIMAL(38,2)) AS DOUBLE)"


def _avg(c, n=4):
    return f"round(avg(CAST({c} AS DOUBLE)), {n})"


def _share(c):
    return f"round(avg(CAST(CAST({c} AS INTEGER) AS DOUBLE)), 4)"


def _add_generated_table_oracles():
    O = ORACLE
    O["gen_g1_enrolments_per_semester"] = (
        f"SELECT semester, count(*) AS enrollments, count(DISTINCT student_id) AS unique_students "
        f"FROM {dtable('enrollment_events', ['semester', 'student_id', 'action'])} e "
        f"WHERE action = 'enroll' GROUP BY semester ORDER BY semester")
    O["gen_g2_students_by_status_campus"] = (
        f"SELECT status, campus, count(*) AS students, {_avg('gpa')} AS avg_gpa, {_avg('total_credits')} AS avg_credits "
        f"FROM {dtable('students', ['status', 'campus', 'gpa', 'total_credits'])} s GROUP BY status, campus "
        f"ORDER BY students DESC, status, campus")
    O["gen_g3_expenditure_by_fund_year"] = (
        f"SELECT fund_category, fiscal_year, count(*) AS transactions, {_sum2('amount')} AS total_spent "
        f"FROM {dtable('budget_transactions', ['fund_category', 'fiscal_year', 'amount', 'transaction_type'])} b "
        f"WHERE transaction_type = 'expenditure' GROUP BY fund_category, fiscal_year "
        f"ORDER BY fiscal_year, total_spent DESC, fund_category")
    O["gen_g4_vendor_diversity"] = (
        f"SELECT type, count(*) AS vendors, {_share('minority_owned')} AS pct_minority, "
        f"{_share('small_business')} AS pct_small_biz, {_share('woman_owned')} AS pct_woman_owned, "
        f"{_avg('annual_revenue', 2)} AS avg_revenue "
        f"FROM {dtable('vendors', ['type', 'minority_owned', 'small_business', 'woman_owned', 'annual_revenue'])} v "
        f"GROUP BY type ORDER BY vendors DESC, type")
    O["gen_g5_request_resolution"] = (
        f"SELECT request_type, priority, count(*) AS requests, {_avg('response_time_hours')} AS avg_response_hours, "
        f"{_avg('satisfaction_rating')} AS avg_satisfaction "
        f"FROM {dtable('service_requests', ['request_type', 'priority', 'response_time_hours', 'satisfaction_rating'])} r "
        f"GROUP BY request_type, priority ORDER BY requests DESC, request_type, priority")
    O["gen_g6_asset_condition_by_district"] = (
        f"SELECT district, condition, count(*) AS assets, {_avg('replacement_cost', 2)} AS avg_replacement_cost "
        f"FROM {dtable('assets', ['district', 'condition', 'replacement_cost'])} a "
        f"GROUP BY district, condition ORDER BY district, condition")
    O["gen_g7_high_risk_by_school"] = (
        f"SELECT name, type, count(*) AS high_risk_students, {_avg('risk_score')} AS avg_risk_score, "
        f"{_avg('attendance_rate')} AS avg_attendance "
        f"FROM {dtable('k12_students', ['school_id', 'risk_score', 'attendance_rate'])} k "
        f"JOIN {dtable('schools', ['school_id', 'name', 'type'])} s USING (school_id) "
        f"WHERE risk_score > 70 GROUP BY name, type ORDER BY high_risk_students DESC, name, type")
    O["gen_g8_risk_by_grade"] = (
        f"SELECT grade_level, count(*) AS students, {_avg('risk_score')} AS avg_risk, {_avg('gpa')} AS avg_gpa, "
        f"{_share('free_reduced_lunch')} AS pct_frl, {_share('english_learner')} AS pct_ell, "
        f"{_share('special_education')} AS pct_sped "
        f"FROM {dtable('k12_students', ['grade_level', 'risk_score', 'gpa', 'free_reduced_lunch', 'english_learner', 'special_education'])} k "
        f"GROUP BY grade_level ORDER BY grade_level")
    O["gen_g9_contracts_by_category_method"] = (
        f"SELECT category, method, count(*) AS contracts, {_sum2('amount')} AS total_value, "
        f"{_avg('amount', 2)} AS avg_value, {_avg('duration_months')} AS avg_duration "
        f"FROM {dtable('contracts', ['category', 'method', 'amount', 'duration_months'])} c "
        f"GROUP BY category, method ORDER BY total_value DESC, category, method")
    O["gen_g10_benefits_by_program"] = (
        f"SELECT program, determination, count(*) AS cases, {_avg('benefit_amount', 2)} AS avg_benefit, "
        f"{_sum2('benefit_amount')} AS total_benefits "
        f"FROM {dtable('cases', ['program', 'determination', 'benefit_amount'])} c "
        f"GROUP BY program, determination ORDER BY total_benefits DESC, program, determination")
    O["gen_g11_client_demographics"] = (
        f"SELECT income_bracket, primary_language, count(*) AS clients, {_avg('household_size')} AS avg_household, "
        f"{_share('veteran')} AS pct_veteran, {_share('disabled')} AS pct_disabled "
        f"FROM {dtable('clients', ['income_bracket', 'primary_language', 'household_size', 'veteran', 'disabled'])} c "
        f"GROUP BY income_bracket, primary_language ORDER BY clients DESC, income_bracket, primary_language")
    from .datasets import DATASETS, SPECS
    parts = [f"SELECT '{uc}' AS use_case, '{tn}' AS table_name, (SELECT count(*) FROM {SPECS[tn][0]}) AS row_count"
             for uc, tabs in DATASETS.items() for tn in tabs]
    O["gen_g12_totals_per_table"] = " UNION ALL ".join(parts)
    O["gen_g15_student_activity"] = (
        f"SELECT name, CAST(gpa AS DOUBLE) AS gpa, campus, sum(n) AS events, round(sum(s) / sum(n), 4) AS avg_gpa_impact "
        f"FROM (SELECT student_id, count(*) AS n, sum(CAST(gpa_impact AS DOUBLE)) AS s "
        f"      FROM {dtable('enrollment_events', ['student_id', 'gpa_impact'])} e GROUP BY student_id) a "
        f"JOIN {dtable('students', ['student_id', 'name', 'gpa', 'campus'])} s USING (student_id) "
        f"GROUP BY name, gpa, campus ORDER BY events DESC, name, gpa, campus LIMIT 20")

    # E7 / E8 user tables (JSON rules)
    from .user_tables import FLEET_COLUMNS, SURVEY_COLUMNS
    sv = {c["name"]: c["generator_rule"] for c in SURVEY_COLUMNS}
    fl = {c["name"]: c["generator_rule"] for c in FLEET_COLUMNS}
    sseed, fseed = f"{SEED}/survey_responses", f"{SEED}/vehicle_events"
    O["gen_g13_survey_scores"] = (
        f"SELECT product, category, count(*) AS responses, {_avg('overall_score')} AS avg_score, "
        f"{_avg('nps_score')} AS avg_nps FROM (SELECT "
        + ", ".join(f"{drule(sv[n], n, 'event_id', sseed)} AS {n}" for n in
                    ["product", "category", "overall_score", "nps_score"])
        + " FROM events) GROUP BY product, category ORDER BY responses DESC, product, category")
    O["gen_g14_fleet_events"] = (
        f"SELECT vehicle_type, event_type, count(*) AS events, {_avg('speed_mph')} AS avg_speed, "
        f"{_avg('fuel_pct')} AS avg_fuel FROM (SELECT "
        + ", ".join(f"{drule(fl[n], n, 'o_orderkey', fseed)} AS {n}" for n in
                    ["vehicle_type", "event_type", "speed_mph"])
        + f", CAST({drule(fl['fuel_pct'], 'fuel_pct', 'o_orderkey', fseed)} AS DECIMAL(5,2)) AS fuel_pct"
        + " FROM orders) GROUP BY vehicle_type, event_type ORDER BY events DESC, vehicle_type, event_type")


def drule(rule: dict, name: str, key: str, seed) -> str:
    """A JSON generator rule as DuckDB SQL (choice, range_int, range_float, bool)."""
    g = rule.get("generator")
    u = du(name, key, seed)
    if g == "choice":
        return dpick(u, rule["values"], rule.get("weights"))
    if g == "range_int":
        return dint(u, int(rule.get("min", 0)), int(rule.get("max", 100)))
    if g == "range_float":
        lo, hi = float(rule.get("min", 0.0)), float(rule.get("max", 100.0))
        return f"round({lo!r} + {u} * {hi - lo!r}, {int(rule.get('precision', 2))})"
    if g == "bool":
        return f"({u} < {float(rule.get('probability', 0.5))!r})"
    raise ValueError(g)


_add_generated_table_oracles()


# --- §2.H graph queries over the generated graphs -------------------------------
def dk_targets(src_sql: str, src_key: str, rel: str, T: str, kmin: int, kmax: int, seed=SEED) -> str:
    """Edges of ``k_targets``: (src, j, dst_ord); draw j is below T - k + j, and gives way to T - k + j - 1 if taken."""
    k = dint(du(f"{rel}#k", src_key, seed), kmin, kmax) if kmax > kmin else str(kmin)
    draw = dhash(f"{rel}#draw", "CAST(src AS VARCHAR) || ':' || CAST(j AS VARCHAR)", seed)
    picks = (f"list_reduce(range(1, kk + 1), lambda a, j: list_append(a, CASE WHEN list_contains(a, {draw} % (tt - kk + j)) "
             f"THEN tt - kk + j - 1 ELSE {draw} % (tt - kk + j) END), CAST([] AS BIGINT[]))")
    return (f"(SELECT src, unnest(picks) AS dst_ord, generate_subscripts(picks, 1) AS j FROM (SELECT src, {picks} AS picks FROM "
            f"(SELECT {src_key} AS src, least({k}, {T}) AS kk, {T} AS tt FROM {src_sql}) s) p)")


def dlist(values, idx: str) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + f"][{idx} + 1]"


def _add_graph_oracles():
    from . import graphs as GR
    O = ORACLE
    npart = "(SELECT count(*) FROM part)"
    nnation = "(SELECT count(*) FROM nation)"
    nsupp = "(SELECT count(*) FROM supplier)"
    # H1: Student -ENROLLED_IN-> Course -OFFERED_BY-> Department
    enr = dk_targets("customer", "c_custkey", "ENROLLED_IN", npart, 2, 5)
    O["graph_h1_department_enrolment"] = (
        f"SELECT {dlist(GR.DEPARTMENTS, 'dst_ord % 18')} AS department, count(DISTINCT src) AS students, "
        f"count(*) AS enrollments FROM {enr} e GROUP BY 1 ORDER BY students DESC, department")
    # Average GPA of the distinct students enrolled per department
    gpa = dspec(GR._rng("gpa", "decimal(3,2)", 1.5, 4.0), "c_custkey", f"{SEED}/Student")
    O["graph_h34_avg_gpa_by_department"] = (
        f"SELECT department, count(*) AS students, round(CAST(sum(gpa) AS DOUBLE) / count(*), 4) AS avg_gpa FROM "
        f"(SELECT DISTINCT src, {dlist(GR.DEPARTMENTS, 'dst_ord % 18')} AS department FROM {enr} e) d "
        f"JOIN (SELECT c_custkey, {gpa} AS gpa FROM customer) s ON s.c_custkey = d.src "
        f"GROUP BY department ORDER BY department")
    # Students sharing >= 3 courses with STU-000001 (ordinal 0)
    O["graph_h31_shared_courses"] = (
        f"WITH e AS (SELECT DISTINCT src, dst_ord FROM {enr} x) "
        f"SELECT concat('STU-', lpad(CAST(e.src + 1 AS VARCHAR), 6, '0')) AS student_id, "
        f"count(DISTINCT e.dst_ord) AS shared_courses FROM e JOIN (SELECT dst_ord FROM e WHERE src = 0) m "
        f"USING (dst_ord) WHERE e.src <> 0 GROUP BY e.src HAVING count(DISTINCT e.dst_ord) >= 3")
    # H3: Student -PURSUING-> DegreeProgram -OFFERED_BY-> Department
    pur = dk_targets("customer", "c_custkey", "PURSUING", "45", 1, 1)
    O["graph_h3_program_distribution"] = (
        f"SELECT {dlist(GR.DEGREE_TYPES, 'dst_ord % 10')} AS degree, {dlist(GR.DEPARTMENTS, 'dst_ord % 18')} AS department, "
        f"count(*) AS students, round(avg(CAST(gpa AS DOUBLE)), 2) AS avg_gpa "
        f"FROM {pur} p JOIN (SELECT c_custkey, {gpa} AS gpa FROM customer) s ON s.c_custkey = p.src "
        f"GROUP BY 1, 2 ORDER BY students DESC, degree, department, avg_gpa LIMIT 20")
    # early-warning nodes
    ks = f"{SEED}/K12Student"
    risk = dspec(GR._rng("risk_score", "decimal(5,1)", 0, 100), "c_custkey", ks)
    att = dspec(GR._rng("attendance_rate", "decimal(5,1)", 60, 100), "c_custkey", ks)
    kgpa = dspec(GR._rng("gpa", "decimal(3,2)", 0.5, 4.0), "c_custkey", ks)
    grade = dspec(GR._rng("grade_level", "int", 1, 12), "c_custkey", ks)
    ss = f"{SEED}/School"
    kind = dspec(GR._pick("_kind", ["Elementary", "Middle", "High"]), "n_nationkey", ss)
    school = (f"(SELECT n_nationkey AS sord, concat({dlist(GR.SCHOOL_PREFIXES, f'n_nationkey % {len(GR.SCHOOL_PREFIXES)}')}, "
              f"' ', {kind}, ' School') AS school, "
              f"{dspec(GR._pick('type', ['elementary', 'middle', 'high'], [5, 3, 2]), 'n_nationkey', ss)} AS school_type, "
              f"{dspec(GR._flag('title_i', 0.55), 'n_nationkey', ss)} AS title_i FROM nation)")
    attends = dk_targets("customer", "c_custkey", "ATTENDS", nnation, 1, 1)
    stu = (f"(SELECT c_custkey, {risk} AS risk_score, {att} AS attendance_rate, {kgpa} AS gpa, {grade} AS grade_level "
           f"FROM customer)")
    O["graph_h9_school_risk_ranking"] = (
        f"SELECT school, school_type, title_i, round(avg(CAST(risk_score AS DOUBLE)), 1) AS avg_risk, "
        f"round(avg(CAST(attendance_rate AS DOUBLE)), 1) AS avg_attendance, count(*) AS student_count "
        f"FROM {stu} s JOIN {attends} a ON a.src = s.c_custkey JOIN {school} sc ON sc.sord = a.dst_ord "
        f"GROUP BY school, school_type, title_i ORDER BY avg_risk DESC, school, school_type, title_i LIMIT 15")
    itype = dspec(GR._pick("type", GR.INTERVENTION_TYPES), "p_partkey", f"{SEED}/Intervention")
    received = dk_targets(f"(SELECT c_custkey FROM {stu} x WHERE risk_score > 40)", "c_custkey", "RECEIVED", npart, 1, 2)
    O["graph_h8_at_risk_students"] = (
        f"WITH iv AS (SELECT r.src, string_agg(i.itype, ',' ORDER BY i.itype) AS interventions FROM {received} r "
        f"JOIN (SELECT p_partkey, {itype} AS itype FROM part) i ON i.p_partkey = r.dst_ord GROUP BY r.src) "
        f"SELECT concat('K12-', lpad(CAST(s.c_custkey + 1 AS VARCHAR), 5, '0')) AS student, s.grade_level AS grade, "
        f"CAST(s.risk_score AS DOUBLE) AS risk_score, CAST(s.attendance_rate AS DOUBLE) AS attendance, "
        f"CAST(s.gpa AS DOUBLE) AS gpa, sc.school, coalesce(iv.interventions, '') AS interventions "
        f"FROM {stu} s JOIN {attends} a ON a.src = s.c_custkey JOIN {school} sc ON sc.sord = a.dst_ord "
        f"LEFT JOIN iv ON iv.src = s.c_custkey WHERE s.risk_score > 70 ORDER BY risk_score DESC, student LIMIT 25")
    # H7: ServiceRequest -AFFECTS-> Asset (poor/critical) -IN_DISTRICT-> District
    keep = f"(SELECT o_orderkey FROM orders WHERE {du('AFFECTS#keep', 'o_orderkey')} < 0.3)"
    aff = dk_targets(keep, "o_orderkey", "AFFECTS", npart, 1, 1)
    sa = f"{SEED}/Asset"
    asset = (f"(SELECT p_partkey, concat('AST-', lpad(CAST(p_partkey + 1 AS VARCHAR), 5, '0')) AS asset, "
             f"{dspec(GR._pick('type', GR.ASSET_TYPES), 'p_partkey', sa)} AS asset_type, "
             f"{dspec(GR._pick('condition', ['good', 'fair', 'poor', 'critical'], [4, 3, 2, 1]), 'p_partkey', sa)} AS condition, "
             f"concat('District ', {dspec(GR._rng('_dist', 'int', 1, 15), 'p_partkey', sa)}) AS district FROM part)")
    O["graph_h7_at_risk_assets"] = (
        f"SELECT asset, asset_type, condition, district, count(*) AS open_requests FROM {aff} e "
        f"JOIN {asset} a ON a.p_partkey = e.dst_ord WHERE condition IN ('poor', 'critical') "
        f"GROUP BY asset, asset_type, condition, district "
        f"ORDER BY open_requests DESC, asset, asset_type, condition, district LIMIT 20")
    # Case -MANAGED_BY-> Caseworker -WORKS_AT-> HHSAgency
    mb = dk_targets("orders", "o_orderkey", "MANAGED_BY", nsupp, 1, 1)
    cw = f"{SEED}/Caseworker"
    worker = (f"(SELECT s_suppkey, {dspec(GR._person('name'), 's_suppkey', cw)} AS caseworker, "
              f"{dspec(GR._pick('specialization', GR.SPECIALIZATIONS), 's_suppkey', cw)} AS specialization, "
              f"{dhash('agency_id#1', 's_suppkey', cw)} % {nnation} AS ag FROM supplier)")
    ha = f"{SEED}/HHSAgency"
    agency = (f"(SELECT n_nationkey, concat({dspec(GR._pick('_city', __import__('tidewell.functions.pools', fromlist=['x']).CITIES), 'n_nationkey', ha)}, ' ', "
              f"{dspec(GR._pick('_kind', GR.HHS_AGENCY_NAMES), 'n_nationkey', ha)}) AS agency FROM nation)")
    case = (f"(SELECT o_orderkey, {dspec(GR._rng('benefit_amount', 'decimal(10,2)', 0, 15000), 'o_orderkey', f'{SEED}/Case')} "
            f"AS benefit_amount FROM orders)")
    O["graph_h13_caseload"] = (
        f"SELECT caseworker, specialization, agency, count(*) AS active_cases, "
        f"round(avg(CAST(benefit_amount AS DOUBLE)), 2) AS avg_benefit FROM {mb} m "
        f"JOIN {case} c ON c.o_orderkey = m.src JOIN {worker} w ON w.s_suppkey = m.dst_ord "
        f"JOIN {agency} a ON a.n_nationkey = w.ag GROUP BY caseworker, specialization, agency "
        f"ORDER BY active_cases DESC, caseworker, specialization, agency LIMIT 20")


_add_graph_oracles()

ORACLE["graph_t_h1_region_customers"] = """
SELECT r_name AS region, count(DISTINCT c_custkey) AS customers, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY customers DESC, region
"""
ORACLE["graph_t_h4_region_supplier_trace"] = """
SELECT r_name AS region, n_name AS nation, s_name AS supplier, l_orderkey AS o_orderkey, l_linenumber AS linenumber,
       l_extendedprice AS price
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
ORDER BY price DESC, o_orderkey, linenumber, supplier, nation, region LIMIT 25
"""
ORACLE["graph_t_h10_supplier_revenue"] = """
SELECT s_name AS supplier, n_name AS nation, count(*) AS lines, round(sum(l_extendedprice), 0) AS revenue
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY s_name, n_name ORDER BY revenue DESC, supplier, nation LIMIT 20
"""
ORACLE["graph_t_h12_multi_priority_customers"] = """
SELECT c_custkey, c_mktsegment, count(*) AS orders, count(DISTINCT o_orderpriority) AS n_priorities,
       string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment
HAVING count(DISTINCT o_orderpriority) > 1 ORDER BY n_priorities DESC, orders DESC, c_custkey LIMIT 20
"""
ORACLE["graph_t_h18_supplier_part_orders"] = """
SELECT s_name AS supplier, p_name AS part, p_type AS part_type, l_orderkey AS order_key, l_linenumber AS line,
       l_quantity AS quantity, l_extendedprice AS price
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
ORDER BY quantity DESC, price DESC, order_key, line, supplier, part LIMIT 25
"""


# --- §2.I contracts -----------------------------------------------------------------
def _viol_sql(table: str, key: str, checks: list[tuple[str, str, str]]) -> str:
    """UNION of (field, check, failed) counts; each check is (field, name, SQL condition for a FAILED row)."""
    parts = [f"SELECT '{f}' AS field, '{n.replace(chr(39), chr(39) * 2)}' AS \"check\", count(*) AS failed "
             f"FROM {table} WHERE {cond}" for f, n, cond in checks]
    return (f"SELECT field, \"check\", failed FROM ({' UNION ALL '.join(parts)}) x WHERE failed > 0 "
            f"ORDER BY field, \"check\"")


def _dup(table: str, col: str) -> str:
    return f"{col} IN (SELECT {col} FROM {table} GROUP BY {col} HAVING count(*) > 1)"


def _add_contract_oracles():
    # fixed value: the URL pattern of contract fields
    url = (r"^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|"
           r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$")
    O = ORACLE
    O["contract_i_documents"] = _viol_sql("documents", "doc_id", [
        ("doc_id", "type primary_key", "doc_id = 0"),
        ("doc_id", "unique", _dup("documents", "doc_id")),
        ("text", "not empty", "regexp_matches(text, '^\\s*$')"),
        ("text", "length < 1000", "NOT length(text) < 1000"),
        ("text", "contains http", "NOT contains(text, 'http')"),
        ("text", "matches [A-Z]", "NOT regexp_matches(text, '^(?:[A-Z])')"),
        ("lang", "length = 2", "NOT length(lang) = 2"),
        ("lang", "alphabetic", "NOT regexp_matches(lang, '^\\p{L}+$')"),
        ("source", "starts with src", "NOT starts_with(source, 'src')"),
        ("source", "alphanumeric", "NOT regexp_matches(source, '^[\\p{L}\\p{N}]+$')"),
        ("n_chars", "positive", "NOT n_chars > 0"),
        ("n_chars", "max 20000", "NOT CAST(n_chars AS DOUBLE) <= 20000"),
        ("n_chars", "in range 1-5000", "NOT CAST(n_chars AS DOUBLE) BETWEEN 1 AND 5000"),
    ])
    O["contract_i_pages"] = _viol_sql("pages", "page_id", [
        ("page_id", "type primary_key", "page_id = 0"),
        ("url", "type url", f"NOT regexp_matches(url, '{url}', 'i')"),
        ("url", "starts with https", "NOT starts_with(url, 'https')"),
        ("url", "ends with .com", "NOT ends_with(url, '.com')"),
        ("html", "type html", "NOT (contains(lower(html), '<html>') OR ends_with(html, '.html'))"),
        ("html", "contains <body", "NOT contains(html, '<body')"),
        ("html", "length > 100", "NOT length(html) > 100"),
    ])
    O["contract_i_events"] = _viol_sql("events", "event_id", [
        ("event_id", "type primary_key", "event_id = 0"),
        ("event_id", "unique", _dup("events", "event_id")),
        ("user_id", "positive", "NOT user_id > 0"),
        ("event_type", "matches (click|view|purchase|signup)",
         "NOT regexp_matches(event_type, '^(?:(click|view|purchase|signup))')"),
        ("event_type", "numeric", "NOT regexp_matches(event_type, '^\\p{N}+$')"),
        ("value", "type price", "NOT value >= 0"),
        ("value", "max 100", "NOT value <= 100"),
        ("value", "in range 0-50", "NOT value BETWEEN 0 AND 50"),
        ("value", "in range -5-5", "NOT value BETWEEN -5 AND 5"),
        ("props", "type json", "NOT (CASE WHEN json_valid(props) THEN json_type(props) IN ('OBJECT', 'ARRAY') ELSE false END)"),
        ("props", "contains \"k\"", "NOT contains(props, '\"k\"')"),
        ("props", "length > 9", "NOT length(props) > 9"),
    ])
    conv = []
    for col in ("conv_id", "turn"):
        conv += [(col, "positive", f"NOT CAST({col} AS INTEGER) > 0"),
                 (col, "max 2147483647", f"NOT CAST({col} AS DOUBLE) <= 2147483647")]
    for col in ("role", "text"):
        conv += [(col, "not empty", f"regexp_matches({col}, '^\\s*$')"),
                 (col, "length > 0", f"NOT length({col}) > 0"),
                 (col, "length < 1000", f"NOT length({col}) < 1000")]
    O["contract_i_conversations_default_rules"] = _viol_sql("conversations", "conv_id", conv)
    # fixed values: the allowed steps from one event type to the next
    allowed = ("('signup', 'view'), ('signup', 'click'), ('signup', 'signup'), "
               "('view', 'view'), ('view', 'click'), ('view', 'purchase'), ('view', 'error'), "
               "('click', 'view'), ('click', 'click'), ('click', 'purchase'), ('click', 'error'), "
               "('purchase', 'view'), ('purchase', 'click'), ('purchase', 'purchase'), "
               "('error', 'view'), ('error', 'click'), ('error', 'error')")
    O["contract_i_event_transitions"] = (
        f"SELECT from_status, to_status, count(*) AS violations FROM "
        f"(SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status, "
        f"event_type AS to_status FROM events) p WHERE from_status IS NOT NULL "
        f"AND (from_status, to_status) NOT IN (SELECT * FROM (VALUES {allowed}) v(a, b)) "
        f"GROUP BY from_status, to_status ORDER BY from_status, to_status")
    O["contract_i_event_transitions_by_id"] = O["contract_i_event_transitions"].replace("ORDER BY ts, event_id)", "ORDER BY event_id)")
    O["contract_i_orders_unique"] = " UNION ALL ".join(
        f"SELECT '{c}' AS field, 'unique' AS check, CAST(sum(n) AS BIGINT) AS failed FROM (SELECT count(*) AS n FROM orders "
        f"WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1) HAVING sum(n) > 0" for c in ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    O["contract_i_requirement_coverage"] = (
        "SELECT p_partkey, coalesce(s.stories, 0) AS stories, coalesce(e.epics, 0) AS epics, "
        "least(100.0, (coalesce(s.stories, 0) + coalesce(e.epics, 0)) * 25.0) AS coverage_percentage, "
        "CASE WHEN least(100.0, (coalesce(s.stories, 0) + coalesce(e.epics, 0)) * 25.0) < 100.0 THEN "
        "'Only ' || CAST(CAST(least(100.0, (coalesce(s.stories, 0) + coalesce(e.epics, 0)) * 25.0) AS DOUBLE) AS VARCHAR)"
        " || '% covered' END AS gap FROM part "
        "LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS stories FROM lineitem GROUP BY l_partkey) s "
        "ON s.l_partkey = p_partkey "
        "LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS epics FROM lineitem GROUP BY l_partkey) e "
        "ON e.l_partkey = p_partkey")
    O["contract_i_requirement_lists"] = """
        WITH l AS (SELECT DISTINCT l_partkey AS req, 'story' AS kind, l_orderkey AS item FROM lineitem
                   UNION ALL SELECT DISTINCT l_partkey, 'epic', l_suppkey FROM lineitem),
        n AS (SELECT *, CAST(('0x' || substr(md5(CAST(item AS VARCHAR)), 1, 8)) AS BIGINT)
                        % CAST(ceil(count(*) OVER (PARTITION BY req, kind) / 16.0) AS BIGINT) AS page FROM l),
        g AS (SELECT req, kind, page, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS ids FROM n GROUP BY ALL)
        SELECT p_partkey AS requirement, k.kind, coalesce(page, 0) AS page, coalesce(ids, '') AS ids
        FROM part CROSS JOIN (VALUES ('story'), ('epic')) k(kind) LEFT JOIN g ON g.req = p_partkey AND g.kind = k.kind"""
    O["contract_i_text_search"] = (
        "SELECT doc_id, lang, n_chars FROM documents WHERE (contains(lower(text), 'ing') OR "
        "contains(lower(source), 'ing')) AND lang = 'en'")


_add_contract_oracles()


# --- §2.J stream analytics (batch form over events) ------------------------------
def _bucket_ts(us: int) -> str:
    return f"make_timestamp(CAST(floor(epoch_us(ts) / {us}) * {us} AS BIGINT))"


def _add_stream_analytics_oracles():
    from .streams import stream_spec
    O = ORACLE
    j2 = (f"SELECT {_bucket_ts(300000000)} AS window_start, count(*) AS events, "
          f"sum(CAST(event_type = 'error' AS INTEGER)) AS errors, "
          f"round(sum(CAST(event_type = 'error' AS INTEGER)) / count(*), 4) AS error_rate FROM events GROUP BY 1")
    O["stream_j2_error_rate"] = j2
    O["stream_j2_stream_error_rate"] = j2
    O["stream_j3_sliding_mean"] = (
        "SELECT make_timestamp(CAST(s AS BIGINT)) AS window_start, event_type, count(*) AS events, "
        "round(avg(value), 4) AS mean_value FROM ("
        "SELECT floor(epoch_us(ts) / 300000000) * 300000000 AS s, event_type, value FROM events UNION ALL "
        "SELECT floor(epoch_us(ts) / 300000000) * 300000000 - 300000000, event_type, value FROM events) "
        "GROUP BY 1, 2")
    O["stream_j3_zscore_outliers"] = (
        "SELECT event_type, count(*) AS outliers FROM events JOIN (SELECT event_type, avg(value) AS mu, "
        "stddev_samp(value) AS sd FROM events GROUP BY 1) s USING (event_type) "
        "WHERE abs(value - mu) > 2.0 * sd GROUP BY 1")
    O["stream_j4_sessions"] = (
        "WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR "
        "epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS new FROM events "
        "WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
        "y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC "
        "ROWS UNBOUNDED PRECEDING) AS sid FROM x), "
        "s AS (SELECT user_id, sid, min(ts) AS st, max(ts) + INTERVAL 30 MINUTE AS en, count(*) AS n "
        "FROM y GROUP BY 1, 2) "
        "SELECT user_id, count(*) AS sessions, sum(n) AS events, "
        "round(avg(floor(epoch(en)) - floor(epoch(st))), 2) AS avg_session_seconds FROM s GROUP BY 1")
    O["stream_j5_velocity"] = (
        "SELECT user_id, count(*) AS flagged_events FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id "
        "ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events) "
        "WHERE recent > 2 GROUP BY 1")
    card = {c["name"]: c for c in stream_spec("fraud_detection")}
    lat, lon = dspec(card["latitude"], "event_id"), dspec(card["longitude"], "event_id")
    O["stream_j6_impossible_travel"] = (
        f"WITH p AS (SELECT event_id, user_id AS card_holder, ts, CAST({lat} AS DOUBLE) AS lat, "
        f"CAST({lon} AS DOUBLE) AS lon FROM events), "
        f"q AS (SELECT card_holder, ts, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, "
        f"lag(ts) OVER w AS pts FROM p WINDOW w AS (PARTITION BY card_holder ORDER BY ts, event_id)), "
        f"r AS (SELECT card_holder, 2 * 6371.0 * asin(sqrt(pow(sin((lat - plat) * pi() / 180.0 / 2), 2) + "
        f"cos(plat * pi() / 180.0) * cos(lat * pi() / 180.0) * pow(sin((lon - plon) * pi() / 180.0 / 2), 2))) AS km, "
        f"(epoch_us(ts) - epoch_us(pts)) / 3.6e9 AS hours FROM q WHERE plat IS NOT NULL) "
        f"SELECT card_holder, count(*) AS flagged_moves FROM r WHERE "
        f"(hours > 0 AND round(km / hours, 3) > 900.0) OR (hours <= 0 AND round(km, 3) > 0) GROUP BY 1")
    tel = {c["name"]: c for c in stream_spec("telemetry")}
    bat = dspec(tel["battery_level"], "event_id")
    O["stream_j7_low_battery"] = (
        f"WITH p AS (SELECT event_id, user_id AS device, ts, CAST({bat} AS DOUBLE) AS level FROM events), "
        f"q AS (SELECT device, level, lag(level) OVER (PARTITION BY device ORDER BY ts, event_id) AS prev FROM p) "
        f"SELECT device, count(*) AS alerts FROM q WHERE level < 20.0 AND prev >= 20.0 GROUP BY 1")
    for n in ("j5_velocity", "j6_impossible_travel", "j7_low_battery"):
        O[f"stream_{n[:2]}_stream{n[2:]}"] = O[f"stream_{n}"]
    O["stream_j12_stream_normalized_ids"] = (
        "SELECT c_mktsegment AS segment, count(*) AS events, count(DISTINCT c_custkey) AS customers "
        "FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1")
    O["stream_j8_funnel"] = (
        "WITH a AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1), "
        "b AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN a ON a.user_id = e.user_id AND e.ts >= a.t "
        "WHERE e.event_type = 'click' GROUP BY 1), "
        "c AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN b ON b.user_id = e.user_id AND e.ts >= b.t "
        "WHERE e.event_type = 'purchase' GROUP BY 1) "
        "SELECT (SELECT count(*) FROM a) AS step1_view, (SELECT count(*) FROM b) AS step2_click, "
        "(SELECT count(*) FROM c) AS step3_purchase")
    O["stream_j9_shares"] = (
        "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share "
        "FROM events GROUP BY 1")
    fw = dspec(tel["firmware_version"], "event_id")
    cols = ", ".join(f"count(*) FILTER (WHERE fw = '{v}') AS \"{v}\"" for v in ("1.0.0", "1.1.0", "1.2.3", "2.0.0", "2.1.0"))
    O["stream_j10_firmware_rollout"] = (
        f"SELECT {_bucket_ts(86400000000)} AS window_start, {cols} FROM "
        f"(SELECT ts, {fw} AS fw FROM events) GROUP BY 1 ORDER BY 1")
    O["stream_j11_dedupe"] = (
        "SELECT event_type, count(*) AS unique_events FROM "
        "(SELECT DISTINCT user_id, event_type, date_trunc('minute', ts) FROM events) GROUP BY 1")
    O["stream_j12_enrich"] = (
        "SELECT c_mktsegment, count(*) AS events, round(sum(value), 2) AS value FROM events "
        "LEFT JOIN customer ON user_id = c_custkey GROUP BY 1")
    recs = "(SELECT props AS v FROM events UNION ALL SELECT text AS v FROM conversations)"
    ok = "(CASE WHEN json_valid(v) THEN json_type(v) = 'OBJECT' ELSE false END)"
    O["stream_j13_dead_letters"] = (
        f"SELECT 'decoded' AS kind, count(*) AS n, sum(CASE WHEN json_valid(v) THEN CAST(json_extract(v, '$.k') AS BIGINT) END) AS k_sum "
        f"FROM {recs} r WHERE {ok} UNION ALL "
        f"SELECT 'dead_letter' AS kind, count(*) AS n, CAST(NULL AS BIGINT) AS k_sum FROM {recs} r WHERE NOT {ok}")


_add_stream_analytics_oracles()


# --- §2.A sources and table operations ---------------------------------------------
def _add_source_oracles():
    O = ORACLE
    tables = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
              "conversations").split()
    O["source_a8_upsert_customers"] = (
        "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998) "
        "THEN 'ACTIVE_1998' ELSE c_mktsegment END AS c_mktsegment, count(*) AS customers FROM customer GROUP BY 1")
    O["source_a11_table_copy"] = (
        "SELECT l_linestatus, count(*) AS rows, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS copied "
        "FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
    O["source_a14_inventory"] = " UNION ALL ".join(
        [f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS row_count, 'ok' AS status" for n in tables]
        + ["SELECT 'missing_table' AS table_name, CAST(NULL AS BIGINT) AS row_count, 'not found' AS status"])
    O["source_a24_audit_query"] = (
        "SELECT *, count(*) OVER () AS total FROM (SELECT event_id AS id, event_type, CAST(user_id AS VARCHAR) AS user_id, "
        "'events.' || event_type AS topic_name, props AS topic_message, ts AS created_at FROM events) "
        "WHERE topic_name = 'events.click' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")
    O["source_a25_bounded_consume"] = (
        "SELECT 'events' AS topic, user_id % 4 AS partition, event_id AS \"offset\", props AS value FROM events "
        "ORDER BY partition, \"offset\" LIMIT 25")
    O["source_a26_latest_value_per_key"] = (
        "SELECT key, value, updated_at FROM (SELECT 'user:' || CAST(user_id AS VARCHAR) AS key, props AS value, "
        "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, "
        "max(ts) OVER (PARTITION BY user_id) AS updated_at FROM events) WHERE rn = 1")
    O["source_a27_federated_sql"] = (
        "SELECT n_name, customers, avg_balance FROM nation, LATERAL (SELECT count(*) AS customers, "
        "round(sum(c_acctbal) / count(c_acctbal), 2) AS avg_balance FROM customer "
        "WHERE c_nationkey = n_nationkey AND c_acctbal > 0) WHERE customers > 0")


_add_source_oracles()


def _add_graph_export_oracles():
    from . import graphs as GR
    O = ORACLE
    npart, nnation = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM nation)"
    sj = "CAST(src AS VARCHAR) || ':' || CAST(j AS VARCHAR)"
    st, cs = f"{SEED}/Student", f"{SEED}/Course"
    student = (f"(SELECT c_custkey, concat('STU-', lpad(CAST(c_custkey + 1 AS VARCHAR), 6, '0')) AS student_id, "
               f"{dspec(GR._person('name'), 'c_custkey', st)} AS student_name, "
               f"{dspec(GR._pick('campus', GR.CAMPUSES), 'c_custkey', st)} AS campus, "
               f"{dspec(GR._rng('gpa', 'decimal(3,2)', 1.5, 4.0), 'c_custkey', st)} AS gpa FROM customer)")
    lvl_off = (f"CAST({dspec(GR._pick('_lvl', GR.COURSE_LEVELS, type_='int'), 'p_partkey', cs)} + "
               f"{dspec(GR._rng('_off', 'int', 0, 9), 'p_partkey', cs)} AS VARCHAR)")
    course = (f"(SELECT p_partkey, concat('CRS-', lpad(CAST(p_partkey + 1 AS VARCHAR), 4, '0')) AS course_id, "
              f"concat({dspec(GR._pick('_prefix', GR.COURSE_PREFIXES), 'p_partkey', cs)}, ' ', "
              f"{dlist(GR.DEPARTMENTS, 'p_partkey % 18')}, ' ', lpad({lvl_off}, 3, '0')) AS course_name, "
              f"CAST({dspec(GR._pick('level', GR.COURSE_LEVELS, type_='int'), 'p_partkey', cs)} AS INTEGER) AS level, "
              f"{dspec(GR._pick('semester', GR.SEMESTERS), 'p_partkey', cs)} AS semester, "
              f"concat('DEPT-', lpad(CAST(p_partkey % 18 + 1 AS VARCHAR), 3, '0')) AS department_id, "
              f"{dlist(GR.DEPARTMENTS, 'p_partkey % 18')} AS department FROM part)")
    enr = dk_targets("customer", "c_custkey", "ENROLLED_IN", npart, 2, 5)
    pur = dk_targets("customer", "c_custkey", "PURSUING", "45", 1, 1)
    ks, ss, iv = f"{SEED}/K12Student", f"{SEED}/School", f"{SEED}/Intervention"
    k12 = (f"(SELECT c_custkey, concat('K12-', lpad(CAST(c_custkey + 1 AS VARCHAR), 5, '0')) AS student_id, "
           f"{dspec(GR._person('name'), 'c_custkey', ks)} AS name, "
           f"{dspec(GR._rng('risk_score', 'decimal(5,1)', 0, 100), 'c_custkey', ks)} AS risk_score, "
           f"{dspec(GR._rng('attendance_rate', 'decimal(5,1)', 60, 100), 'c_custkey', ks)} AS attendance_rate, "
           f"{dspec(GR._rng('gpa', 'decimal(3,2)', 0.5, 4.0), 'c_custkey', ks)} AS gpa, "
           f"{dspec(GR._pick('behavior_incidents_ytd', list(range(15)), [50, 10, 8, 6, 5, 4, 3, 2, 2, 2, 1, 1, 1, 1, 1], 'int'), 'c_custkey', ks)} AS incidents "
           f"FROM customer)")
    kind = dspec(GR._pick("_kind", ["Elementary", "Middle", "High"]), "n_nationkey", ss)
    school = (f"(SELECT n_nationkey AS sord, concat('SCH-', lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0')) AS school_id, "
              f"concat({dlist(GR.SCHOOL_PREFIXES, f'n_nationkey % {len(GR.SCHOOL_PREFIXES)}')}, ' ', {kind}, "
              f"' School') AS school FROM nation)")
    attends = dk_targets("customer", "c_custkey", "ATTENDS", nnation, 1, 1)
    risky = f"(SELECT c_custkey FROM {k12} x WHERE risk_score > 40)"
    received = dk_targets(risky, "c_custkey", "RECEIVED", npart, 1, 2)
    interv = (f"(SELECT p_partkey, concat('INT-', lpad(CAST(p_partkey + 1 AS VARCHAR), 5, '0')) AS intervention_id, "
              f"{dspec(GR._pick('type', GR.INTERVENTION_TYPES), 'p_partkey', iv)} AS intervention FROM part)")
    rec = (f"(SELECT r.src, i.intervention_id, {dpick(du('RECEIVED#ref', sj.replace('src', 'r.src').replace('j AS', 'r.j AS')), GR.REFERRERS)} "
           f"AS referred_by, i.intervention FROM {received} r JOIN {interv} i ON i.p_partkey = r.dst_ord)")
    O["graph_h21_low_attendance"] = (
        f"SELECT k.student_id, k.name, CAST(k.attendance_rate AS DOUBLE) AS attendance_rate, "
        f"CAST(k.gpa AS DOUBLE) AS gpa, sc.school, coalesce((SELECT string_agg(rec.intervention, ',' "
        f"ORDER BY rec.intervention) FROM {rec} rec WHERE rec.src = k.c_custkey), '') AS interventions "
        f"FROM {k12} k JOIN {attends} a ON a.src = k.c_custkey JOIN {school} sc ON sc.sord = a.dst_ord "
        f"WHERE k.attendance_rate < 80 AND k.incidents > 5 ORDER BY attendance_rate, student_id")


_add_graph_export_oracles()


def _add_prerequisite_oracle():
    from . import graphs as GR
    cs = f"{SEED}/Course"
    lvl_off = (f"CAST({dspec(GR._pick('_lvl', GR.COURSE_LEVELS, type_='int'), 'p_partkey', cs)} + "
               f"{dspec(GR._rng('_off', 'int', 0, 9), 'p_partkey', cs)} AS VARCHAR)")
    course = (f"SELECT concat('CRS-', lpad(CAST(p_partkey + 1 AS VARCHAR), 4, '0')) AS course_id, "
              f"concat({dspec(GR._pick('_prefix', GR.COURSE_PREFIXES), 'p_partkey', cs)}, ' ', "
              f"{dlist(GR.DEPARTMENTS, 'p_partkey % 18')}, ' ', lpad({lvl_off}, 3, '0')) AS name, "
              f"CAST({dspec(GR._pick('level', GR.COURSE_LEVELS, type_='int'), 'p_partkey', cs)} AS INTEGER) AS level "
              f"FROM part")
    ORACLE["graph_h2_prerequisite_chains"] = (
        f"WITH RECURSIVE c AS ({course}), "
        f"o AS (SELECT course_id, level, row_number() OVER (ORDER BY level, course_id) - 1 AS ord FROM c), "
        f"lo AS (SELECT level, min(ord) AS lower_n FROM o GROUP BY level), "
        f"req AS (SELECT o.course_id AS src, t.course_id AS dst FROM o JOIN lo USING (level) "
        f"JOIN o t ON t.ord = {dhash('REQUIRES#target', 'o.course_id')} % lo.lower_n "
        f"WHERE o.level >= 200 AND lo.lower_n > 0 AND {du('REQUIRES#pick', 'o.course_id')} < 0.6), "
        f"p(start, cur, depth, chain) AS ("
        f"SELECT r.src, r.dst, 1, a.name || ' > ' || b.name FROM req r JOIN c a ON a.course_id = r.src "
        f"JOIN c b ON b.course_id = r.dst "
        f"UNION ALL SELECT p.start, r.dst, p.depth + 1, p.chain || ' > ' || b.name FROM p "
        f"JOIN req r ON r.src = p.cur JOIN c b ON b.course_id = r.dst WHERE p.depth < 5) "
        f"SELECT c.name AS course, c.level, p.depth AS prereq_depth, p.chain FROM p JOIN c ON c.course_id = p.start "
        f"ORDER BY prereq_depth DESC, course, chain, level LIMIT 20")


_add_prerequisite_oracle()


def _add_label_count_oracle():
    src = {
        "student_enrollment": [("Department", "18"), ("DegreeProgram", "45"), ("Course", "part"),
                               ("Student", "customer")],
        "grant_budget": [("FundingSource", "nation"), ("Agency", "nation"), ("Program", "part"),
                         ("Vendor", "supplier"), ("LineItem", "orders")],
        "citizen_services": [("District", "15"), ("ServiceDepartment", "10"), ("Asset", "part"),
                             ("Citizen", "customer"), ("ServiceRequest", "orders")],
        "k12_early_warning": [("School", "nation"), ("Teacher", "supplier"), ("RiskIndicator", "12"),
                              ("K12Student", "customer"), ("Intervention", "part")],
        "procurement": [("ProcAgency", "nation"), ("ProcVendor", "supplier"), ("Contract", "part"),
                        ("Lobbyist", "supplier")],
        "case_management": [("HHSAgency", "nation"), ("HHSProgram", "20"), ("Caseworker", "supplier"),
                            ("Client", "customer"), ("Case", "orders")],
    }
    parts = []
    for graph, labels in src.items():
        for label, s in labels:
            n = f"CAST({s} AS BIGINT)" if s.isdigit() else f"(SELECT count(*) FROM {s})"
            parts.append(f"SELECT '{label}' AS label, {n} AS count, '{graph}' AS graph")
    ORACLE["graph_h14_label_counts"] = " UNION ALL ".join(parts)


_add_label_count_oracle()


# --- graph queries over distinct-pair relationships -----------------------------------
def dpairs(index_table: str, index_col: str, a_sql: str, b_sql: str, rel: str, seed=SEED) -> str:
    """(i, a_ord, b_ord) of ``distinct_pairs``: (i // B, i % B) shifted four times, each half by a hash of the other."""
    n = f"CAST({index_col} AS HUGEINT)"
    a, b = f"CAST({a_sql} AS HUGEINT)", f"CAST({b_sql} AS HUGEINT)"
    x = f"(SELECT {index_col} AS i, CAST({n} // {b} AS BIGINT) AS x, CAST({n} % {b} AS BIGINT) AS y, CAST({a} AS BIGINT) AS aa, CAST({b} AS BIGINT) AS bb FROM {index_table} WHERE {n} < {a} * {b})"
    for r in range(0, 4, 2):
        x = f"(SELECT i, (x + {dhash(f'{rel}#{r}', 'y', seed)} % aa) % aa AS x, y, aa, bb FROM {x} q{r})"
        x = f"(SELECT i, x, (y + {dhash(f'{rel}#{r + 1}', 'x', seed)} % bb) % bb AS y, aa, bb FROM {x} q{r + 1})"
    return f"(SELECT i, x AS a_ord, y AS b_ord FROM {x} z)"


def _add_pair_graph_oracles():
    from ..functions import pools
    from . import graphs as GR
    O = ORACLE
    ncust, nord, npart = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM orders)", "(SELECT count(*) FROM part)"
    nnation, nsupp = "(SELECT count(*) FROM nation)", "(SELECT count(*) FROM supplier)"
    # H6: ServiceRequest <-SUBMITTED- Citizen, by priority with five sorted sample types
    sr = f"{SEED}/ServiceRequest"
    req = (f"(SELECT o_orderkey AS ord, {dspec(GR._pick('type', GR.REQUEST_TYPES), 'o_orderkey', sr)} AS type, "
           f"{dspec(GR._pick('priority', ['critical', 'high', 'medium', 'low'], [1, 2, 4, 3]), 'o_orderkey', sr)} "
           f"AS priority FROM orders)")
    sub = dpairs("orders", "o_orderkey", ncust, nord, "SUBMITTED")
    O["graph_h6_requests_by_priority"] = (
        f"SELECT priority, count(*) AS requests, "
        f"array_to_string(list_slice(list_sort(list_distinct(list(type))), 1, 5), ',') AS sample_types "
        f"FROM {sub} p JOIN {req} r ON r.ord = p.b_ord GROUP BY priority")
    # ProcAgency -ISSUED-> Contract -AWARDED_TO-> ProcVendor
    ct, pv = f"{SEED}/Contract", f"{SEED}/ProcVendor"
    contract = (f"(SELECT p_partkey AS ord, CAST({dspec(GR._rng('amount', 'decimal(14,2)', 5000, 25000000), 'p_partkey', ct)} "
                f"AS DOUBLE) AS amount FROM part)")
    vendor = (f"(SELECT s_suppkey AS ord, concat_ws(' ', {dspec(GR._pick('_last', pools.LAST_NAMES), 's_suppkey', pv)}, "
              f"{dspec(GR._pick('_kind', GR.PROC_VENDOR_KINDS), 's_suppkey', pv)}, "
              f"{dspec(GR._pick('_suffix', GR.PROC_VENDOR_SUFFIXES), 's_suppkey', pv)}) AS vendor, "
              f"{dspec(GR._flag('minority_owned', 0.18), 's_suppkey', pv)} AS mbe, "
              f"{dspec(GR._flag('small_business', 0.35), 's_suppkey', pv)} AS sbe FROM supplier)")
    iss = dpairs("part", "p_partkey", nnation, npart, "ISSUED")
    aw = dk_targets("part", "p_partkey", "AWARDED_TO", nsupp, 1, 1)
    O["graph_h10_top_vendors"] = (
        f"SELECT v.vendor, v.mbe, v.sbe, count(*) AS contracts, round(sum(c.amount), 0) AS total_value "
        f"FROM {iss} i JOIN {contract} c ON c.ord = i.b_ord JOIN {aw} a ON a.src = i.b_ord "
        f"JOIN {vendor} v ON v.ord = a.dst_ord GROUP BY v.vendor, v.mbe, v.sbe "
        f"ORDER BY total_value DESC, vendor, mbe, sbe LIMIT 20")
    # Client -HAS_CASE-> Case -ENROLLED_IN-> HHSProgram, clients in more than one program
    cs, cl = f"{SEED}/Case", f"{SEED}/Client"
    det = dspec(GR._pick("determination", ["approved", "denied", "pending", "deferred", "conditional"],
                         [5, 2, 2, 1, 1]), "o_orderkey", cs)
    approved = f"(SELECT o_orderkey FROM orders WHERE {det} = 'approved')"
    enr = dk_targets(approved, "o_orderkey", "ENROLLED_IN", str(len(GR.HHS_PROGRAMS)), 1, 2)
    hc = dpairs("orders", "o_orderkey", ncust, nord, "HAS_CASE")
    client = (f"(SELECT c_custkey AS ord, {dspec(GR._pick('income_bracket', GR.INCOME, GR.INCOME_WEIGHTS), 'c_custkey', cl)} "
              f"AS income, {dspec(GR._pick('household_size', GR.HOUSEHOLD, GR.HOUSEHOLD_WEIGHTS, 'int'), 'c_custkey', cl)} "
              f"AS household_size FROM customer)")
    O["graph_h12_multi_program_clients"] = (
        f"WITH x AS (SELECT h.a_ord AS client, h.b_ord AS case_ord, {dlist(GR.HHS_PROGRAMS, 'e.dst_ord')} AS program "
        f"FROM {hc} h JOIN {enr} e ON e.src = h.b_ord), "
        f"per AS (SELECT client, list_sort(list_distinct(list(program))) AS programs, count(DISTINCT case_ord) AS cases "
        f"FROM x GROUP BY client HAVING len(list_distinct(list(program))) > 1) "
        f"SELECT concat('CLT-', lpad(CAST(per.client + 1 AS VARCHAR), 5, '0')) AS client, c.income, "
        f"CAST(c.household_size AS INTEGER) AS household_size, per.cases, len(per.programs) AS n_programs, "
        f"array_to_string(per.programs, ',') AS programs FROM per JOIN {client} c ON c.ord = per.client "
        f"ORDER BY n_programs DESC, client LIMIT 20")


_add_pair_graph_oracles()


# --- graph queries over Bernoulli relationships ---------------------------------------
def dbern(src_sql: str, src_key: str, T: str, p: float, rel: str, seed=SEED, no_self: bool = False,
          max_per_source: int | None = None, self_col: str | None = None) -> str:
    """(src, dst_ord) of ``bernoulli_edges``: geometric gaps from the hash, running sums per source."""
    # the stated probability up to 2000 targets, the degree of 2000 targets beyond
    prob = f"({p!r}::DOUBLE * least(1::DOUBLE, 2000::DOUBLE / s.tt))"
    mean = f"(CAST(s.tt AS DOUBLE) * {prob})"
    size = f"CAST(trunc({mean} + 10.0 * sqrt({mean} * (1::DOUBLE - {prob})) + 32.0) AS INTEGER)"
    if max_per_source:
        size = f"least({size}, {int(max_per_source) + 1})"
    size = f"greatest({size}, 1)"
    u = du(f"{rel}#gap", "CAST(src AS VARCHAR) || ':0:' || CAST(i AS VARCHAR)", seed)
    gap = f"(CASE WHEN {prob} >= 1 THEN 1 ELSE floor(ln(1::DOUBLE - {u}) / ln(1::DOUBLE - {prob})) + 1 END)"
    pos = (f"(SELECT src, tt, self_o, i, -1 + sum({gap}) OVER (PARTITION BY src ORDER BY i) AS pos FROM "
           f"(SELECT {src_key} AS src, {T} AS tt, {self_col or 'NULL'} AS self_o FROM {src_sql}) s, "
           f"generate_series(1, {size}) g(i))")
    cond = "pos < tt" + (" AND pos <> src" if no_self else "") + (" AND pos <> self_o" if self_col else "")
    if max_per_source:  # rotate first, then drop the self pair, then keep the first of the rest
        turned = f"(SELECT src, i, self_o, tt, CAST((pos + {dhash(f'{rel}#rot', 'src', seed)} % tt) % tt AS BIGINT) AS pos FROM {pos} x WHERE pos < tt)"
        return (f"(SELECT src, pos AS dst_ord FROM {turned} y WHERE {cond} "
                f"QUALIFY row_number() OVER (PARTITION BY src ORDER BY i) <= {int(max_per_source)})")
    return f"(SELECT src, CAST(pos AS BIGINT) AS dst_ord FROM {pos} x WHERE {cond})"


def _add_bernoulli_graph_oracles():
    from ..functions import pools
    from . import graphs as GR
    O = ORACLE
    npart, nnation, nsupp = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM nation)", "(SELECT count(*) FROM supplier)"
    vd = f"{SEED}/Vendor"
    vendor = (f"(SELECT s_suppkey AS ord, concat_ws(' ', {dspec(GR._pick('_last', pools.LAST_NAMES), 's_suppkey', vd)}, "
              f"{dspec(GR._pick('_kind', GR.VENDOR_TYPES), 's_suppkey', vd)}, "
              f"{dspec(GR._pick('_suffix', GR.VENDOR_SUFFIXES), 's_suppkey', vd)}) AS name, "
              f"{dspec(GR._pick('state', pools.STATES), 's_suppkey', vd)} AS state FROM supplier)")
    sub = dbern("supplier", "s_suppkey", nsupp, 0.008, "SUBCONTRACTS", no_self=True)
    pct = dint(du("SUBCONTRACTS#pct", "CAST(e.src AS VARCHAR) || ':' || CAST(e.dst_ord AS VARCHAR)"), 5, 44)
    O["graph_h5_subcontract_pairs"] = (
        f"SELECT a.name AS prime_vendor, b.name AS subcontractor, {pct} AS subcontract_pct, a.state AS prime_state, "
        f"b.state AS sub_state FROM {sub} e JOIN {vendor} a ON a.ord = e.src JOIN {vendor} b ON b.ord = e.dst_ord "
        f"ORDER BY subcontract_pct DESC, prime_vendor, subcontractor, prime_state, sub_state LIMIT 25")
    fs, ag, pg = f"{SEED}/FundingSource", f"{SEED}/Agency", f"{SEED}/Program"
    fund = (f"(SELECT n_nationkey AS ord, concat({dspec(GR._pick('_prog', GR.FEDERAL_PROGRAMS), 'n_nationkey', fs)}, "
            f"' - FY', CAST({dspec(GR._pick('_fy', [2023, 2024, 2025, 2026], type_='int'), 'n_nationkey', fs)} AS VARCHAR)) "
            f"AS fund_source, {dspec(GR._pick('category', GR.FUND_CATEGORIES), 'n_nationkey', fs)} AS category FROM nation)")
    agency = (f"(SELECT n_nationkey AS ord, concat({dspec(GR._pick('_city', pools.CITIES), 'n_nationkey', ag)}, ' ', "
              f"{dspec(GR._pick('_kind', GR.GRANT_AGENCY_TYPES), 'n_nationkey', ag)}) AS agency FROM nation)")
    program = (f"(SELECT p_partkey AS ord, concat({dspec(GR._pick('_pname', GR.PROGRAM_NAMES), 'p_partkey', pg)}, "
               f"' Phase ', CAST({dspec(GR._rng('_phase', 'int', 1, 5), 'p_partkey', pg)} AS VARCHAR)) AS program "
               f"FROM part)")
    funds = dbern("nation", "n_nationkey", nnation, 0.3, "FUNDS")
    famount = dint(du("FUNDS#amount", "CAST(f.src AS VARCHAR) || ':' || CAST(f.dst_ord AS VARCHAR)"), 0, 4999999)
    manages = dbern("nation", "n_nationkey", npart, 0.15, "MANAGES")
    role = dpick(du("MANAGES#role", "CAST(m.src AS VARCHAR) || ':' || CAST(m.dst_ord AS VARCHAR)"), GR.MANAGE_ROLES)
    awards = dbern("part", "p_partkey", nsupp, 0.05, "AWARDS")
    O["graph_h4_funding_trace"] = (
        f"SELECT fs.fund_source, fs.category, a.agency, p.program, v.name AS vendor, {famount} AS amount "
        f"FROM {funds} f JOIN {fund} fs ON fs.ord = f.src JOIN {agency} a ON a.ord = f.dst_ord "
        f"JOIN {manages} m ON m.src = f.dst_ord JOIN {program} p ON p.ord = m.dst_ord "
        f"JOIN {awards} w ON w.src = m.dst_ord JOIN {vendor} v ON v.ord = w.dst_ord "
        f"ORDER BY amount DESC, fund_source, category, agency, program, vendor LIMIT 25")


_add_bernoulli_graph_oracles()


def drule_full(rule: dict, name: str, key: str, seq: str, seed) -> str:
    """JSON rules as DuckDB SQL, including name, sequence, email, date and bool."""
    from datetime import datetime, timezone

    from ..functions import pools
    g = rule.get("generator")
    if g == "name":
        return (f"concat_ws(' ', {dpick(du(name + '#first', key, seed), pools.RULE_FIRST_NAMES)}, "
                f"{dpick(du(name + '#last', key, seed), pools.RULE_LAST_NAMES)})")
    if g == "sequence":
        return f"concat('{rule.get('prefix', '')}', {dpad(seq, int(rule.get('width', 6)))})"
    if g == "email":
        return f"concat('user', CAST({seq} AS VARCHAR), '@{rule.get('domain', 'example.com')}')"
    if g == "date":
        def ep(s):
            return int(datetime.fromisoformat(s).replace(tzinfo=timezone.utc).timestamp())
        lo, hi = ep(rule.get("start", "2023-01-01")), ep(rule.get("end", "2025-12-31"))
        return f"strftime(make_timestamp(CAST({dint(du(name, key, seed), lo, hi)} AS BIGINT) * 1000000), '%Y-%m-%d')"
    return drule(rule, name, key, seed)


def _add_user_graph_oracles():
    from .user_graphs import ORG_CHART, SUPPLY_CHAIN
    O = ORACLE
    gs = f"{SEED}/org_chart"

    def props(spec_nodes, label, table, key, gseed):
        ns = next(n for n in spec_nodes if n["label"] == label)
        cols = ", ".join(f"{drule_full(p['generator_rule'], p['name'], key, f'({key} + 1)', f'{gseed}/{label}')} "
                         f"AS {p['name']}" for p in ns["properties"])
        return f"(SELECT {key} AS ord, {cols} FROM {table})"

    emp = props(ORG_CHART["nodes"], "Employee", "customer", "c_custkey", gs)
    office = props(ORG_CHART["nodes"], "Office", "range(8) t(r)", "r", gs)
    project = props(ORG_CHART["nodes"], "Project", "range(30) t(r)", "r", gs)
    ncust = "(SELECT count(*) FROM customer)"
    works = dbern("customer", "c_custkey", "8", 0.2, "WORKS_IN", gs, max_per_source=1)
    O["graph_h15_office_headcount"] = (
        f"SELECT o.city AS office, count(*) AS employees, "
        f"array_to_string(list_sort(list_distinct(list(e.department))), ',') AS departments "
        f"FROM {works} w JOIN {emp} e ON e.ord = w.src JOIN {office} o ON o.ord = w.dst_ord GROUP BY o.city")
    O["graph_h19_employee_export"] = (
        f"SELECT e.emp_id, e.name, e.department, e.title, e.salary, e.hire_date, e.remote, o.city AS office_city "
        f"FROM {emp} e LEFT JOIN {works} w ON w.src = e.ord LEFT JOIN {office} o ON o.ord = w.dst_ord")
    assigned = dbern("customer", "c_custkey", "30", 0.02, "ASSIGNED_TO", gs)
    role = drule_full({"generator": "choice", "values": ["lead", "contributor", "reviewer"]}, "role",
                      "CAST(a.src AS VARCHAR) || '>' || CAST(a.dst_ord AS VARCHAR)", "1", f"{gs}/ASSIGNED_TO")
    O["graph_h17_project_staffing"] = (
        f"SELECT p.name AS project, p.status, p.budget, count(*) AS team_size, "
        f"array_to_string(list_sort(list_distinct(list({role}))), ',') AS roles "
        f"FROM {assigned} a JOIN {project} p ON p.ord = a.dst_ord GROUP BY p.name, p.status, p.budget")
    reports = dbern("customer", "c_custkey", ncust, 0.004, "REPORTS_TO", gs, no_self=True, max_per_source=1)
    O["graph_h16_reporting_chains"] = (
        f"WITH RECURSIVE r AS {reports}, "
        f"p(start, cur, depth, used) AS (SELECT src, dst_ord, 1, [src || '>' || dst_ord] FROM r "
        f"UNION ALL SELECT p.start, r.dst_ord, p.depth + 1, list_append(p.used, r.src || '>' || r.dst_ord) "
        f"FROM p JOIN r ON r.src = p.cur WHERE p.depth < 4 AND NOT list_contains(p.used, r.src || '>' || r.dst_ord)) "
        f"SELECT a.name AS employee, a.title, p.depth AS chain_depth, b.name AS reports_to, b.title AS manager_title "
        f"FROM p JOIN {emp} a ON a.ord = p.start JOIN {emp} b ON b.ord = p.cur "
        f"ORDER BY chain_depth DESC, p.start, reports_to LIMIT 20")
    ss = f"{SEED}/supply_chain"
    supp = props(SUPPLY_CHAIN["nodes"], "Supplier", "supplier", "s_suppkey", ss)
    wh = props(SUPPLY_CHAIN["nodes"], "Warehouse", "range(20) t(r)", "r", ss)
    prod = props(SUPPLY_CHAIN["nodes"], "Product", "part", "p_partkey", ss)
    supplies = dbern("supplier", "s_suppkey", "(SELECT count(*) FROM part)", 0.02, "SUPPLIES", ss)
    stored = dbern("part", "p_partkey", "20", 0.05, "STORED_IN", ss)
    price = drule_full({"generator": "range_float", "min": 1.0, "max": 5000.0}, "contract_price",
                       "CAST(s.src AS VARCHAR) || '>' || CAST(s.dst_ord AS VARCHAR)", "1", f"{ss}/SUPPLIES")
    qty = drule_full({"generator": "range_int", "min": 10, "max": 10000}, "quantity",
                     "CAST(st.src AS VARCHAR) || '>' || CAST(st.dst_ord AS VARCHAR)", "1", f"{ss}/STORED_IN")
    O["graph_h18_supply_chain"] = (
        f"SELECT su.name AS supplier, su.country, su.reliability_score AS reliability, pr.sku, pr.category, "
        f"{price} AS price, w.location AS warehouse, {qty} AS stock FROM {supplies} s "
        f"JOIN {supp} su ON su.ord = s.src JOIN {prod} pr ON pr.ord = s.dst_ord "
        f"JOIN {stored} st ON st.src = s.dst_ord JOIN {wh} w ON w.ord = st.dst_ord "
        f"ORDER BY stock DESC, sku, supplier, warehouse, price LIMIT 25")


_add_user_graph_oracles()


def _add_more_graph_export_oracles():
    from ..functions import pools
    from . import graphs as GR
    O = ORACLE
    npart, nnation, nsupp = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM nation)", "(SELECT count(*) FROM supplier)"
    ncust, nord = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM orders)"
    # procurement nodes
    pa, pv, ct, lb = f"{SEED}/ProcAgency", f"{SEED}/ProcVendor", f"{SEED}/Contract", f"{SEED}/Lobbyist"
    agency = (f"(SELECT n_nationkey AS ord, concat({dspec(GR._pick('_city', pools.CITIES), 'n_nationkey', pa)}, ' ', "
              f"{dlist(GR.PROC_AGENCY_NAMES, f'n_nationkey % {len(GR.PROC_AGENCY_NAMES)}')}) AS agency FROM nation)")
    vendor = (f"(SELECT s_suppkey AS ord, concat('PVND-', lpad(CAST(s_suppkey + 1 AS VARCHAR), 4, '0')) AS vendor_id, "
              f"concat_ws(' ', {dspec(GR._pick('_last', pools.LAST_NAMES), 's_suppkey', pv)}, "
              f"{dspec(GR._pick('_kind', GR.PROC_VENDOR_KINDS), 's_suppkey', pv)}, "
              f"{dspec(GR._pick('_suffix', GR.PROC_VENDOR_SUFFIXES), 's_suppkey', pv)}) AS vendor FROM supplier)")
    contract = (f"(SELECT p_partkey AS ord, concat('CTR-', lpad(CAST(p_partkey + 1 AS VARCHAR), 5, '0')) AS contract_id, "
                f"{dspec(GR._rng('amount', 'decimal(14,2)', 5000, 25000000), 'p_partkey', ct)} AS amount, "
                f"{dspec(GR._pick('method', GR.METHODS, GR.METHOD_WEIGHTS), 'p_partkey', ct)} AS method, "
                f"{dspec(GR._pick('category', GR.COMMODITY_CATEGORIES), 'p_partkey', ct)} AS category FROM part)")
    lobby = (f"(SELECT s_suppkey AS ord, concat('LOB-', lpad(CAST(s_suppkey + 1 AS VARCHAR), 4, '0')) AS lobbyist_id, "
             f"{dspec(GR._person('name'), 's_suppkey', lb)} AS lobbyist, "
             f"concat({dspec(GR._pick('_l1', pools.LAST_NAMES), 's_suppkey', lb)}, ' & ', "
             f"{dspec(GR._pick('_l2', pools.LAST_NAMES), 's_suppkey', lb)}, ' ', "
             f"{dspec(GR._pick('_fk', GR.FIRM_KINDS), 's_suppkey', lb)}) AS firm FROM supplier)")
    aw = dk_targets("part", "p_partkey", "AWARDED_TO", nsupp, 1, 1)
    rep = dbern("supplier", "s_suppkey", nsupp, 0.02, "REPRESENTS")
    iss = dpairs("part", "p_partkey", nnation, npart, "ISSUED")
    O["graph_h11_lobbyist_trail"] = (
        f"SELECT l.lobbyist, l.firm, v.vendor, ag.agency, CAST(c.amount AS DOUBLE) AS contract_value, "
        f"c.method AS procurement_method FROM {rep} r JOIN {lobby} l ON l.ord = r.src "
        f"JOIN {vendor} v ON v.ord = r.dst_ord JOIN {aw} a ON a.dst_ord = r.dst_ord "
        f"JOIN {contract} c ON c.ord = a.src JOIN {iss} i ON i.b_ord = a.src JOIN {agency} ag ON ag.ord = i.a_ord "
        f"ORDER BY contract_value DESC, lobbyist, firm, vendor, agency, procurement_method LIMIT 20")
    # case management export
    cs, cw, ha, cl = f"{SEED}/Case", f"{SEED}/Caseworker", f"{SEED}/HHSAgency", f"{SEED}/Client"
    hc = dpairs("orders", "o_orderkey", ncust, nord, "HAS_CASE")
    det = dspec(GR._pick("determination", ["approved", "denied", "pending", "deferred", "conditional"],
                         [5, 2, 2, 1, 1]), "o_orderkey", cs)
    case = (f"(SELECT o_orderkey AS ord, concat('CASE-', lpad(CAST(o_orderkey + 1 AS VARCHAR), 6, '0')) AS case_id, "
            f"{dspec(GR._pick('status', ['open', 'under_review', 'approved', 'denied', 'closed', 'appealed'], [3, 2, 4, 2, 3, 1]), 'o_orderkey', cs)} AS status, "
            f"{dspec(GR._rng('benefit_amount', 'decimal(10,2)', 0, 15000), 'o_orderkey', cs)} AS benefit_amount, "
            f"{det} AS determination FROM orders)")
    client = (f"(SELECT c_custkey AS ord, concat('CLT-', lpad(CAST(c_custkey + 1 AS VARCHAR), 5, '0')) AS client_id, "
              f"{dspec(GR._person('name'), 'c_custkey', cl)} AS client_name FROM customer)")
    worker = (f"(SELECT s_suppkey AS ord, concat('CW-', lpad(CAST(s_suppkey + 1 AS VARCHAR), 4, '0')) AS caseworker_id, "
              f"{dspec(GR._person('name'), 's_suppkey', cw)} AS caseworker, "
              f"{dhash('agency_id#1', 's_suppkey', cw)} % {nnation} AS ag FROM supplier)")
    hagency = (f"(SELECT n_nationkey AS ord, concat('HHS-', lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0')) AS agency_id, "
               f"concat({dspec(GR._pick('_city', pools.CITIES), 'n_nationkey', ha)}, ' ', "
               f"{dspec(GR._pick('_kind', GR.HHS_AGENCY_NAMES), 'n_nationkey', ha)}) AS agency FROM nation)")
    mb = dk_targets("orders", "o_orderkey", "MANAGED_BY", nsupp, 1, 1)
    approved = f"(SELECT o_orderkey FROM orders WHERE {det} = 'approved')"
    enr = dk_targets(approved, "o_orderkey", "ENROLLED_IN", str(len(GR.HHS_PROGRAMS)), 1, 2)
    # citizen services export: request x department? x (asset, district)?
    sr, asr = f"{SEED}/ServiceRequest", f"{SEED}/Asset"
    req = (f"(SELECT o_orderkey AS ord, concat('SR-', lpad(CAST(o_orderkey + 1 AS VARCHAR), 6, '0')) AS request_id, "
           f"{dspec(GR._pick('type', GR.REQUEST_TYPES), 'o_orderkey', sr)} AS type, "
           f"{dspec(GR._pick('status', ['opened', 'assigned', 'in_progress', 'pending_review', 'resolved', 'closed', 'reopened'], [2, 2, 3, 1, 4, 5, 1]), 'o_orderkey', sr)} AS status, "
           f"{dspec(GR._pick('priority', ['critical', 'high', 'medium', 'low'], [1, 2, 4, 3]), 'o_orderkey', sr)} AS priority FROM orders)")
    asg = dk_targets("orders", "o_orderkey", "ASSIGNED_TO", str(len(GR.SERVICE_DEPARTMENTS)), 1, 1)
    keep = f"(SELECT o_orderkey FROM orders WHERE {du('AFFECTS#keep', 'o_orderkey')} < 0.3)"
    aff = dk_targets(keep, "o_orderkey", "AFFECTS", npart, 1, 1)
    asset = (f"(SELECT p_partkey AS ord, concat('AST-', lpad(CAST(p_partkey + 1 AS VARCHAR), 5, '0')) AS asset_id, "
             f"{dspec(GR._pick('type', GR.ASSET_TYPES), 'p_partkey', asr)} AS asset_type, "
             f"{dspec(GR._rng('_dist', 'int', 1, 15), 'p_partkey', asr)} AS dist FROM part)")
    O["graph_h27_export_citizen_services"] = (
        f"SELECT r.request_id, r.type, r.status, r.priority, "
        f"concat('SDEPT-', lpad(CAST(a.dst_ord + 1 AS VARCHAR), 2, '0')) AS dept_id, "
        f"{dlist(GR.SERVICE_DEPARTMENTS, 'a.dst_ord')} AS department, x.asset_id, "
        f"'DIST-' || lpad(CAST(x.dist AS VARCHAR), 2, '0') AS district_id, "
        f"CASE WHEN x.asset_id IS NOT NULL THEN concat('District ', CAST(x.dist AS VARCHAR)) END AS district, "
        f"x.asset_type FROM {req} r LEFT JOIN {asg} a ON a.src = r.ord "
        f"LEFT JOIN (SELECT f.src AS req_ord, s.* FROM {aff} f JOIN {asset} s ON s.ord = f.dst_ord) x "
        f"ON x.req_ord = r.ord")


_add_more_graph_export_oracles()


def _add_full_export_oracles():
    """The eight graph exports with their full column lists."""
    from ..functions import pools
    from . import graphs as GR
    O = ORACLE

    def node(label: str, table: str, key: str, prefix: str, width: int, id_name: str, cols: dict[str, str]) -> str:
        seed = f"{SEED}/{label}"
        sel = ", ".join(f"{(v if isinstance(v, str) else dspec(v, key, seed))} AS {n}" for n, v in cols.items())
        return (f"(SELECT {key} AS ord, concat('{prefix}', lpad(CAST({key} + 1 AS VARCHAR), {width}, '0')) AS {id_name}, "
                f"{sel} FROM {table})")

    def text(label: str, key: str, *parts) -> str:
        return "concat(" + ", ".join(f"'{p}'" if isinstance(p, str) else f"CAST({dspec(p, key, f'{SEED}/{label}')} AS VARCHAR)"
                                     for p in parts) + ")"

    P, R, Fl = GR._pick, GR._rng, GR._flag
    ncust, nord, npart = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM orders)", "(SELECT count(*) FROM part)"
    nnation, nsupp = "(SELECT count(*) FROM nation)", "(SELECT count(*) FROM supplier)"
    student = node("Student", "customer", "c_custkey", "STU-", 6, "student_id", {
        "student_name": GR._person("name"), "gpa": R("gpa", "decimal(3,2)", 1.5, 4.0),
        "campus": P("campus", ["Main", "North", "Online", "Downtown", "West"]),
        "status": P("status", ["active", "graduated", "on_leave", "suspended", "withdrawn"], [60, 15, 10, 5, 10])})
    cs = f"{SEED}/Course"
    number = (f"CAST({dspec(P('_lvl', GR.COURSE_LEVELS, type_='int'), 'p_partkey', cs)} + "
              f"{dspec(R('_off', 'int', 0, 9), 'p_partkey', cs)} AS VARCHAR)")
    course = node("Course", "part", "p_partkey", "CRS-", 4, "course_id", {
        "course_name": f"concat({dspec(P('_prefix', GR.COURSE_PREFIXES), 'p_partkey', cs)}, ' ', "
                       f"{dlist(GR.DEPARTMENTS, 'p_partkey % 18')}, ' ', lpad({number}, 3, '0'))",
        "course_level": P("level", [100, 200, 300, 400, 500, 600], type_="int"), "credits": P("credits", [1, 2, 3, 3, 3, 4, 4], type_="int"),
        "department": dlist(GR.DEPARTMENTS, "p_partkey % 18"), "college": dlist(GR.COLLEGES, "(p_partkey % 18) % 6")})
    enr = dk_targets("customer", "c_custkey", "ENROLLED_IN", npart, 2, 5)
    O["graph_h23_export_enrolment"] = (
        f"SELECT s.student_id, student_name, gpa, campus, status, course_id, course_name, CAST(course_level AS INTEGER) AS course_level, "
        f"CAST(credits AS INTEGER) AS credits, department, college FROM {enr} e JOIN {student} s ON s.ord = e.src "
        f"JOIN {course} c ON c.ord = e.dst_ord")
    pur = dk_targets("customer", "c_custkey", "PURSUING", "45", 1, 1)
    O["graph_h24_export_degree_pathways"] = (
        f"SELECT s.student_id, s.student_name, concat('PGM-', lpad(CAST(p.dst_ord + 1 AS VARCHAR), 3, '0')) AS program_id, "
        f"{dlist(GR.DEGREE_TYPES, 'p.dst_ord % 10')} AS degree_type, "
        f"concat({dlist(GR.DEPARTMENTS, 'p.dst_ord % 18')}, ' ', {dlist(GR.DEGREE_TYPES, 'p.dst_ord % 10')}) AS program_name, "
        f"{dlist(GR.DEPARTMENTS, 'p.dst_ord % 18')} AS department, "
        f"{dpick(du('PURSUING#start_semester', 'p.src'), GR.START_SEMESTERS)} AS start_semester, "
        f"{dpick(du('PURSUING#grad', 'p.src'), GR.GRADUATIONS)} AS expected_graduation "
        f"FROM {pur} p JOIN {student} s ON s.ord = p.src")
    events = dtable("enrollment_events", ["student_id", "course_id", "semester", "grade"])
    order = ("(CAST(regexp_extract({s}, '([0-9]{{4}})', 1) AS INTEGER) * 10 + CASE left({s}, 3) WHEN 'Spr' THEN 1 WHEN 'Sum' THEN 2 ELSE 3 END)")
    O["graph_h20_failed_then_retaken"] = (
        f"SELECT s.student_name AS student, c.course_name AS course, a.semester AS failed_semester, b.semester AS retake_semester, "
        f"b.grade AS retake_grade FROM {events} a JOIN {events} b USING (student_id, course_id) JOIN {student} s USING (student_id) "
        f"JOIN {course} c USING (course_id) WHERE a.grade = 'F' AND {order.format(s='b.semester')} > {order.format(s='a.semester')}")
    fund = node("FundingSource", "nation", "n_nationkey", "FUND-", 3, "fund_id", {
        "fund_name": text("FundingSource", "n_nationkey", P("_prog", GR.FEDERAL_PROGRAMS), " - FY", P("_fy", [2023, 2024, 2025, 2026], type_="int")),
        "fund_category": P("category", GR.FUND_CATEGORIES), "total_budget": R("total_budget", "decimal(14,2)", 50000, 50000000)})
    agency = node("Agency", "nation", "n_nationkey", "AGY-", 3, "agency_id", {
        "agency_name": text("Agency", "n_nationkey", P("_city", pools.CITIES), " ", P("_kind", GR.GRANT_AGENCY_TYPES)),
        "agency_type": P("type", GR.GRANT_AGENCY_TYPES)})
    program = node("Program", "part", "p_partkey", "PGM-", 4, "program_id", {
        "program_name": text("Program", "p_partkey", P("_pname", GR.PROGRAM_NAMES), " Phase ", R("_phase", "int", 1, 5)),
        "program_budget": R("budget_allocated", "decimal(12,2)", 10000, 5000000)})
    amount = dint(du("FUNDS#amount", "CAST(f.src AS VARCHAR) || ':' || CAST(f.dst_ord AS VARCHAR)"), 0, 4999999)
    O["graph_h25_export_fund_flows"] = (
        f"SELECT fund_id, fund_name, fund_category, total_budget, agency_id, agency_name, agency_type, program_id, program_name, "
        f"program_budget, {amount} AS funded_amount FROM {dbern('nation', 'n_nationkey', nnation, 0.3, 'FUNDS')} f "
        f"JOIN {fund} fs ON fs.ord = f.src JOIN {agency} a ON a.ord = f.dst_ord "
        f"JOIN {dbern('nation', 'n_nationkey', npart, 0.15, 'MANAGES')} m ON m.src = f.dst_ord JOIN {program} p ON p.ord = m.dst_ord")
    vendor = node("Vendor", "supplier", "s_suppkey", "VND-", 4, "vendor_id", {
        "name": text("Vendor", "s_suppkey", P("_last", pools.LAST_NAMES), " ", P("_kind", GR.VENDOR_TYPES), " ", P("_suffix", GR.VENDOR_SUFFIXES)),
        "state": P("state", pools.STATES)})
    pct = dint(du("SUBCONTRACTS#pct", "CAST(e.src AS VARCHAR) || ':' || CAST(e.dst_ord AS VARCHAR)"), 5, 44)
    O["graph_h26_export_vendor_subcontracts"] = (
        f"SELECT a.vendor_id AS prime_vendor_id, a.name AS prime_vendor, a.state AS prime_state, b.vendor_id AS sub_vendor_id, "
        f"b.name AS subcontractor, b.state AS sub_state, {pct} AS subcontract_pct "
        f"FROM {dbern('supplier', 's_suppkey', nsupp, 0.008, 'SUBCONTRACTS', no_self=True)} e "
        f"JOIN {vendor} a ON a.ord = e.src JOIN {vendor} b ON b.ord = e.dst_ord")
    citizen = node("Citizen", "customer", "c_custkey", "CIT-", 5, "citizen_id", {"citizen_name": GR._person("name")})
    asset = node("Asset", "part", "p_partkey", "AST-", 5, "asset_id", {"asset_condition": P("condition", ["good", "fair", "poor", "critical"], [4, 3, 2, 1])})
    old = O["graph_h27_export_citizen_services"]
    O["graph_h27_export_citizen_services"] = (
        f"SELECT o.request_id, o.type AS request_type, o.status, o.priority, c.citizen_id, c.citizen_name, o.department, o.asset_id, "
        f"o.asset_type, s.asset_condition, o.district FROM {dpairs('orders', 'o_orderkey', ncust, nord, 'SUBMITTED')} p "
        f"JOIN {citizen} c ON c.ord = p.a_ord JOIN ({old}) o ON o.request_id = concat('SR-', lpad(CAST(p.b_ord + 1 AS VARCHAR), 6, '0')) "
        f"LEFT JOIN {asset} s ON s.asset_id = o.asset_id")
    k12 = node("K12Student", "customer", "c_custkey", "K12-", 5, "student_id", {
        "student_name": GR._person("name"), "grade_level": R("grade_level", "int", 1, 12), "risk_score": R("risk_score", "decimal(5,1)", 0, 100),
        "attendance_rate": R("attendance_rate", "decimal(5,1)", 60, 100), "gpa": R("gpa", "decimal(3,2)", 0.5, 4.0),
        "frl": Fl("free_reduced_lunch", 0.45), "ell": Fl("english_learner", 0.15), "sped": Fl("special_education", 0.13)})
    kind = dspec(P("_kind", ["Elementary", "Middle", "High"]), "n_nationkey", f"{SEED}/School")
    school = node("School", "nation", "n_nationkey", "SCH-", 3, "school_id", {
        "school_name": f"concat({dlist(GR.SCHOOL_PREFIXES, f'n_nationkey % {len(GR.SCHOOL_PREFIXES)}')}, ' ', {kind}, ' School')",
        "school_type": P("type", ["elementary", "middle", "high"], [5, 3, 2]), "title_i": Fl("title_i", 0.55)})
    interv = node("Intervention", "part", "p_partkey", "INT-", 5, "intervention_id", {
        "intervention_type": P("type", GR.INTERVENTION_TYPES), "intervention_status": P("status", ["active", "completed", "discontinued", "pending"], [4, 3, 2, 1]),
        "effectiveness": P("effectiveness", ["highly_effective", "effective", "moderate", "ineffective", "too_early"], [1, 3, 3, 2, 2])})
    received = dk_targets(f"(SELECT ord FROM {k12} x WHERE risk_score > 40)", "ord", "RECEIVED", npart, 1, 2)
    O["graph_h28_export_early_warning"] = (
        f"SELECT k.student_id, student_name, CAST(grade_level AS INTEGER) AS grade_level, risk_score, attendance_rate, gpa, frl, ell, sped, "
        f"school_id, school_name, school_type, title_i, intervention_id, intervention_type, intervention_status, effectiveness FROM {k12} k "
        f"JOIN {dk_targets('customer', 'c_custkey', 'ATTENDS', nnation, 1, 1)} a ON a.src = k.ord JOIN {school} sc ON sc.ord = a.dst_ord "
        f"LEFT JOIN ({received} r JOIN {interv} i ON i.ord = r.dst_ord) ON r.src = k.ord")
    pagency = node("ProcAgency", "nation", "n_nationkey", "PAGY-", 3, "agency_id", {
        "agency_name": f"concat({dspec(P('_city', pools.CITIES), 'n_nationkey', f'{SEED}/ProcAgency')}, ' ', "
                       f"{dlist(GR.PROC_AGENCY_NAMES, f'n_nationkey % {len(GR.PROC_AGENCY_NAMES)}')})"})
    pvendor = node("ProcVendor", "supplier", "s_suppkey", "PVND-", 4, "vendor_id", {
        "vendor_name": text("ProcVendor", "s_suppkey", P("_last", pools.LAST_NAMES), " ", P("_kind", GR.PROC_VENDOR_KINDS), " ", P("_suffix", GR.PROC_VENDOR_SUFFIXES)),
        "mbe": Fl("minority_owned", 0.18), "sbe": Fl("small_business", 0.35), "wbe": Fl("woman_owned", 0.15)})
    contract = node("Contract", "part", "p_partkey", "CTR-", 5, "contract_id", {
        "contract_title": text("Contract", "p_partkey", P("_what", GR.COMMODITY_CATEGORIES), " - ",
                               P("_unit", ["Phase", "Project", "Program", "Initiative", "Contract"]), " ", R("_number", "int", 1, 999)),
        "amount": R("amount", "decimal(14,2)", 5000, 25000000), "procurement_method": P("method", GR.METHODS, GR.METHOD_WEIGHTS),
        "category": P("category", GR.COMMODITY_CATEGORIES),
        "contract_status": P("status", ["active", "completed", "pending", "terminated", "expired"], [4, 3, 1, 1, 1])})
    lobby = node("Lobbyist", "supplier", "s_suppkey", "LOB-", 4, "lobbyist_id", {
        "lobbyist_name": GR._person("name"),
        "lobbyist_firm": text("Lobbyist", "s_suppkey", P("_l1", pools.LAST_NAMES), " & ", P("_l2", pools.LAST_NAMES), " ", P("_fk", GR.FIRM_KINDS))})
    O["graph_h29_export_procurement"] = (
        f"SELECT agency_id, agency_name, contract_id, contract_title, amount, procurement_method, category, contract_status, v.vendor_id, "
        f"vendor_name, mbe, sbe, wbe, lobbyist_name, lobbyist_firm FROM {dpairs('part', 'p_partkey', nnation, npart, 'ISSUED')} i "
        f"JOIN {pagency} ag ON ag.ord = i.a_ord JOIN {contract} c ON c.ord = i.b_ord "
        f"JOIN {dk_targets('part', 'p_partkey', 'AWARDED_TO', nsupp, 1, 1)} aw ON aw.src = i.b_ord JOIN {pvendor} v ON v.ord = aw.dst_ord "
        f"LEFT JOIN ({dbern('supplier', 's_suppkey', nsupp, 0.02, 'REPRESENTS')} r JOIN {lobby} l ON l.ord = r.src) ON r.dst_ord = aw.dst_ord")
    client = node("Client", "customer", "c_custkey", "CLT-", 5, "client_id", {
        "client_name": GR._person("name"), "income_bracket": P("income_bracket", ["below_poverty", "low_income", "moderate_income"], [4, 4, 2]),
        "household_size": P("household_size", [1, 2, 3, 4, 5, 6, 7, 8], [15, 25, 20, 20, 10, 5, 3, 2], "int")})
    outcome = P("determination", ["approved", "denied", "pending", "deferred", "conditional"], [5, 2, 2, 1, 1])
    case = node("Case", "orders", "o_orderkey", "CASE-", 6, "case_id", {
        "case_status": P("status", ["open", "under_review", "approved", "denied", "closed", "appealed"], [3, 2, 4, 2, 3, 1]),
        "priority": P("priority", ["emergency", "urgent", "standard", "low"], [1, 2, 5, 2]), "determination": outcome,
        "benefit_amount": R("benefit_amount", "decimal(10,2)", 0, 15000)})
    worker = node("Caseworker", "supplier", "s_suppkey", "CW-", 4, "caseworker_id", {
        "caseworker_name": GR._person("name"), "specialization": P("specialization", GR.SPECIALIZATIONS),
        "ag": f"{dhash('agency_id#1', 's_suppkey', f'{SEED}/Caseworker')} % {nnation}"})
    hagency = node("HHSAgency", "nation", "n_nationkey", "HHS-", 3, "agency_id", {
        "agency_name": text("HHSAgency", "n_nationkey", P("_city", pools.CITIES), " ", P("_kind", GR.HHS_AGENCY_NAMES))})
    approved = f"(SELECT ord FROM {case} y WHERE determination = 'approved')"
    O["graph_h30_export_case_management"] = (
        f"SELECT client_id, client_name, income_bracket, CAST(household_size AS INTEGER) AS household_size, c.case_id, case_status, priority, "
        f"determination, benefit_amount, caseworker_id, caseworker_name, specialization, agency_name, {dlist(GR.HHS_PROGRAMS, 'e.dst_ord')} AS program_name "
        f"FROM {dpairs('orders', 'o_orderkey', ncust, nord, 'HAS_CASE')} h JOIN {client} cl ON cl.ord = h.a_ord JOIN {case} c ON c.ord = h.b_ord "
        f"JOIN {dk_targets('orders', 'o_orderkey', 'MANAGED_BY', nsupp, 1, 1)} m ON m.src = h.b_ord JOIN {worker} w ON w.ord = m.dst_ord "
        f"JOIN {hagency} ag ON ag.ord = w.ag LEFT JOIN {dk_targets(approved, 'ord', 'ENROLLED_IN', str(len(GR.HHS_PROGRAMS)), 1, 2)} e ON e.src = h.b_ord")


_add_full_export_oracles()


def _add_traversal_oracles():
    from . import graphs as GR
    O = ORACLE
    nsupp = "(SELECT count(*) FROM supplier)"
    sub = dbern("supplier", "s_suppkey", nsupp, 0.008, "SUBCONTRACTS", no_self=True)
    ids = ("(SELECT DISTINCT 'VND-' || lpad(CAST(src + 1 AS VARCHAR), 4, '0') AS src, "
           f"'VND-' || lpad(CAST(dst_ord + 1 AS VARCHAR), 4, '0') AS dst FROM {sub} x)")
    O["graph_h32_subcontract_closure"] = (
        f"WITH RECURSIVE e AS {ids}, "
        f"s AS (SELECT src FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), "
        f"r(node, depth) AS (SELECT src, 0 FROM s UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node "
        f"WHERE r.depth < (SELECT count(DISTINCT src) FROM e)) "
        f"SELECT (SELECT src FROM s) AS prime_vendor, node AS vendor_id, min(depth) AS depth FROM r "
        f"WHERE node <> (SELECT src FROM s) GROUP BY node")


_add_traversal_oracles()


def _add_type_count_oracle():
    from ..functions import pools
    from . import graphs as GR
    npart, nnation, nsupp = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM nation)", "(SELECT count(*) FROM supplier)"
    ncust, nord = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM orders)"

    def cnt(sub: str) -> str:
        return f"(SELECT count(*) FROM {sub} x)"

    # REQUIRES: courses of level >= 200 with a lower level present, kept with probability 0.6
    cs = f"{SEED}/Course"
    lvl = f"CAST({dspec(GR._pick('level', GR.COURSE_LEVELS, type_='int'), 'p_partkey', cs)} AS INTEGER)"
    cid = "concat('CRS-', lpad(CAST(p_partkey + 1 AS VARCHAR), 4, '0'))"
    requires = (f"(SELECT count(*) FROM (SELECT {cid} AS course_id, {lvl} AS level FROM part) c "
                f"WHERE level >= 200 AND {du('REQUIRES#pick', 'course_id')} < 0.6 "
                f"AND EXISTS (SELECT 1 FROM part p2 WHERE {lvl.replace('p_partkey', 'p2.p_partkey')} < c.level))")
    # TAUGHT_BY: min(3, teachers of the student's school) per student whose school has teachers
    tseed = f"{SEED}/Teacher"
    tschool = f"({dhash('school_id#1', 's_suppkey', tseed)} % {nnation})"
    per_school = f"(SELECT {tschool} AS sch, count(*) AS n FROM supplier GROUP BY 1)"
    attends = dk_targets("customer", "c_custkey", "ATTENDS", nnation, 1, 1)
    taught = f"(SELECT sum(least(3, ps.n)) FROM {attends} a JOIN {per_school} ps ON ps.sch = a.dst_ord)"
    # RECEIVED: risky students, 1..2 interventions each
    ks = f"{SEED}/K12Student"
    risk = dspec(GR._rng("risk_score", "decimal(5,1)", 0, 100), "c_custkey", ks)
    received = dk_targets(f"(SELECT c_custkey FROM customer WHERE {risk} > 40)", "c_custkey", "RECEIVED", npart, 1, 2)
    # ENROLLED_IN (benefits): approved cases, 1..2 programs
    det = dspec(GR._pick("determination", ["approved", "denied", "pending", "deferred", "conditional"],
                         [5, 2, 2, 1, 1]), "o_orderkey", f"{SEED}/Case")
    case_enr = dk_targets(f"(SELECT o_orderkey FROM orders WHERE {det} = 'approved')", "o_orderkey", "ENROLLED_IN",
                          str(len(GR.HHS_PROGRAMS)), 1, 2)
    # REFERRED: Bernoulli 0.003 inside each county block, no self pairs (block ordinals)
    cl = f"{SEED}/Client"
    county = f"concat({dspec(GR._pick('_city', pools.CITIES), 'c_custkey', cl)}, ' County')"
    blocks = (f"(SELECT c_custkey, row_number() OVER (PARTITION BY county ORDER BY c_custkey) - 1 AS bo, "
              f"count(*) OVER (PARTITION BY county) AS bn FROM (SELECT c_custkey, {county} AS county FROM customer) z)")
    referred = dbern(blocks, "c_custkey", "bn", 0.003, "REFERRED", self_col="bo")
    keep = f"(SELECT o_orderkey FROM orders WHERE {du('AFFECTS#keep', 'o_orderkey')} < 0.3)"
    rows = {
        "student_enrollment": [("OFFERED_BY", f"(45 + {npart})"), ("REQUIRES", requires), ("PURSUING", ncust),
                               ("ENROLLED_IN", cnt(dk_targets("customer", "c_custkey", "ENROLLED_IN", npart, 2, 5)))],
        "grant_budget": [("FUNDS", cnt(dbern("nation", "n_nationkey", nnation, 0.3, "FUNDS"))),
                         ("MANAGES", cnt(dbern("nation", "n_nationkey", npart, 0.15, "MANAGES"))),
                         ("AWARDS", cnt(dbern("part", "p_partkey", nsupp, 0.05, "AWARDS"))),
                         ("SUBCONTRACTS", cnt(dbern("supplier", "s_suppkey", nsupp, 0.008, "SUBCONTRACTS",
                                                    no_self=True))),
                         ("HAS_LINE_ITEM", nord)],
        "citizen_services": [("IN_DISTRICT", npart), ("SUBMITTED", nord), ("ASSIGNED_TO", nord),
                             ("AFFECTS", cnt(keep))],
        "k12_early_warning": [("WORKS_AT", nsupp), ("ATTENDS", ncust), ("TAUGHT_BY", taught),
                              ("TARGETS", cnt(dbern("part", "p_partkey", str(len(GR.RISK_INDICATORS)), 0.15,
                                                    "TARGETS"))),
                              ("RECEIVED", cnt(received))],
        "procurement": [("ISSUED", npart), ("AWARDED_TO", npart),
                        ("SUBCONTRACTS_TO", cnt(dbern("supplier", "s_suppkey", nsupp, 0.005, "SUBCONTRACTS_TO",
                                                      no_self=True))),
                        ("REPRESENTS", cnt(dbern("supplier", "s_suppkey", nsupp, 0.02, "REPRESENTS")))],
        "case_management": [("WORKS_AT", nsupp),
                            ("ADMINISTERS", cnt(dbern("nation", "n_nationkey", str(len(GR.HHS_PROGRAMS)), 0.25,
                                                      "ADMINISTERS"))),
                            ("HAS_CASE", nord), ("MANAGED_BY", nord), ("ENROLLED_IN", cnt(case_enr)),
                            ("REFERRED", cnt(referred))],
    }
    parts = [f"SELECT '{t}' AS relationship_type, CAST({n} AS BIGINT) AS count, '{g}' AS graph"
             for g, items in rows.items() for t, n in items]
    ORACLE["graph_h14_type_counts"] = " UNION ALL ".join(parts)


_add_type_count_oracle()


def _add_components_oracle():
    ncust, nord, nsupp = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM orders)", "(SELECT count(*) FROM supplier)"
    hc = dpairs("orders", "o_orderkey", ncust, nord, "HAS_CASE")
    mb = dk_targets("orders", "o_orderkey", "MANAGED_BY", nsupp, 1, 1)
    ORACLE["graph_h33_caseworker_communities"] = (
        f"WITH RECURSIVE links AS (SELECT DISTINCT h.a_ord AS client, m.dst_ord AS cw FROM {hc} h "
        f"JOIN {mb} m ON m.src = h.b_ord), "
        f"cc AS (SELECT DISTINCT a.cw AS x, b.cw AS y FROM links a JOIN links b USING (client)), "
        f"r(start, node) AS (SELECT x, y FROM cc UNION SELECT r.start, cc.y FROM r JOIN cc ON cc.x = r.node), "
        f"comp AS (SELECT start, min(node) AS component FROM r GROUP BY start) "
        f"SELECT caseworkers, count(*) AS communities FROM "
        f"(SELECT component, count(*) AS caseworkers FROM comp GROUP BY component) GROUP BY caseworkers")


_add_components_oracle()


def _add_sample_rows_oracle():
    from datetime import datetime, timezone

    from ..functions import pools

    def ep(s):
        return int(datetime.fromisoformat(s).replace(tzinfo=timezone.utc).timestamp())

    seed, k = f"{SEED}/sample", "doc_id"
    m = f"md5(concat_ws(':', '{seed}', 'uuid', CAST(doc_id AS VARCHAR)))"
    uuid = (f"concat_ws('-', substr({m}, 1, 8), substr({m}, 9, 4), '4' || substr({m}, 14, 3), "
            f"substr('89ab', CAST(('0x' || substr({m}, 17, 1))::INTEGER % 4 + 1 AS INTEGER), 1) || substr({m}, 18, 3), "
            f"substr({m}, 21, 12))")
    phone = (f"'(' || CAST({dint(du('phone_number#a', k, seed), 200, 999)} AS VARCHAR) || ') ' || "
             f"CAST({dint(du('phone_number#b', k, seed), 200, 999)} AS VARCHAR) || '-' || "
             f"CAST({dint(du('phone_number#c', k, seed), 1000, 9999)} AS VARCHAR)")
    address = (f"concat_ws(' ', CAST({dint(du('address#no', k, seed), 100, 9999)} AS VARCHAR), "
               f"{dpick(du('address#street', k, seed), pools.RULE_STREETS)})")
    d_lo, d_hi = ep("2023-01-01"), ep("2025-12-31")
    t_lo, t_hi = ep("2023-01-01T00:00:00"), ep("2025-12-31T23:59:59")
    date = f"strftime(make_timestamp({dint(du('date', k, seed), d_lo, d_hi)} * 1000000), '%Y-%m-%d')"
    ts = f"strftime(make_timestamp({dint(du('date_time', k, seed), t_lo, t_hi)} * 1000000), '%Y-%m-%dT%H:%M:%S')"
    name = (f"concat_ws(' ', {dpick(du('string#first', k, seed), pools.RULE_FIRST_NAMES)}, "
            f"{dpick(du('string#last', k, seed), pools.RULE_LAST_NAMES)})")
    ORACLE["contract_i_sample_rows"] = (
        f"SELECT doc_id, {uuid} AS uuid, 'user' || CAST(doc_id + 1 AS VARCHAR) || '@example.com' AS email, "
        f"{phone} AS phone_number, {address} AS address, {date} AS date, {ts} AS date_time, "
        f"CAST({du('boolean', k, seed)} < 0.5 AS VARCHAR) AS boolean, "
        f"CAST({dint(du('integer', k, seed), 0, 100)} AS VARCHAR) AS integer, "
        f"CAST(round({du('float', k, seed)} * 100.0, 2) AS VARCHAR) AS float, {name} AS string FROM documents")


_add_sample_rows_oracle()


ORACLE["source_a20_describe_orders"] = """
SELECT CAST(row_number() OVER () AS INTEGER) AS position, column_name,
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
                        WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date'
                        ELSE lower(column_type) END AS data_type,
       "null" = 'YES' AS is_nullable, CAST(NULL AS VARCHAR) AS column_default, (SELECT count(*) FROM orders) AS row_count
FROM (DESCRIBE orders)
"""


def _add_user_graph_count_oracle():
    gs = f"{SEED}/org_chart"
    ncust = "(SELECT count(*) FROM customer)"
    rows = [
        ("node", "Employee", ncust), ("node", "Office", "8"), ("node", "Project", "30"),
        ("relationship", "WORKS_IN", f"(SELECT count(*) FROM {dbern('customer', 'c_custkey', '8', 0.2, 'WORKS_IN', gs, max_per_source=1)} x)"),
        ("relationship", "REPORTS_TO", f"(SELECT count(*) FROM {dbern('customer', 'c_custkey', ncust, 0.004, 'REPORTS_TO', gs, no_self=True, max_per_source=1)} x)"),
        ("relationship", "ASSIGNED_TO", f"(SELECT count(*) FROM {dbern('customer', 'c_custkey', '30', 0.02, 'ASSIGNED_TO', gs)} x)"),
    ]
    ORACLE["graph_f19_org_chart_counts"] = " UNION ALL ".join(
        f"SELECT '{k}' AS kind, '{n}' AS name, CAST({c} AS BIGINT) AS count" for k, n, c in rows)


_add_user_graph_count_oracle()


def _add_record_json_oracle():
    from .streams import stream_spec
    spec = stream_spec("fraud_detection")
    parts = []
    for c in spec:
        n, typ = c["name"], c.get("type", "string")
        if c.get("uuid"):
            m = f"md5(concat_ws(':', '{SEED}', '{n}', CAST(event_id AS VARCHAR)))"
            v = (f"concat_ws('-', substr({m}, 1, 8), substr({m}, 9, 4), '4' || substr({m}, 14, 3), "
                 f"substr('89ab', CAST(('0x' || substr({m}, 17, 1))::INTEGER % 4 + 1 AS INTEGER), 1) || "
                 f"substr({m}, 18, 3), substr({m}, 21, 12))")
        else:
            v = dspec(c, "event_id")
        if typ == "string":
            parts.append(f"'\"{n}\":\"' || {v} || '\"'")
        else:
            parts.append(f"'\"{n}\":' || CAST({v} AS VARCHAR)")
    parts.append("'\"event_timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00\"'")
    body = " || ',' || ".join(parts)
    ORACLE["d1_record_json"] = f"SELECT event_id AS row_id, '{{' || {body} || '}}' AS value FROM events"


_add_record_json_oracle()


def _add_more_contract_oracles():
    O = ORACLE
    O["contract_i_embeddings"] = _viol_sql("embeddings", "vec_id", [
        ("vec_id", "type primary_key", "vec_id = 0"),
        ("vec_id", "unique", _dup("embeddings", "vec_id")),
        ("embedding", "not empty", "len(embedding) = 0"),
        ("embedding", "unique", "len(list_distinct(embedding)) <> len(embedding)"),
        ("label", "in range 0-9", "NOT CAST(label AS DOUBLE) BETWEEN 0 AND 9"),
        ("label", "non-negative", "NOT label >= 0"),
        ("label", "max 5", "NOT CAST(label AS DOUBLE) <= 5"),
    ])
    # stated by parts and arithmetic, not by the patterns under test; a device record is a function of event_id, user_id, value and props
    O["contract_i_device_records"] = _viol_sql("events", "event_id", [
        ("day", "type date", "event_id % 14 NOT BETWEEN 1 AND 12 OR user_id % 33 NOT BETWEEN 1 AND "
                             "CASE WHEN event_id % 14 = 2 THEN 29 WHEN event_id % 14 IN (4, 6, 9, 11) THEN 30 ELSE 31 END"),
        ("clock", "type time", "event_id % 26 > 23 OR event_id % 62 > 59"),
        ("zone", "type timezone", "event_id % 5 = 0"),
        ("ip", "type ip_address", "user_id % 300 > 255 OR event_id % 260 > 255"),
        ("mac", "type mac_address", "event_id % 256 < 16"),
        ("device", "type uuid", "event_id % 6 <> 5"),
        ("contact", "type email", "event_id % 4 = 0 OR event_id % 10 = 3"),
        ("manual", "type pdf", "event_id % 7 <> 0"),
        ("photo", "type image", "event_id % 7 NOT IN (1, 4)"),
        ("sound", "type audio", "event_id % 7 <> 2"),
        ("lat", "type latitude", "abs(value - 100) > 90"),
        ("lon", "type longitude", "abs(value * 2 - 200) > 180"),
        ("point", "type coordinate", "event_id % 3 = 0"),
        ("token", "type token", "event_id % 20 <= 10"),
        ("digest", "type hash", "28 + event_id % 6 < 32"),
        ("colour", "type color_code", "CASE WHEN event_id % 2 = 0 THEN event_id % 7 NOT IN (3, 6) ELSE event_id % 3 = 0 END"),
        ("firmware", "type version_number", "event_id % 4 = 0"),
        ("status", "type status_code", "90 + event_id % 600 NOT BETWEEN 100 AND 599"),
        ("currency", "type currency", "event_id % 4 <> 2"),
        ("place", "type postal_code", "event_id % 3 = 1"),
    ])
    O["contract_i_conversation_text"] = _viol_sql("conversations", "conv_id", [
        ("role", "matches (user|assistant)", "NOT regexp_matches(role, '^(?:(user|assistant))')"),
        ("role", "alphabetic", "NOT regexp_matches(role, '^\\p{L}+$')"),
        ("text", "type message", "regexp_matches(text, '^\\s*$')"),
        ("text", "length > 200", "NOT length(text) > 200"),
        ("text_as_csv", "type csv", "NOT (contains(text, chr(10)) AND contains(text, ','))"),
        ("text_as_markdown", "type markdown", "NOT (ends_with(text, '.md') OR contains(text, '#') OR contains(text, '*'))"),
        ("text_as_json", "type json",
         "NOT (CASE WHEN json_valid(text) THEN json_type(text) IN ('OBJECT', 'ARRAY') ELSE false END)"),
    ])


_add_more_contract_oracles()


def _add_pattern_sample_oracle():
    npart, nnation, nsupp = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM nation)", "(SELECT count(*) FROM supplier)"

    def ids(prefix, width, col):
        return f"'{prefix}' || lpad(CAST({col} + 1 AS VARCHAR), {width}, '0')"

    iss = dpairs("part", "p_partkey", nnation, npart, "ISSUED")
    aw = dk_targets("part", "p_partkey", "AWARDED_TO", nsupp, 1, 1)
    sc = dbern("supplier", "s_suppkey", nsupp, 0.005, "SUBCONTRACTS_TO", no_self=True)
    rp = dbern("supplier", "s_suppkey", nsupp, 0.02, "REPRESENTS")
    parts = [
        f"SELECT 'ProcAgency' AS src_label, {ids('PAGY-', 3, 'a_ord')} AS src, 'ISSUED' AS type, "
        f"'Contract' AS dst_label, {ids('CTR-', 5, 'b_ord')} AS dst FROM {iss} x",
        f"SELECT 'Contract', {ids('CTR-', 5, 'src')}, 'AWARDED_TO', 'ProcVendor', {ids('PVND-', 4, 'dst_ord')} FROM {aw} x",
        f"SELECT 'ProcVendor', {ids('PVND-', 4, 'src')}, 'SUBCONTRACTS_TO', 'ProcVendor', {ids('PVND-', 4, 'dst_ord')} "
        f"FROM {sc} x",
        f"SELECT 'Lobbyist', {ids('LOB-', 4, 'src')}, 'REPRESENTS', 'ProcVendor', {ids('PVND-', 4, 'dst_ord')} FROM {rp} x",
    ]
    ORACLE["graph_h22_any_pattern_sample"] = (
        f"SELECT * FROM ({' UNION ALL '.join(parts)}) u ORDER BY type, src, dst, src_label, dst_label LIMIT 100")


_add_pattern_sample_oracle()

ORACLE["source_a21_sample_rows"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
       o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 5
"""


# --- tables with defaults, descriptive columns, edge properties, communities; values as the source states them -------
def _add_table_and_community_oracles():
    O = ORACLE
    npart, nnation, nsupp = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM nation)", "(SELECT count(*) FROM supplier)"
    ncust, nord = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM orders)"
    # the place of created_at in each table's definition, and the table its rows come from
    places = {"students": (12, "customer"), "courses": (10, "part"), "enrollment_events": (11, "orders"), "budget_transactions": (16, "orders"),
              "agencies": (8, "nation"), "vendors": (10, "supplier"), "service_requests": (16, "orders"), "citizens": (9, "customer"),
              "assets": (10, "part"), "k12_students": (14, "customer"), "k12_events": (11, "orders"), "schools": (10, "nation"),
              "procurement_events": (16, "orders"), "contracts": (13, "part"), "case_events": (16, "orders"), "clients": (11, "customer"),
              "cases": (13, "orders")}
    O["source_e_table_defaults"] = " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, 'created_at' AS column_name, 'current_timestamp()' AS column_default, {at} AS position, "
        f"(SELECT count(*) FROM {src}) AS row_count, (SELECT count(*) FROM {src}) AS filled" for n, (at, src) in places.items())
    costs = ["Personnel costs -", "Equipment purchase -", "Professional services for", "Facilities maintenance -", "Software licensing -",
             "Travel and training -", "Capital improvement -", "Consulting fees for", "Research equipment -", "Program supplies for",
             "Building renovation -", "IT infrastructure for"]
    programs = ["Infrastructure", "Public Safety", "Youth Development", "Senior Services", "Education Technology", "Workforce Training",
                "Community Health", "Housing Development", "Digital Equity", "Economic Development"]
    requests = ["Pothole Repair", "Streetlight Outage", "Water Main Break", "Noise Complaint", "Illegal Dumping", "Graffiti Removal",
                "Tree Trimming", "Sidewalk Repair", "Traffic Signal", "Building Inspection", "Permit Application", "Animal Control",
                "Park Maintenance", "Snow Removal", "Sewer Backup", "Abandoned Vehicle"]
    school_events = ["Attendance", "Discipline", "Assessment", "Intervention", "Counselor Note", "Parent Contact", "Iep Review", "Health Screening"]
    categories = ["Construction", "Professional Services", "It Services", "Equipment", "Supplies", "Facilities", "Consulting", "Staffing",
                  "Transportation", "Utilities"]
    from ..functions import pools  # the lists of streets and cities

    def u(table, name, key):
        return du(name, key, f"{SEED}/{table}")
    o, c = "o_orderkey", "p_partkey"
    texts = {("budget_transactions", "description", "orders"): f"concat({dpick(u('budget_transactions', '_what', o), costs)}, ' ', {dpick(u('budget_transactions', '_for', o), programs)})",
             ("service_requests", "description", "orders"): f"concat({dpick(u('service_requests', '_what', o), requests)}, ' at ', {dint(u('service_requests', '_no', o), 100, 9999)}, ' ', {dpick(u('service_requests', '_street', o), pools.STREET_NAMES)})",
             ("k12_events", "details", "orders"): f"concat({dpick(u('k12_events', '_what', o), school_events, [10, 3, 5, 2, 2, 2, 1, 1])}, ' event recorded')",
             ("contracts", "title", "part"): f"concat({dpick(u('contracts', '_what', c), categories)}, ' - Project ', {dint(u('contracts', '_no', c), 1, 999)})",
             ("case_events", "county", "orders"): f"concat({dpick(u('case_events', '_city', o), pools.CITIES)}, ' County')"}
    O["source_e_text_columns"] = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{n}' AS column_name, count(x) AS n, count(DISTINCT x) AS \"values\", min(x) AS least, max(x) AS greatest, "
        f"CAST(sum(length(x)) AS BIGINT) AS characters FROM (SELECT {sql} AS x FROM {src})" for (t, n, src), sql in texts.items())
    O["source_f15_only_missing_edges"] = (
        f"SELECT CAST(1 + src % 2 AS INTEGER) AS version, count(DISTINCT src) AS sources, count(*) AS edges, CAST(sum(dst_ord) AS BIGINT) AS targets "
        f"FROM {dk_targets('customer', 'c_custkey', 'ENROLLED_IN', npart, 2, 5)} e GROUP BY 1")
    O["graph_t_h20_returned_then_reordered"] = (
        "WITH l AS (SELECT o_custkey AS customer, l_partkey AS part, l_returnflag AS f, o_orderdate AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey) "
        "SELECT a.customer, a.part, a.d AS returned_order, b.d AS later_order, b.f AS later_flag FROM l a JOIN l b "
        "ON a.customer = b.customer AND a.part = b.part AND b.d > a.d WHERE a.f = 'R'")
    O["graph_t_h31_shared_parts"] = (
        "WITH h AS (SELECT DISTINCT o_custkey AS customer, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey), "
        "one AS (SELECT customer FROM h GROUP BY customer ORDER BY count(*) DESC, customer LIMIT 1) "
        "SELECT customer, count(*) AS shared_parts FROM h WHERE part IN (SELECT part FROM h WHERE customer = (SELECT customer FROM one)) "
        "AND customer <> (SELECT customer FROM one) GROUP BY customer HAVING count(*) >= 3")

    def day(name, key, label, y0, y1):
        return dspec({"name": name, "type": "date", "begin": f"{y0}-01-01", "end": f"{y1}-12-31", "random": True}, key, f"{SEED}/{label}")
    goods = ["Construction", "Professional Services", "IT Services & Equipment", "Office Supplies", "Facilities Management", "Consulting",
             "Staffing & Temp Services", "Transportation & Fleet", "Utilities", "Medical & Lab Supplies", "Security Services", "Food Services",
             "Janitorial Services", "Legal Services", "Marketing & Communications"]
    ab = "CAST(a_ord AS VARCHAR) || ':' || CAST(b_ord AS VARCHAR)"
    edges = [("SUBMITTED", "channel", dpick(du("SUBMITTED#channel", ab), ["phone", "web", "app", "walk_in"]), dpairs("orders", "o_orderkey", ncust, nord, "SUBMITTED")),
             ("ATTENDS", "enrollment_date", f"strftime(DATE '2025-12-31' - CAST({dint(du('ATTENDS#days', 'src'), 0, 999)} AS INTEGER), '%Y-%m-%d')",
              dk_targets("customer", "c_custkey", "ATTENDS", nnation, 1, 1)),
             ("ISSUED", "fiscal_year", dint(du("ISSUED#year", ab), 2023, 2025), dpairs("part", "p_partkey", nnation, npart, "ISSUED")),
             ("AWARDED_TO", "award_date", day("start_date", "src", "Contract", 2022, 2025), dk_targets("part", "p_partkey", "AWARDED_TO", nsupp, 1, 1)),
             ("AWARDED_TO", "bid_count", dint(du("AWARDED_TO#bids", "src"), 1, 12), dk_targets("part", "p_partkey", "AWARDED_TO", nsupp, 1, 1)),
             ("SUBCONTRACTS_TO", "scope", dpick(du("specialty", "dst_ord", f"{SEED}/ProcVendor"), goods),
              dbern("supplier", "s_suppkey", nsupp, 0.005, "SUBCONTRACTS_TO", no_self=True)),
             ("REPRESENTS", "since", day("registration_date", "src", "Lobbyist", 2018, 2025), dbern("supplier", "s_suppkey", nsupp, 0.02, "REPRESENTS"))]
    O["graph_f17_edge_properties"] = " UNION ALL ".join(
        f"SELECT '{r}' AS relationship_type, '{n}' AS property, count(x) AS n, count(DISTINCT x) AS \"values\", CAST(min(x) AS VARCHAR) AS least, "
        f"CAST(max(x) AS VARCHAR) AS greatest FROM (SELECT {sql} AS x FROM {src} e)" for r, n, sql, src in edges)
    hc = dpairs("orders", "o_orderkey", ncust, nord, "HAS_CASE")
    mb = dk_targets("orders", "o_orderkey", "MANAGED_BY", nsupp, 1, 1)
    ids = "concat('{p}', lpad(CAST({o} + 1 AS VARCHAR), {w}, '0'))"
    client, worker = ids.format(p="CLT-", o="h.a_ord", w=5), ids.format(p="CW-", o="m.dst_ord", w=4)
    ctes = [f"x AS (SELECT DISTINCT {client} AS g, {worker} AS m FROM {hc} h JOIN {mb} m ON m.src = h.b_ord)",
            "y AS (SELECT g, m, row_number() OVER (PARTITION BY g ORDER BY md5(concat(g, ':', m))) AS o FROM x)",
            "l AS MATERIALIZED (SELECT least(p.m, q.m) AS a, greatest(p.m, q.m) AS b, count(*) AS w FROM y p JOIN y q ON p.g = q.g AND q.o BETWEEN p.o + 1 AND p.o + 8 GROUP BY 1, 2)",
            "e AS MATERIALIZED (SELECT a, b, w FROM l UNION ALL SELECT b, a, w FROM l)",
            "t AS (SELECT sum(w) AS two_m FROM e)",
            "n AS MATERIALIZED (SELECT a AS node, CAST(sum(w) AS HUGEINT) AS k FROM e GROUP BY a)"]

    def level(tag, ways, nodes):
        """Eight rounds of moves among ``nodes`` (node, k) over ``ways`` (a, b, w); the communities are in {tag}f."""
        out = [f"{tag}c0 AS (SELECT node, k, node AS c FROM {nodes})"]
        for r in range(8):
            was, now = f"{tag}c{r}", f"{tag}c{r + 1}"
            out.append(f"{tag}s{r} AS (SELECT c, sum(k) AS tot FROM {was} GROUP BY c)")
            out.append(f"{tag}v{r} AS (SELECT u.node, u.k, u.c AS own, z.c, sum(z.w) AS w FROM {was} u JOIN (SELECT y.a AS node, d.c, y.w FROM {ways} y JOIN {was} d ON d.node = y.b "
                       f"UNION ALL SELECT node, c, 0 FROM {was}) z ON z.node = u.node WHERE ascii(substr(md5(concat(u.node, ':{r}')), 1, 1)) % 2 = 0 GROUP BY ALL)")
            out.append(f"{tag}b{r} AS (SELECT node, c FROM {tag}v{r} JOIN {tag}s{r} USING (c), t QUALIFY row_number() OVER (PARTITION BY node ORDER BY "
                       f"two_m * w - k * (tot - CASE WHEN c = own THEN k ELSE 0 END) DESC, c <> own, c) = 1)")
            out.append(f"{now} AS MATERIALIZED (SELECT q.node, q.k, coalesce(b.c, q.c) AS c FROM {was} q LEFT JOIN {tag}b{r} b ON b.node = q.node)")
        return out + [f"{tag}f AS MATERIALIZED (SELECT node, k, min(node) OVER (PARTITION BY c) AS community FROM {tag}c8)"]
    ctes += level("a", "e", "n")
    ctes += ["e2 AS MATERIALIZED (SELECT p.community AS a, q.community AS b, CAST(sum(w) AS BIGINT) AS w FROM e JOIN af p ON p.node = e.a JOIN af q ON q.node = e.b WHERE p.community <> q.community GROUP BY 1, 2)",
             "n2 AS (SELECT community AS node, sum(k) AS k FROM af GROUP BY 1)"]
    ctes += level("z", "e2", "n2")
    O["graph_h33_caseworker_modularity"] = (
        f"WITH {', '.join(ctes)}, f AS (SELECT af.node, zf.community FROM af JOIN zf ON zf.node = af.community), "
        "d AS (SELECT community, count(DISTINCT node) AS members, CAST(sum(w) AS BIGINT) AS degree FROM f JOIN e ON e.a = f.node GROUP BY 1), "
        "i AS (SELECT f.community, CAST(sum(w) AS BIGINT) AS inside FROM l JOIN f ON f.node = l.a JOIN f g ON g.node = l.b AND g.community = f.community GROUP BY 1) "
        "SELECT community, members, coalesce(inside, 0) AS inside, degree, "
        "round(coalesce(inside, 0) / CAST(two_m / 2 AS DOUBLE) - (degree / CAST(two_m AS DOUBLE)) * (degree / CAST(two_m AS DOUBLE)), 6) AS modularity "
        "FROM d LEFT JOIN i USING (community), t ORDER BY community")


_add_table_and_community_oracles()
