"""Node properties of the six graphs that no pattern query needs: column specs by label, added to each node table.

They are computed only when a query reads them (unused columns are pruned from the plan).

FIXED VALUES: pools, weights and ranges are the source's.
"""

from __future__ import annotations

from ..functions import pools

COMMODITIES = ["Construction", "Professional Services", "IT Services & Equipment", "Office Supplies",
               "Facilities Management", "Consulting", "Staffing & Temp Services", "Transportation & Fleet", "Utilities",
               "Medical & Lab Supplies", "Security Services", "Food Services", "Janitorial Services", "Legal Services",
               "Marketing & Communications"]
LINE_ITEM_TEXTS = ["Personnel costs -", "Equipment purchase -", "Professional services for", "Facilities maintenance -",
                   "Software licensing -", "Travel and training -", "Capital improvement -", "Consulting fees for"]


def _pick(name, values, weights=None, type_="string", **more):
    return {"name": name, "type": type_, "values": values, "random": True, **({"weights": weights} if weights else {}), **more}


def _range(name, type_, lo, hi, **more):
    return {"name": name, "type": type_, "min": lo, "max": hi, "random": True, **more}


def _flag(name, p):
    return {"name": name, "type": "boolean", "probability": p}


def _date(name, first, last, **more):
    return {"name": name, "type": "date", "begin": f"{first}-01-01", "end": f"{last}-12-31", "interval": "days=1", "random": True, **more}


def _text(name, *parts):
    return {"name": name, "type": "string", "parts": list(parts)}


def _person(name):
    return {"name": name, "type": "string", "person": True}


def _hidden(spec):
    return {**spec, "omit": True}


def _number(lo, hi):
    return {"min": lo, "max": hi}


def _place():
    return [_range("latitude", "decimal(8,5)", 38.8, 39.4), _range("longitude", "decimal(8,5)", -77.2, -76.6)]


def specs() -> dict[str, list[dict]]:
    """Label -> more column specs."""
    from . import graphs as G
    return {
        "Department": [_hidden(_range("_room", "int", 100, 999)),
                       {"name": "building", "type": "string", "expr": "concat('Building ', substr('ABCDEFGHIJ', cast(pmod(_ord, 10) + 1 as int), 1), _room)"}],
        "FundingSource": [_text("cfda_number", _number(10, 99), ".", _number(100, 999))],
        "Agency": [_pick("jurisdiction", pools.CITIES), _range("employee_count", "int", 20, 5000)],
        "Program": [_date("start_date", 2023, 2026)],
        "Vendor": [_text("duns_number", _number(100000000, 999999999))],
        "LineItem": [_text("account_code", _number(1000, 9999)), _hidden(_pick("_what", LINE_ITEM_TEXTS)), _hidden(_pick("_for", G.PROGRAM_NAMES)),
                     {"name": "description", "type": "string", "expr": "concat(_what, ' ', _for)"}, _pick("fiscal_quarter", ["Q1", "Q2", "Q3", "Q4"])],
        "District": [_person("council_member"), _range("population", "int", 15000, 80000), _range("area_sq_miles", "decimal(4,1)", 2, 25)],
        "ServiceDepartment": [_range("staff_count", "int", 20, 200), _range("avg_response_hours", "decimal(4,1)", 4, 72)],
        "Asset": [_date("last_inspection", 2022, 2025), *_place()],
        "Citizen": [_text("email", "citizen", {"col": "_ord", "offset": 1}, "@email.com"),
                    _text("phone", "(", _number(200, 999), ") ", _number(200, 999), "-", _number(1000, 9999)), _date("registered_date", 2020, 2025)],
        "ServiceRequest": [_hidden(_pick("_about", G.REQUEST_TYPES)), _hidden(_range("_house", "int", 100, 9999)), _hidden(_pick("_street", pools.STREET_NAMES)),
                           {"name": "description", "type": "string", "expr": "concat(_about, ' reported at ', _house, ' ', _street)"},
                           _date("resolved_date", 2023, 2026, percent_nulls=40), *_place()],
        "School": [_range("graduation_rate", "decimal(4,1)", 65, 99, percent_nulls=30), _person("principal")],
        "Teacher": [_range("years_experience", "int", 1, 35),
                    _pick("certification", ["standard", "advanced", "national_board", "provisional", "emergency"], [5, 3, 1, 1, 1])],
        "RiskIndicator": [_range("severity_weight", "decimal(3,2)", 0.5, 1)],
        "Intervention": [_date("start_date", 2023, 2025), _date("end_date", 2024, 2026), _hidden(_pick("_kind", G.INTERVENTION_TYPES)),
                         _hidden(_pick("_sign", G.RISK_INDICATORS)), {"name": "notes", "type": "string", "expr": "concat(_kind, ' for student showing ', lower(_sign))"}],
        "ProcAgency": [_range("annual_procurement_budget", "decimal(14,2)", 1000000, 500000000), _person("procurement_officer")],
        "ProcVendor": [_pick("specialty", COMMODITIES), _flag("local_vendor", 0.4), _range("years_in_business", "int", 1, 50), _flag("bonded", 0.6),
                       _range("annual_revenue", "decimal(14,2)", 100000, 100000000)],
        "Contract": [_date("start_date", 2022, 2025), _date("end_date", 2024, 2028), _pick("duration_months", [3, 6, 12, 18, 24, 36, 48, 60], type_="int"),
                     _pick("payment_terms", ["net_30", "net_45", "net_60", "upon_delivery"])],
        "Lobbyist": [_date("registration_date", 2018, 2025), _pick("specialization", COMMODITIES), _range("total_compensation", "decimal(12,2)", 50000, 2000000)],
        "HHSAgency": [_hidden(_pick("_seat", pools.CITIES)), {"name": "county", "type": "string", "expr": "concat(_seat, ' County')"},
                      _range("case_load", "int", 500, 15000), _range("annual_budget", "decimal(14,2)", 1000000, 100000000)],
        "HHSProgram": [_flag("federal_funded", 0.7), _range("max_benefit", "decimal(10,2)", 200, 15000),
                       _pick("eligibility_criteria", ["income_based", "categorical", "means_tested", "universal", "age_based"])],
        "Caseworker": [_range("caseload", "int", 15, 80), _range("years_experience", "int", 1, 30), _pick("license", ["LCSW", "LSW", "LMHC", "none", "MSW"], [3, 3, 2, 1, 2])],
        "Client": [{"name": "dob", "type": "date", "begin": "1945-01-01", "end": "2008-12-28", "interval": "days=1", "random": True},
                   _text("zip_code", _number(10000, 99999)),
                   _pick("primary_language", ["English", "Spanish", "Chinese", "Vietnamese", "Arabic", "French", "Korean", "Russian"], [60, 20, 5, 3, 3, 3, 3, 3]),
                   _flag("veteran", 0.08), _flag("disabled", 0.15)],
        "Case": [_date("opened_date", 2022, 2025), _date("closed_date", 2023, 2026, percent_nulls=40),
                 _pick("referral_source", ["self", "agency", "community_org", "healthcare", "school", "court", "law_enforcement"], [3, 3, 2, 2, 1, 1, 1]),
                 _date("review_date", 2024, 2026)],
    }


def with_more(label: str, spec: list[dict]) -> list[dict]:
    """``spec`` and the label's further properties, those it has already left out."""
    known = {c["name"] for c in spec}
    return [*spec, *(c for c in specs().get(label, []) if c["name"] not in known)]
