"""Declared schemas and enum domains of the project-controls star schema."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Enum domains (stored as upper-case text). They must equal the
# modelled system's values for the reports' CASE branches to match.
# ---------------------------------------------------------------------------
PROJECT_TYPES = ["RESIDENTIAL", "COMMERCIAL", "INFRASTRUCTURE"]
PROJECT_STATUSES = ["PLANNING", "ACTIVE", "COMPLETED", "ON_HOLD"]
TRADES = ["ELECTRICAL", "PLUMBING", "HVAC", "FRAMING", "CONCRETE", "ROOFING",
          "PAINTING", "LANDSCAPING", "GENERAL"]
EQUIPMENT_TYPES = ["EXCAVATOR", "CRANE", "BULLDOZER", "TRUCK", "FORKLIFT",
                   "GENERATOR", "COMPACTOR", "OTHER"]
EQUIPMENT_STATUSES = ["ACTIVE", "MAINTENANCE", "RETIRED"]
CERTIFICATION_LEVELS = ["APPRENTICE", "JOURNEYMAN", "MASTER"]
EMPLOYEE_STATUSES = ["ACTIVE", "INACTIVE"]
MATERIAL_CATEGORIES = ["LUMBER", "CONCRETE", "STEEL", "ELECTRICAL", "PLUMBING",
                       "INSULATION", "FINISHES", "OTHER"]
COST_CATEGORIES = ["LABOR", "MATERIALS", "EQUIPMENT", "SUBCONTRACTOR", "OTHER"]
DELIVERY_STATUSES = ["ON_TIME", "DELAYED"]
INCIDENT_TYPES = ["INJURY", "NEAR_MISS", "VIOLATION"]
SEVERITIES = ["MINOR", "MODERATE", "SEVERE"]
INSPECTION_TYPES = ["SAFETY", "QUALITY", "CODE"]
INSPECTION_RESULTS = ["PASS", "FAIL", "CONDITIONAL"]

# (table, column) -> domain, used by the data-quality job Q1.
ENUM_COLUMNS = {
    ("dim_projects", "project_type"): PROJECT_TYPES,
    ("dim_projects", "status"): PROJECT_STATUSES,
    ("dim_subcontractors", "trade"): TRADES,
    ("dim_equipment", "equipment_type"): EQUIPMENT_TYPES,
    ("dim_equipment", "status"): EQUIPMENT_STATUSES,
    ("dim_employees", "trade"): TRADES,
    ("dim_employees", "certification_level"): CERTIFICATION_LEVELS,
    ("dim_employees", "status"): EMPLOYEE_STATUSES,
    ("dim_materials", "category"): MATERIAL_CATEGORIES,
    ("fact_project_costs", "cost_category"): COST_CATEGORIES,
    ("fact_material_deliveries", "delivery_status"): DELIVERY_STATUSES,
    ("fact_safety_incidents", "incident_type"): INCIDENT_TYPES,
    ("fact_safety_incidents", "severity"): SEVERITIES,
    ("fact_inspections", "inspection_type"): INSPECTION_TYPES,
    ("fact_inspections", "result"): INSPECTION_RESULTS,
}

_L, _I, _D, _S, _DT, _B = (T.LongType(), T.IntegerType(), T.DoubleType(),
                           T.StringType(), T.DateType(), T.BooleanType())
MONEY = T.DecimalType(18, 4)


def _st(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


# Declared table schemas. Nullable flags follow the modelled ORM; the derived
# star over the test data may carry extra columns (e.g. location) or fewer.
SCHEMAS: dict[str, T.StructType] = {
    "dim_projects": _st(("id", _L, False), ("project_name", _S, False),
                        ("project_type", _S, False), ("contract_value", _D, False),
                        ("planned_start_date", _DT, True), ("planned_end_date", _DT, True),
                        ("actual_start_date", _DT, True), ("actual_end_date", _DT, True),
                        ("status", _S, False), ("client_name", _S, False),
                        ("location", _S, True), ("square_footage", _D, True)),
    "dim_subcontractors": _st(("id", _L, False), ("company_name", _S, False),
                              ("trade", _S, False), ("rating", _D, True),
                              ("years_in_business", _I, True)),
    "dim_equipment": _st(("id", _L, False), ("equipment_name", _S, False),
                         ("equipment_type", _S, False), ("purchase_date", _DT, True),
                         ("purchase_cost", _D, True), ("hourly_rate", _D, True),
                         ("status", _S, False)),
    "dim_employees": _st(("id", _L, False), ("employee_name", _S, False),
                         ("trade", _S, False), ("hourly_rate", _D, False),
                         ("hire_date", _DT, True), ("certification_level", _S, False),
                         ("status", _S, False)),
    "dim_materials": _st(("id", _L, False), ("material_name", _S, False),
                         ("category", _S, False), ("unit", _S, False),
                         ("unit_cost", _D, False), ("supplier", _S, True)),
    "dim_dates": _st(("date", _DT, False), ("year", _I, False), ("quarter", _I, False),
                     ("month", _I, False), ("month_name", _S, False), ("week", _I, False),
                     ("day_of_week", _I, False), ("is_weekend", _B, False),
                     ("is_holiday", _B, False)),
    "fact_project_costs": _st(("project_id", _L, False), ("date_id", _DT, False),
                              ("cost_category", _S, False), ("subcontractor_id", _L, True),
                              ("amount", MONEY, False), ("budgeted_amount", MONEY, True)),
    "fact_labor_hours": _st(("id", _L, False), ("project_id", _L, False),
                            ("employee_id", _L, False), ("date_id", _DT, False),
                            ("hours_worked", T.DecimalType(6, 1), False),
                            ("hourly_rate", T.DecimalType(8, 2), False)),
    "fact_equipment_usage": _st(("project_id", _L, False), ("equipment_id", _L, False),
                                ("date_id", _DT, False), ("hours_used", _D, False),
                                ("fuel_cost", _D, True), ("maintenance_cost", _D, True),
                                ("operator_id", _L, True)),
    "fact_material_deliveries": _st(("project_id", _L, False), ("material_id", _L, False),
                                    ("date_id", _DT, False), ("quantity", _D, False),
                                    ("total_cost", MONEY, False),
                                    ("delivery_status", _S, False)),
    "fact_safety_incidents": _st(("id", _L, False), ("project_id", _L, False),
                                 ("date_id", _DT, False), ("incident_type", _S, False),
                                 ("severity", _S, False), ("days_lost", _I, False)),
    "fact_inspections": _st(("id", _L, False), ("project_id", _L, False),
                            ("date_id", _DT, False), ("inspection_type", _S, False),
                            ("result", _S, False), ("inspector_name", _S, True)),
}

DIMENSIONS = ["dim_projects", "dim_subcontractors", "dim_equipment", "dim_employees",
              "dim_materials", "dim_dates"]
FACTS = ["fact_project_costs", "fact_labor_hours", "fact_equipment_usage",
         "fact_material_deliveries", "fact_safety_incidents", "fact_inspections"]
TABLES = DIMENSIONS + FACTS

# Primary keys (Q4) and foreign keys (Q2 / J10): (fact column, dim table, dim column).
PRIMARY_KEYS = {
    "dim_projects": ["id"], "dim_subcontractors": ["id"], "dim_equipment": ["id"],
    "dim_employees": ["id"], "dim_materials": ["id"], "dim_dates": ["date"],
    "fact_labor_hours": ["id"], "fact_safety_incidents": ["id"], "fact_inspections": ["id"],
}
FOREIGN_KEYS = {
    "fact_project_costs": [("project_id", "dim_projects", "id"),
                           ("subcontractor_id", "dim_subcontractors", "id")],
    "fact_labor_hours": [("project_id", "dim_projects", "id"),
                         ("employee_id", "dim_employees", "id")],
    "fact_equipment_usage": [("project_id", "dim_projects", "id"),
                             ("equipment_id", "dim_equipment", "id"),
                             ("operator_id", "dim_employees", "id")],
    "fact_material_deliveries": [("project_id", "dim_projects", "id"),
                                 ("material_id", "dim_materials", "id")],
    "fact_safety_incidents": [("project_id", "dim_projects", "id")],
    "fact_inspections": [("project_id", "dim_projects", "id")],
}
