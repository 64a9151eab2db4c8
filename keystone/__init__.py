"""keystone — Spark-native project-controls analytics.

Lazy DataFrame-in / DataFrame-out operators over a star schema of projects,
subcontractors, equipment, employees, materials and dates with facts for
costs, labour hours, equipment usage, deliveries, safety incidents and
inspections.

Sub-packages
------------
sources    star schema, warehouse I/O, calendar, project structure
functions  column-expression helpers (rounding, safe ratios, labels, dates)
operators  reports (A1-A6), dashboard roll-ups (D1-D20), extra reports
           (R1-R5), data-quality checks (Q1-Q4) and distributed ranking
plans      feature jobs, model training and set-based scoring (M1-M21)
llm        training-data operators (optional; nothing else imports it)
"""

__version__ = "0.2.0"
