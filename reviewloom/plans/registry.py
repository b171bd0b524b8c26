"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from reviewloom.plans import data_problems, lakehouse

QUERIES = {**lakehouse.QUERIES, **data_problems.QUERIES}
ORACLE = {**lakehouse.ORACLE, **data_problems.ORACLE}
