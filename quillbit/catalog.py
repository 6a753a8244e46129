"""Queries over the operators, and the SQL that they are held against."""

from __future__ import annotations

from quillbit.plans.oracles import ORACLES
from quillbit.plans.reference import FLAGSHIP, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
