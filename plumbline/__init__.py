"""Audit, profile and clean tables of any size with Spark DataFrames."""

from plumbline.operators.score import Audit, audit, default_plan, fix_plan
from plumbline.plans.workflow import apply_plan, audit_and_clean, diff, guided_clean, run, write_report
from plumbline.session import local_session

__all__ = ["Audit", "apply_plan", "audit", "audit_and_clean", "default_plan", "diff", "fix_plan",
           "guided_clean", "local_session", "run", "write_report"]
