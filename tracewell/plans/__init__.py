"""Saved questions over the trace store."""

from tracewell.plans import digests, draws, drill, failures, gaps, spend
from tracewell.plans.manifest import QUESTIONS, ask, citation

__all__ = ["QUESTIONS", "ask", "citation", "digests", "draws", "drill", "failures", "gaps", "spend"]
