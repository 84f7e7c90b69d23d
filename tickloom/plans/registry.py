"""All queries of the core, by name."""

from __future__ import annotations

from tickloom.plans import detector_kernels, detector_parts, detector_stages, problems

QUERIES = problems.QUERIES | detector_stages.QUERIES | detector_parts.QUERIES | detector_kernels.QUERIES
SQL = problems.SQL | detector_stages.SQL | detector_parts.SQL | detector_kernels.SQL
FLAGSHIP = "truth_residual_summary"
