"""Benefit-registry jobs on Spark: rules, graph edges, matching and quality gates as DataFrame jobs."""
