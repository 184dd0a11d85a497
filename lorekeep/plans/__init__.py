"""Composite entry points built from the operators: snapshot run, report, remediation, dashboard."""
