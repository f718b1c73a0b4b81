"""Workloads composed of operators and styles."""
