"""Benchmarks: a registry, a harness that verifies before it times, fixtures, and a command line."""
