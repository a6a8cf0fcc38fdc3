"""Experiment plans: deterministic draws, cohorts, scenarios, jobs and shards."""
