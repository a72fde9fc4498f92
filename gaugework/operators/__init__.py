"""Operators on samples, hosts, rules, shards and logs: DataFrames in, DataFrames out."""
