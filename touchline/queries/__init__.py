"""Registered queries, by theme; every module pairs a Spark query with DuckDB SQL where SQL can say it."""
