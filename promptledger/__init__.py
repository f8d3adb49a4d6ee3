"""Spark jobs for auditing, screening and accounting of language-model traffic."""
