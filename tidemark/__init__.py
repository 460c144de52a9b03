"""Tidemark: conversation and transcript analytics as Spark DataFrame operators."""
