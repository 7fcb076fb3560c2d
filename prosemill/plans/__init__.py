"""Pipelines, configuration and the registered queries."""
