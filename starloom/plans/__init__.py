"""Compositions: linear algebra, pipelines and the query catalog."""
