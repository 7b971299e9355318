"""Particle tables and frame series on Spark."""
