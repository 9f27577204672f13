"""Dose-response and interface analytics as Spark table operators."""

__version__ = "0.1.0"
