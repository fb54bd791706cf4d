"""Whole plans put together from the operators, and helpers for their execution."""
