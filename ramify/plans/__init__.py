"""Whole plans: grammar expansion and network generation."""
