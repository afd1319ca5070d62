"""Synthetic branching vessel networks as DataFrame operators."""
