"""Bars and recursive indicators over unbounded tables."""
