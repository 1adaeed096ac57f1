"""Query analysis."""
