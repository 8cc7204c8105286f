"""Entry points that chain operators into a full analysis."""
