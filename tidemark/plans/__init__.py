"""Chains of operators: from features to signals, and from signals to routed incidents."""
