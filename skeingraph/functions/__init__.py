"""Part of the property-graph engine."""
