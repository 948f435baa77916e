"""Shop profiles, the configured KPI tables and the composed analysis."""
