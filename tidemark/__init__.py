"""Business KPI and charging-session analytics as plain Spark DataFrame operators."""
