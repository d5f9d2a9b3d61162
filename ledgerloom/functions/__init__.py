"""Column builders: pricing, text and time rules, presentation."""
