"""Query plans over the logical tables, each with its oracle SQL."""
