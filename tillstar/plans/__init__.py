"""Plans: conforming to the star, calendar, keys, analytics, data quality."""
