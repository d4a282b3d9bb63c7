"""streaming of the almanac package."""
