"""sources of the almanac package."""
