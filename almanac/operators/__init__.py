"""operators of the almanac package."""
