"""functions of the almanac package."""
