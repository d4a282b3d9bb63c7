"""plans of the almanac package."""
