"""DataFrame operators of the groundwater domain."""
