"""DataFrame-to-DataFrame operators: sessions, rates, joins in space, statistics, rasters."""
