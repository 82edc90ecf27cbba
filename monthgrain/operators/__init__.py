"""DataFrame-to-DataFrame operators on the monthly panel."""
