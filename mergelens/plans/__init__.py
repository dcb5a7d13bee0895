"""Query plans over the pull-request view of the order tables."""
