"""Part of rowmill; see the README for the map of modules."""
