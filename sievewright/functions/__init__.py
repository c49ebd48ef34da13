"""Part of the screening engine; see the README for the layout."""
