"""Views, the query catalogue and driver loops."""
