"""Flood-inundation analytics on grids, streams and forecasts as relations."""
