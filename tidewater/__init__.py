"""Tidewater: analytics over time-pinned media data, expressed as Spark DataFrame plans."""
