"""Training-data pipeline operators; nothing outside this folder imports it."""
