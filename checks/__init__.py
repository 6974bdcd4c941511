"""Queries over the driver's tables, each with the SQL it must equal."""
from checks import records, scores, texts, timeline

MODULES = (timeline, scores, records, texts)
