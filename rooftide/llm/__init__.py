"""Training-data operators: tokenising, extraction, fixity, search, mixing, dedup, media, sharding, scoring.

Nothing outside this folder imports it.  Every operator reads the columns it
names, ignores all others (so a clashing extra column can do no harm) and
returns columns of its own.
"""
