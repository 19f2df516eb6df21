"""Conversation analytics on Spark: transcripts, identities, matches and resolutions for all calls at once."""
