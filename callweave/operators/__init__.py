"""Set operators over the conversation tables."""
