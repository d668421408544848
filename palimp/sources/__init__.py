"""Readers of archives, feeds, curated lists and paged services, and writers of the results."""
