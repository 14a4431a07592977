"""Streams of documents: parsing keeps no state, so the batch operators run on streams as they are."""
