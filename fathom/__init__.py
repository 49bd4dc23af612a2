"""Precedent graphs over large corpora of design documents, as Spark jobs."""
