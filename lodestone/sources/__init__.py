"""Readers and writers of documents, graphs, stage files and reports (SC*)."""
