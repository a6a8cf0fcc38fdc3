"""Readers and writers of catalogues, captions, manifests, metric tables and results."""
