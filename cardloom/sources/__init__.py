"""Readers and writers of catalogs, embeddings, images and scans."""
