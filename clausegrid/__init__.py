"""Spark jobs that match buyer requirements with a seller's technical evidence."""
