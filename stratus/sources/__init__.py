"""Readers and writers: station CSV files, processed tables, reports, model bundles."""
