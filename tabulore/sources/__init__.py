"""Readers: a format's bytes or rows to tables of the leaf relation."""
