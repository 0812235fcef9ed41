"""Readers and writers. Everything in between is a DataFrame in long form."""
