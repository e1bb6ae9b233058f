"""Whole studies, and the supplied tables read as a coded event history."""
