"""Readers and writers of the formats that collections come in."""
