"""Readers and writers: tables, card exports, typed rows, and the item and acquisition sinks."""
