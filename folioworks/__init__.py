"""Batch and streaming jobs for a catalogue of digitised historical map sheets, on Spark."""
