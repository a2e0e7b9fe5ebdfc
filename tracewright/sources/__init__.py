"""Readers and writers: explicit schemas, no inference, splittable formats where the format allows."""
