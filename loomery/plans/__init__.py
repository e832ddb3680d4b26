"""Whole plans: schema matching, entity resolution, serving."""
