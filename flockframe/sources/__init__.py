"""Readers and writers for survey exports, lookups, draw files and result tables."""
