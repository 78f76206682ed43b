"""Declared input schemas and packet discovery."""
