"""Parsers: source files to symbols, references and imports."""
