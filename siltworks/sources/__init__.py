"""Readers that turn files, archives, web pages and API payloads into rows."""
