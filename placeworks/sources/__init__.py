"""Readers and writers: CSV with headers of several kinds, pages, tables, reports."""

from placeworks.sources.files import csv_after_preamble, csv_with_header_guess, append_once, appended, decoded_lines, resolve_columns, strict_csv, strict_csv_files, table, write_csv, write_json_page, write_sitemap
from placeworks.sources.pages import evidence

__all__ = ["append_once", "appended", "csv_after_preamble", "csv_with_header_guess", "decoded_lines", "evidence", "resolve_columns", "strict_csv", "strict_csv_files", "table", "write_csv", "write_json_page", "write_sitemap"]
