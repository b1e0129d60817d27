"""Imports every module that registers queries."""

from . import changes, files, language, records, tables  # noqa: F401
