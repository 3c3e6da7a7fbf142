"""Typed errors with the exit codes of the command line."""

from __future__ import annotations


class ArchiveError(Exception):
    """Base; code is the error's number, exit_code what the command line ends with."""

    code, exit_code = 3, 3


class UsageError(ArchiveError):
    code, exit_code = 1, 1


class InputOutputError(ArchiveError):
    code, exit_code = 2, 2


class FormatError(ArchiveError):
    code, exit_code = 3, 3


class ChecksumError(ArchiveError):
    code, exit_code = 4, 4


class UnsupportedError(ArchiveError):
    code, exit_code = 5, 5


class InternalError(ArchiveError):
    code, exit_code = 17, 3
