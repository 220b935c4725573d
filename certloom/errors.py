"""Exceptions and the exit codes that a command line gives them."""

from __future__ import annotations


class EngineError(Exception):
    exit_code = 1


class UsageError(EngineError):
    """A query or an argument that cannot be run."""

    exit_code = 2


class CapError(EngineError):
    """A write that would exceed the disk limit."""

    exit_code = 3


class DatasetError(EngineError):
    """A dataset that is missing, busy or not usable as asked."""

    exit_code = 4


class VerificationError(EngineError):
    """Data that does not match what was signed or committed."""

    exit_code = 5


class NotFound(EngineError):
    """No such certificate, log or batch."""
