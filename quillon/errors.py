"""Errors that a user can put right, and those of models."""


class UserError(Exception):
    """Wrong input or configuration."""

    exit_code = 2


class ModelError(UserError):
    """A model or its server isn't there."""

    exit_code = 1
