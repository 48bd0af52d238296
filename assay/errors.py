"""Errors that a caller can tell apart."""


class EvaluationError(RuntimeError):
    """An evaluator or a judge's payload failed."""


class DatasetResolutionError(RuntimeError):
    """A dataset URI could not be resolved or read."""
