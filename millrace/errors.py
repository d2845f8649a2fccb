"""Errors. Schema errors are raised on the driver before any job starts."""


class MillraceError(Exception):
    """Base of all errors raised here."""


class MissingArgumentError(MillraceError, ValueError): ...


class AmbiguousArgumentError(MillraceError, ValueError): ...


class MutationError(MillraceError): ...


class ComparisonError(MillraceError, TypeError): ...


class EmptyError(MillraceError, ValueError): ...


class DataError(MillraceError): ...


class DuplicationError(DataError): ...


class MissingColumnsError(DataError, KeyError): ...


class MissingRowsError(DataError, KeyError): ...


class LearningError(MillraceError): ...


class ClusteringError(LearningError): ...


class NotFittedError(LearningError, RuntimeError): ...


class AlreadyFittedError(LearningError, RuntimeError): ...


class EvaluationError(LearningError): ...


class NotEvaluatedError(EvaluationError): ...


class ImputationError(LearningError): ...


class NoColumnsError(ImputationError): ...


class JobTimeoutError(MillraceError, TimeoutError): ...
