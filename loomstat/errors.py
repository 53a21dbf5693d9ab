"""Errors raised before a job starts where the schema suffices, and from one guard aggregate otherwise."""


class EngineError(ValueError):
    """Root of the engine's errors."""


class InvalidParameter(EngineError):
    pass


class EmptyInput(EngineError):
    pass


class NonFiniteValue(EngineError):
    pass


class UnexpectedMissingness(EngineError):
    pass


class UnknownLabel(EngineError):
    pass


class UnknownColumn(EngineError):
    pass


class DuplicateColumn(EngineError):
    pass


class UnsupportedColumnType(EngineError):
    pass


class UnsupportedOperation(EngineError):
    pass


class NullValueInColumn(EngineError):
    pass


class SchemaMismatch(EngineError):
    pass


class NotConverged(EngineError):
    pass
