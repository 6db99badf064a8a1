"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors raised by the engine."""


class TableNotFound(EngineError):
    pass


class ColumnNotFound(EngineError):
    pass


class TableExists(EngineError):
    pass


class InvalidSchema(EngineError):
    pass


class TypeMismatch(EngineError):
    pass


class NotNullViolation(EngineError):
    pass


class UniqueViolation(EngineError):
    pass


class ForeignKeyViolation(EngineError):
    pass


class TransactionClosed(EngineError):
    pass


class NotIncremental(EngineError):
    """The query holds an operator without a delta rule (sort, limit)."""


class GraphQLError(EngineError):
    pass
