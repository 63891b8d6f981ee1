"""Errors of the engine."""


class EngineError(Exception):
    """Anything the engine refuses to do."""


class SyntaxProblem(EngineError):
    """A statement that the grammar doesn't have."""


class NameProblem(EngineError):
    """A table, index or column that is unknown, ambiguous or already there."""


class TypeProblem(EngineError):
    """Operands or values of the wrong type or length."""


class TransactionProblem(EngineError):
    """BEGIN, COMMIT or ROLLBACK at the wrong time, or two writers at once."""
