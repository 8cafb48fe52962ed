"""Errors of the engine; one class for each way a request can be refused."""


class EngineError(Exception):
    """Base of all errors that the engine raises on purpose."""


class InvalidArgument(EngineError, ValueError):
    pass


class NotFound(EngineError, LookupError):
    pass


class AlreadyExists(EngineError):
    pass


class FailedPrecondition(EngineError):
    pass


class Unavailable(EngineError):
    """The state changed under a prepared mutation; prepare again."""


class DataCorruption(EngineError):
    pass


class Unsupported(EngineError, NotImplementedError):
    pass
