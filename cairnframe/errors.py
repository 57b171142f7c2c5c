"""What the engine raises."""


class FrameError(ValueError):
    """Base of all errors of this package."""


class UnknownColumn(FrameError):
    pass


class DuplicateColumn(FrameError):
    pass


class TypeMismatch(FrameError):
    pass


class LengthMismatch(FrameError):
    pass


class ParseError(FrameError):
    pass


class Cancelled(FrameError):
    pass
