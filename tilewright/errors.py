"""What the engine raises."""


class EngineError(Exception):
    """Any refusal of the engine."""


class SlideReadError(EngineError):
    """An image can't be opened or read."""


class AnnotationError(EngineError):
    """An annotation file is malformed or doesn't fit its image."""


class CoverageError(EngineError):
    """A map has holes where it must not."""


class RefusalError(EngineError):
    """A result must not be reported."""
