"""The error that operators raise for invalid specifications and data."""


class EngineError(ValueError):
    """``code`` is stable and meant for programs, the message for people."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message
