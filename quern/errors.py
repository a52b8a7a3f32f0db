"""Refusals, each with a stable code."""


class QueryError(ValueError):
    """A query or write that is refused before any job runs."""

    def __init__(self, code: str, message: str, status: int = 400):
        super().__init__(f"{code}: {message}")
        self.code, self.status = code, status
