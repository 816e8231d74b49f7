"""Errors of the query layer: invalid parameters, unknown objects, refusals with the range that fits."""

from __future__ import annotations


class QueryError(Exception):
    def __init__(self, code: int, message: str, data: dict | None = None):
        super().__init__(message)
        self.code, self.data = code, data


def invalid_params(message: str) -> QueryError:
    return QueryError(-32602, message)


def unavailable(message: str) -> QueryError:
    return QueryError(-32000, message)


class Refused(QueryError):
    """A limit is passed: the answer is refused, never cut."""

    def __init__(self, why: str, first: int, last: int | None):
        fits = last is not None and last >= first
        tail = f"narrow the range to {first:#x}-{last:#x}" if fits else "narrow the range or add filters"
        super().__init__(-32005, f"{why}; {tail}", {"fromBlock": hex(first), "toBlock": hex(last)} if fits else None)
