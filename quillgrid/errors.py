"""Typed errors of the engine."""


class SheetError(Exception):
    """Anything wrong with input: code names the rule that was broken."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class FormulaParseError(SheetError):
    def __init__(self, message: str, at: int = 0):
        super().__init__("formula-parse", f"{message} (at {at})")
        self.at = at


class LimitError(SheetError):
    def __init__(self, message: str):
        super().__init__("limit", message)
