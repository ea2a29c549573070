"""Refusals. Input that cannot be read is never an empty result."""


class Refusal(ValueError):
    """The run cannot give an answer; command lines end with code 2."""


class RuleError(Refusal):
    """The rule pack is not of a form that the engine reads."""
