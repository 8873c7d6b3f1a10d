"""The one error that a wrong plan, option or source raises."""


class PlanError(ValueError):
    """The plan, an option or a source isn't what the plan language asks for."""


def check(condition: object, message: str) -> None:
    if not condition:
        raise PlanError(message)
