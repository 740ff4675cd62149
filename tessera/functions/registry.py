"""Named functions that a user may add to: columns or tables in, columns or tables out."""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict):
    """Functions by name; ``@registry.register("name")`` adds one, and an unknown name says which there are."""

    def __init__(self, what: str):
        super().__init__()
        self.what = what

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            self[name] = f
            return f

        return add

    def __missing__(self, name: str):
        raise ValueError(f"unknown {self.what} {name!r}; there are {', '.join(sorted(self))}")
