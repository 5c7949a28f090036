"""Named hooks around the steps of a flow: a hook takes the step's DataFrame and returns one of the same shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Hook = Callable[[DataFrame], DataFrame]

# Steps a site may extend.
STEPS = (
    "classify_orders",
    "recommend_cells",
    "total_picking",
    "request_box",
    "before_instruct",
    "after_instruct",
    "before_merge",
    "after_merge",
    "before_cancel",
    "after_cancel",
    "skip_orders",
)


class Hooks:
    """Hooks by step name, applied in the order they were added."""

    def __init__(self) -> None:
        self._hooks: dict[str, list[Hook]] = {step: [] for step in STEPS}

    def add(self, step: str, hook: Hook) -> Hooks:
        if step not in self._hooks:
            raise ValueError(f"no step {step!r}")
        self._hooks[step].append(hook)
        return self

    def apply(self, step: str, df: DataFrame) -> DataFrame:
        for hook in self._hooks[step]:
            df = df.transform(hook)
        return df
