"""Model names and what each of them uses."""

from __future__ import annotations

from dataclasses import dataclass

# Feature groups that a prediction head may look at.
ACTIVITIES, ROLES, TIMES, CONTEXT = "activities", "roles", "times", "context"


@dataclass(frozen=True)
class ModelSpec:
    """``heads`` maps each head (activity, role, time) to its feature groups."""

    name: str
    scaler: str
    additional_columns: tuple[str, ...]
    vectorizer: str
    heads: dict[str, tuple[str, ...]]


_ALL = (ACTIVITIES, ROLES, TIMES)
_ROUTES = {
    # every head sees its own attribute only
    "specialized": {"ac": (ACTIVITIES,), "rl": (ROLES,), "time": (TIMES,)},
    # activity and role heads share both categories, the time head sees times
    "shared_cat": {"ac": (ACTIVITIES, ROLES), "rl": (ACTIVITIES, ROLES), "time": (TIMES,)},
    # every head sees everything
    "concatenated": {"ac": _ALL, "rl": _ALL, "time": _ALL},
    # context features go to the time head
    "shared_cat_cx": {
        "ac": (ACTIVITIES, ROLES), "rl": (ACTIVITIES, ROLES), "time": (TIMES, CONTEXT),
    },
    # context features go to all heads
    "concatenated_cx": {h: (*_ALL, CONTEXT) for h in ("ac", "rl", "time")},
}
CONTEXT_COLUMNS = ("daytime", "weekday")


def _spec(name: str, route: str) -> ModelSpec:
    context = route.endswith("_cx")
    kind = "inter" if context else "basic"
    return ModelSpec(name, kind, CONTEXT_COLUMNS if context else (), kind, _ROUTES[route])


def _twin(route: str) -> str:
    """Name of the variant that differs in its recurrent cell only."""
    return route.replace("_cx", "_gru_cx") if route.endswith("_cx") else f"{route}_gru"


SPECS = {name: _spec(name, route) for route in _ROUTES for name in (route, _twin(route))}
SPECS["simple_gan"] = ModelSpec("simple_gan", "basic", (), "gan", {})


def model_spec(name: str) -> ModelSpec:
    if name not in SPECS:
        raise ValueError(name)
    return SPECS[name]


FAMILIES = {
    "lstm": ("shared_cat", "concatenated"),
    "gru": ("shared_cat_gru", "concatenated_gru"),
    "lstm_cx": ("shared_cat_cx", "concatenated_cx"),
    "gru_cx": ("shared_cat_gru_cx", "concatenated_gru_cx"),
}
