"""The library of saved questions: names, scopes, typed parameters, citations.

A corpus question reads a project's sessions up to a day and reports by period;
a keyed question reads what its parameters name. Parameters are checked before
anything is planned: unknown, missing and ill-typed ones raise.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tracewell.relations import Scope, Store

REQUIRED = object()
WINDOW_DAYS = 28


@dataclass(frozen=True)
class Param:
    kind: type  # str, int or datetime.date
    default: Any = REQUIRED

    def parse(self, name: str, value: Any) -> Any:
        if value is None:
            return None
        if self.kind is int:
            if isinstance(value, bool):
                raise ValueError(f"{name}: {value!r} is no integer")
            try:
                return int(value)
            except (TypeError, ValueError):
                raise ValueError(f"{name}: {value!r} is no integer") from None
        if self.kind is datetime.date:
            try:
                return str(datetime.date.fromisoformat(str(value)))
            except ValueError:
                raise ValueError(f"{name}: {value!r} is no date") from None
        return str(value)


def text(default: Any = REQUIRED) -> Param:
    return Param(str, default)


def integer(default: Any = REQUIRED) -> Param:
    return Param(int, default)


def day(default: Any = REQUIRED) -> Param:
    return Param(datetime.date, default)


CORPUS = {"project": text(), "as_of": day(), "window_days": integer(WINDOW_DAYS), "since": day(None)}


@dataclass(frozen=True)
class Question:
    name: str
    corpus: bool
    params: dict[str, Param]
    build: Callable[..., DataFrame] = field(repr=False)


QUESTIONS: dict[str, Question] = {}


def corpus(**params: Param):
    """Register a builder ``f(store, scope, **params)``."""

    def register(build):
        QUESTIONS[build.__name__] = Question(build.__name__, True, CORPUS | params, build)
        return build

    return register


def keyed(**params: Param):
    """Register a builder ``f(store, **params)``."""

    def register(build):
        QUESTIONS[build.__name__] = Question(build.__name__, False, params, build)
        return build

    return register


def bind(question: Question, given: dict[str, Any]) -> dict[str, Any]:
    if unknown := sorted(set(given) - set(question.params)):
        raise ValueError(f"{question.name} has no parameter {', '.join(unknown)}")
    out = {}
    for name, param in question.params.items():
        value = given.get(name, param.default)
        if value is REQUIRED:
            raise ValueError(f"{question.name} needs the parameter {name}")
        out[name] = param.parse(name, value)
    return out


def ask(store: Store, name: str, /, **given: Any) -> DataFrame:
    """The answer to a saved question, as a lazy DataFrame."""
    if name not in QUESTIONS:
        raise KeyError(f"no question is called {name}")
    question = QUESTIONS[name]
    values = bind(question, given)
    if not question.corpus:
        if values.get("session_id") is not None:
            store = store.narrowed(values["session_id"])
        return question.build(store, **values)
    scope = Scope(store, values.pop("project"), values.pop("as_of"), values.pop("window_days"), values.pop("since"))
    return question.build(store, scope, **values)


def citation(name: str, /, **given: Any) -> str:
    """One line that names a question and every bound parameter, to quote beside an answer."""
    values = bind(QUESTIONS[name], given)
    return " ".join([f"-- {name}", *(f"{k}={'NULL' if v is None else v}" for k, v in values.items())])
