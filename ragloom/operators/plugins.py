"""The places where a user adds operators of their own, by name."""

from __future__ import annotations

from collections.abc import Callable

from ragloom.operators import chunkers, embedding, ensembles, evaluation, generation, retrieval

#: Kind of operator -> (those known by name, the function that adds one).
PLUGINS: dict[str, tuple[dict[str, Callable], Callable]] = {
    "chunker": (chunkers.STRATEGIES, chunkers.register), "embedder": (embedding.EMBEDDERS, embedding.register), "retriever": (retrieval.RETRIEVERS, retrieval.register),
    "generator": (generation.GENERATORS, generation.register), "evaluator": (evaluation.EVALUATORS, evaluation.register), "ensemble": (ensembles.ENSEMBLES, ensembles.register)}


def register(kind: str, name: str, operator: Callable) -> None:
    PLUGINS[kind][1](name, operator)


def known(kind: str, name: str) -> Callable:
    """The operator of a kind and name; a KeyError names those there are."""
    operators = PLUGINS[kind][0]
    if name not in operators:
        raise KeyError(f"no {kind} named {name}; known: {', '.join(sorted(operators))}")
    return operators[name]
