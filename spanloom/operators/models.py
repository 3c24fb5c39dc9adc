"""Models from outside as columns: an embedder and a chat model that are handed in, made once a worker, called on Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MADE: dict = {}


def _made(factory: Callable):
    if factory not in _MADE:
        _MADE[factory] = factory()
    return _MADE[factory]


def embedded(text: Column, factory: Callable, tolerant: bool = False) -> Column:
    """Vectors of a text column; factory() gives a function from a list of texts to their vectors. A `tolerant` one gives nulls where the model fails."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series([*_made(factory)([t or "" for t in texts])], dtype=object)
        except Exception:  # a model may fail for any reason; what follows does without vectors
            if not tolerant:
                raise
            return pd.Series([None] * len(texts), dtype=object)

    return run(text)


def replies(prompt: Column, factory: Callable, tries: int = 2) -> Column:
    """Replies of a chat model to prompts; null where every try fails. factory() gives a function from a prompt to its reply."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        ask, out = _made(factory), []
        for p in prompts:
            reply = None
            for _ in range(tries if p is not None else 0):
                try:
                    reply = ask(p)
                    break
                except Exception:  # a model may fail for any reason; the row then goes on without it
                    continue
            out.append(reply)
        return pd.Series(out, dtype=object)

    return run(prompt)


def json_replies(prompt: Column, factory: Callable, insist: str) -> Column:
    """Replies that should hold a JSON object: one that holds none is asked for once more, with `insist` behind the prompt. Null for a null prompt or where the model fails."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        ask, out = _made(factory), []
        for p in prompts:
            reply = None
            for more in ("", insist) if p is not None else ():
                try:
                    reply = ask(p + more)
                except Exception:  # a model may fail for any reason; the row then goes on without it
                    continue
                if _object(reply):
                    break
            out.append(reply)
        return pd.Series(out, dtype=object)

    return run(prompt)


def _object(text: str | None) -> bool:
    text = text or ""
    try:
        return isinstance(json.loads(text[text.index("{") : text.rindex("}") + 1]), dict)
    except ValueError:
        return False
