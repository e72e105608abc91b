"""Answers of an outside judge: tolerant parsing, and retries at the one place that calls it."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_json(text: str | None) -> dict | None:
    """The JSON object in an answer: fences and words around it go, trailing commas go, missing brackets at the end are
    added, and a single object wrapped in a list or under one key is taken out. None if there is none."""
    if not text:
        return None
    body = re.sub(r"```(?:json)?", "", text)
    start = body.find("{")
    if start < 0:
        return None
    body = body[start:]
    for tried in (body[: body.rfind("}") + 1], body + "".join(reversed(_open(body)))):
        try:
            found = json.loads(re.sub(r",\s*([}\]])", r"\1", tried))
        except ValueError:
            continue
        while isinstance(found, dict) and len(found) == 1 and isinstance(only := next(iter(found.values())), dict):
            found = only
        return found if isinstance(found, dict) else None
    return None


def _open(body: str) -> list[str]:
    """The brackets that body leaves open, strings aside, as what closes them; an open string is closed first."""
    closers, quoted, skip = [], False, False
    for c in body:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            closers.append("}" if c == "{" else "]")
        elif not quoted and c in "}]" and closers:
            closers.pop()
    return closers + ['"'] * quoted


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with `parsed`, the answer as a struct of the schema, null where it holds no object."""

    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (found := parse_json(t)) is None else json.dumps(found))

    return rows.withColumn("parsed", F.from_json(repair(F.col(column)), schema))


class Refused(Exception):
    """An error that trying again does not mend, such as missing rights."""


def with_retries(call: Callable[[], str], tries: int = 3, delay: float = 2.0, wait: Callable[[float], None] = time.sleep) -> str | None:
    """call's answer, tried again after twice the wait each time, at least half a minute if it was told to slow down.
    None if every try failed: the caller then keeps its default."""
    for n in range(tries):
        try:
            return call()
        except Refused:
            return None
        except Exception as error:  # whatever a plug-in raises
            if n == tries - 1:
                return None
            pause = delay * 2**n
            wait(max(pause, 30.0) if "429" in str(error) else pause)
    return None
