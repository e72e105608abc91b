"""Which lines open a function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Words that a definition starts with, and words that tell a parameter list from arguments.
OPENING_WORDS = frozenset(
    "void int char short long float double unsigned signed bool size_t ssize_t uint8_t uint16_t uint32_t uint64_t int8_t int16_t int32_t int64_t "
    "static inline const struct enum union extern register volatile restrict R_API R_IPI __attribute__".split()
)
PARAMETER_WORDS = frozenset(
    "int char void const struct unsigned long short float double bool size_t uint8_t uint16_t uint32_t uint64_t "
    "ut8 ut16 ut32 ut64 st8 st16 st32 st64 enum union signed volatile restrict".split()
)
# How a definition begins: qualifiers, a type (a name in capitals counts), perhaps a macro around the name,
# the name, its parenthesis.
_TYPED = re.compile(
    r"^(?:(?:static|inline|extern|const|volatile|unsigned|signed)\s+)*"
    r"(?:void|int|char|short|long|float|double|bool|size_t|ssize_t|u?int\d+_t|ut\d+|st\d+|R_API|R_IPI|struct\s+\w+|enum\s+\w+|[A-Z][A-Z0-9_]*)\s*\*?\s*"
    r"(?:[A-Z_][A-Z0-9_]*\s*\()?\s*[a-zA-Z_]\w*\s*\)?\s*\("
)


def last_group(text: str) -> str:
    """What the last parenthesis at the top level that is closed holds; empty without one."""
    depth, start, found = 0, 0, ""
    for i, c in enumerate(text):
        if c == "(":
            depth += 1
            if depth == 1:
                start = i + 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                found = text[start:i]
    return found


def is_header(line: str | None) -> bool:
    """Whether a line, its [n] marker aside, looks like a function's signature: it starts like a definition, and its last
    parenthesis is empty, lists several things, or names a type."""
    bare = re.sub(r"^\[\s*\d+\]", "", line or "").strip()
    if "(" not in bare:
        return False
    first = re.sub(r"\(.*?\)", "", bare.split()[0])
    if first not in OPENING_WORDS and not _TYPED.match(bare):
        return False
    inside = last_group(bare)
    return not inside.strip() or "," in inside or not PARAMETER_WORDS.isdisjoint(inside.split())


def headers(lines: Column) -> Column:
    """For an array of lines, whether each is a header. Balanced parentheses have no regular expression, so this is a
    function on Arrow batches, asked about the few lines of patches only."""

    @F.pandas_udf("array<boolean>")
    def mask(column: pd.Series) -> pd.Series:
        return column.map(lambda texts: None if texts is None else [is_header(t) for t in texts])

    return mask(lines)


def header(line: Column) -> Column:
    """Whether one line is a header."""

    @F.pandas_udf(BooleanType())
    def test(column: pd.Series) -> pd.Series:
        return column.map(is_header).astype(bool)

    return test(line)
