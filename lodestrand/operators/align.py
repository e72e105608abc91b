"""Alignment of slices with targets, in Arrow batches: sequence similarity has no Catalyst form."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 0.1
TRACE = "pair_id long, pos int, target_no int, similarity double, tokens int, tag string, is_header boolean, decay double"


def similarities(slice_tokens: list[list[str]], target_tokens: list[list[str]]) -> np.ndarray:
    """Ratcliff-Obershelp ratios; pairs whose upper bound is below one half are 0, two empty lines are 1."""
    out = np.zeros((len(slice_tokens), len(target_tokens)))
    known: dict[tuple, float] = {}
    for i, s in enumerate(slice_tokens):
        match = SequenceMatcher(None, b=s) if s else None
        for j, t in enumerate(target_tokens):
            if not s or not t:
                out[i, j] = float(not s and not t)
                continue
            if 4 * min(len(s), len(t)) < len(s) + len(t):  # no ratio of one half at these lengths
                continue
            key = (tuple(s), tuple(t))
            if key not in known:
                match.set_seq1(t)
                known[key] = match.ratio() if match.quick_ratio() >= 0.5 else 0.0
            out[i, j] = known[key]
    return out


def align(sim: np.ndarray, line_nos: list[int], gap: float = GAP) -> tuple[list[tuple[int, int]], float]:
    """(matched pairs of slice and target places, gap penalty) of the best global alignment.

    A match earns its similarity. Leaving out a slice line is free. Leaving out a target line between two slice lines
    costs gap over the distance of their line numbers, and nothing before the first or behind the last. On the way
    back a match is preferred, then leaving out a target line.
    """
    n, m = sim.shape
    cost = np.zeros(n + 1)  # of target lines left out once i slice lines are done
    for i in range(1, n):
        a, b = line_nos[i - 1], line_nos[i]
        cost[i] = gap / max(1, b - a) if a != -1 and b != -1 and b >= a else gap
    best = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        enter = np.maximum(best[i - 1, :-1] + sim[i - 1], best[i - 1, 1:])
        # best[i, j] = max over k <= j of enter[k] - cost * (j - k), with 0 at the left edge: a running maximum
        ramp = cost[i] * np.arange(m + 1)
        best[i] = np.maximum.accumulate(np.concatenate([[0.0], enter]) + ramp) - ramp
    pairs, penalty, i, j = [], 0.0, n, m
    while i and j:
        here, s = best[i, j], sim[i - 1, j - 1]
        if s > 0 and abs(here - best[i - 1, j - 1] - s) < 1e-9:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif abs(here - best[i, j - 1] + cost[i]) < 1e-9:
            penalty += cost[i]
            j -= 1
        else:
            i -= 1
    return pairs[::-1], penalty


def line_tags(pre: list[list[str]], post: list[list[str]]) -> tuple[list[str], list[str], list[tuple[int, int]]]:
    """Tags of both sides' lines and the pairs of changed ones. Equal runs are COMMON; runs replaced by as many lines
    pair one to one, others pair by the greatest similarity above one half; what is left is VULN or FIX only."""
    tags, changed = (["VULN"] * len(pre), ["FIX"] * len(post)), []
    for kind, a, b, c, d in SequenceMatcher(None, [tuple(x) for x in pre], [tuple(x) for x in post], autojunk=False).get_opcodes():
        if kind == "equal":
            tags[0][a:b], tags[1][c:d] = ["COMMON"] * (b - a), ["COMMON"] * (d - c)
        elif kind == "replace" and b - a == d - c:
            changed += zip(range(a, b), range(c, d), strict=True)
        elif kind == "replace":
            free = list(range(c, d))
            for i in range(a, b):
                scored = [(SequenceMatcher(None, pre[i], post[j]).ratio(), -j) for j in free]
                top = max(scored, default=(0.0, 0))
                if top[0] > 0.5:
                    changed.append((i, -top[1]))
                    free.remove(-top[1])
    return *tags, changed


def align_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, slice array<array<string>>, line_nos array<int>, tags array<string>, headers array<boolean>, target
    array<array<string>>) to one row per slice line: its target line from 1, or null, the similarity, its number of
    tokens, its tag, whether it is a header, and the decay of its pair.

    The decay is what the gap penalty, in tokens, leaves of the tokens that matched outside headers; scores of a whole
    side are multiplied by it. Without headers no line is one. Candidates come in Arrow batches; a pair's matrix is
    lines times lines and lives for one pair only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                lines, target = [list(x) for x in r.slice], [list(x) for x in r.target]
                headers = [False] * len(lines) if r.headers is None else list(r.headers)
                sim = similarities(lines, target)
                found, penalty = align(sim, list(r.line_nos)) if len(lines) and len(target) else ([], 0.0)
                at = dict(found)
                sizes = [len(x) for x in lines]
                matched = sum(sizes[i] * sim[i, j] for i, j in found if not headers[i])
                full = sum(1 for n in sizes if n)
                lost = penalty * sum(sizes) / full if full else 0.0
                keep = float(max(0.0, matched - lost) / matched) if matched > 1e-9 else 0.0
                for i, n in enumerate(sizes):
                    j = at.get(i)
                    rows.append((r.pair_id, i, None if j is None else j + 1, 0.0 if j is None else float(sim[i, j]), n, r.tags[i], bool(headers[i]), keep))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRACE.split(", ")]).astype({"target_no": "Int32", "pos": "int32", "tokens": "int32"})

    headers = F.col("headers") if "headers" in pairs.columns else F.lit(None).cast("array<boolean>").alias("headers")
    return pairs.select("pair_id", "slice", "line_nos", "tags", headers, "target").mapInPandas(run, TRACE)


def rebased(trace: DataFrame, targets: DataFrame) -> DataFrame:
    """trace with file_line, the line of the target's file that each slice line was found on: targets (pair_id,
    target_nos array<int>, start_line) have the first line of each statement, counted in the unit, and the line that the
    unit starts on."""
    both = trace.join(targets.select("pair_id", "target_nos", "start_line"), "pair_id", "left")
    return both.withColumn("file_line", F.get("target_nos", F.col("target_no") - 1) + F.col("start_line") - 1).drop("target_nos", "start_line")


def tag_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, pre array<array<string>>, post array<array<string>>) to one row per line: side, place, tag, partner."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                pre, post, changed = line_tags([list(x) for x in r.pre], [list(x) for x in r.post])
                there, back = dict(changed), {b: a for a, b in changed}
                rows += [(r.pair_id, "pre", i, t, there.get(i)) for i, t in enumerate(pre)] + [(r.pair_id, "post", i, t, back.get(i)) for i, t in enumerate(post)]
            yield pd.DataFrame(rows, columns=["pair_id", "side", "pos", "tag", "partner"]).astype({"pos": "int32", "partner": "Int32"})

    return pairs.select("pair_id", "pre", "post").mapInPandas(run, "pair_id long, side string, pos int, tag string, partner int")
