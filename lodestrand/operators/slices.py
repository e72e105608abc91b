"""Slices as text and as checks: nodes to lines, anchors to nodes and lines, slices of the other version, chains of links.

nodes: func_id, node, type, line, end_line, code; lines count from 1 in the function. functions: func_id, code,
start_line, the line of its file that the function begins on.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import line_number
from lodestrand.operators.graphs import by_function
from lodestrand.operators.lookup import lines
from lodestrand.operators.mapping import typed_paths

#: Kinds of nodes that stand for no line.
SILENT = ("EXIT", "MERGE", "NO_OP")


def slice_lines(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """(func_id, line): every line that a chosen node (func_id, node) spans; ENTRY is the first line."""
    spans = nodes.join(chosen.select("func_id", "node").distinct(), ["func_id", "node"], "left_semi").where(~F.col("type").isin(*SILENT))
    first = F.greatest(F.lit(1), F.col("line"))
    last = F.when(F.col("type") == "ENTRY", first).otherwise(F.greatest(first, F.col("end_line")))
    return spans.select("func_id", F.explode(F.sequence(first, last)).alias("line")).distinct()


def slice_text(kept: DataFrame, functions: DataFrame) -> DataFrame:
    """(func_id, text): the kept lines (func_id, line) in order, each with its number in the file; lines that a function
    does not have are left out."""
    every = lines(functions, "func_id", "code").select(F.col("unit_id").alias("func_id"), F.col("line_no").alias("line"), F.col("line").alias("code"))
    rows = kept.select("func_id", "line").distinct().join(every, ["func_id", "line"]).join(functions.select("func_id", "start_line"), "func_id")
    shown = F.struct("line", F.format_string("[%4d] %s", F.col("line") - 1 + F.col("start_line"), "code").alias("t"))
    return rows.groupBy("func_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda s: s["t"]), "\n").alias("text"))


def anchored_nodes(dependence: DataFrame, anchors: DataFrame, links: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(func_id, node) of the slice that a patch's anchors span: the anchors (func_id, type, node), what lies between any
    two that a link of the chain joins, the nodes on changed lines (func_id, line), and ENTRY."""
    between = typed_paths(dependence, anchors, links).select("func_id", F.explode("path").alias("node"))
    on_line = (nodes["func_id"] == changed["func_id"]) & changed["line"].between(nodes["line"], nodes["end_line"])
    touched = nodes.where(~F.col("type").isin("ENTRY", *SILENT)).join(changed, on_line, "left_semi").select("func_id", "node")
    entry = anchors.select("func_id", F.lit("ENTRY").alias("node"))
    return anchors.select("func_id", "node").unionAll(between).unionAll(touched).unionAll(entry).distinct()


def sliced_or_whole(functions: DataFrame, sliced: DataFrame, least: float = 0.2) -> DataFrame:
    """(func_id, text): a function's slice (func_id, text), or all its lines, numbered, if the slice is shorter than that
    share of them."""
    every = lines(functions, "func_id", "code").select(F.col("unit_id").alias("func_id"), F.col("line_no").alias("line"))
    whole = slice_text(every, functions).withColumnRenamed("text", "_whole")
    both = whole.join(sliced, "func_id", "left")
    return both.select("func_id", F.when(F.length(F.coalesce("text", F.lit(""))) < least * F.length("_whole"), F.col("_whole")).otherwise(F.col("text")).alias("text"))


def function_at(functions: DataFrame, places: DataFrame) -> DataFrame:
    """places (path, line) with the function around each: functions (path, func_id, start_line, end_line) do not overlap;
    a place outside all of them is left out."""
    inside = places.join(functions.select("path", "func_id", "start_line", "end_line"), "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return inside.select("path", "line", "func_id", (F.col("line") - F.col("start_line") + 1).alias("line_in_function"))


def expanded_anchors(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """(func_id, anchor, line): anchors (func_id, anchor, line) widened to all lines of the statement that covers their
    line, a condition before a plain statement, a switch or a case by its own line alone; where no node covers it, the
    line itself."""
    own = nodes.where(~F.col("type").isin("ENTRY", *SILENT)).select("func_id", "type", F.col("line").alias("_a"), F.col("end_line").alias("_b"))
    on = (anchors["func_id"] == own["func_id"]) & F.col("line").between(F.col("_a"), F.col("_b"))
    found = anchors.join(own, on, "left").select(anchors["func_id"], "anchor", "line", "type", "_a", "_b")
    order = F.struct(F.when(F.col("type") == "CONDITION", 0).when(F.col("type").isin("SWITCH", "CASE"), 1).when(F.col("type") == "STATEMENT", 2).otherwise(3), "_a", "_b")
    best = found.groupBy("func_id", "anchor", "line").agg(F.min_by(F.struct("type", "_a", "_b"), order).alias("_n"))
    alone = F.col("_n._a").isNull() | F.col("_n.type").isin("SWITCH", "CASE")
    wide = F.when(alone, F.array("line")).otherwise(F.sequence("_n._a", F.greatest(F.col("_n._a"), F.col("_n._b"))))
    return best.select("func_id", "anchor", F.explode(wide).alias("line")).distinct()


def shadow_lines(kept: DataFrame, mapping: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """(func_id, line) of the other version's slice: kept (func_id, line) are the primary lines, mapping (func_id,
    old_line, new_line, kind) pairs the other version's lines with the primary's.

    A line with a partner stays if its partner does, one that only the other version has stays always, and so do deleted
    lines (func_id, line), which are the core of the fault.
    """
    partner = mapping.where("old_line is not null and new_line is not null").join(kept.withColumnRenamed("line", "old_line"), ["func_id", "old_line"], "left_semi")
    here = kept.select("func_id").distinct()
    alone = mapping.where("old_line is null and new_line is not null").join(here, "func_id", "left_semi")
    both = partner.select("func_id", F.col("new_line").alias("line")).unionAll(alone.select("func_id", "new_line"))
    return (both.unionAll(deleted.select("func_id", "line")) if deleted is not None else both).distinct()


def mapping_histogram(mapping: DataFrame) -> DataFrame:
    """How many lines are mapped in each way."""
    return mapping.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def evidence(slices: DataFrame) -> DataFrame:
    """(evidence_id, func, version, line_no, code) of every numbered line of slices (func, version, text)."""
    rows = slices.select("func", "version", F.explode(F.split("text", "\n")).alias("_l")).withColumn("_l", F.trim("_l"))
    numbered = rows.withColumn("line_no", line_number(F.col("_l"))).where("line_no >= 0")
    return numbered.select(F.concat_ws(":", "func", "version", "line_no").alias("evidence_id"), "func", "version", "line_no", F.regexp_replace("_l", r"^\[\s*\d+\]\s*", "").alias("code"))


def link_checks(dependence: DataFrame, flow: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (func_id, pair, dependency, sources array, targets array) with reachable and path_type.

    data: a path of data edges, else of data and control edges (data_flow_mixed). temporal: a path of the control flow.
    control: a path of control edges. A node reaches itself. One function is one group.
    """

    def run(key, left, right):
        near: dict[str, dict[str, list]] = {"data": {}, "control": {}, "mixed": {}, "temporal": {}}
        for src, dst, kind in zip(left["src"], left["dst"], left["kind"], strict=True):
            for k in ("temporal",) if kind == "flow" else (kind, "mixed"):
                near[k].setdefault(src, []).append(dst)

        def reaches(kind: str, sources, targets) -> bool:
            seen, work, wanted = set(sources), deque(sources), set(targets)
            while work:
                n = work.popleft()
                if n in wanted:
                    return True
                for m in near[kind].get(n, ()):
                    if m not in seen:
                        seen.add(m)
                        work.append(m)
            return False

        named = {"data": (("data", "data_flow"), ("mixed", "data_flow_mixed")), "temporal": (("temporal", "temporal"),), "control": (("control", "control_flow"),)}
        rows = []
        for pair, dependency, sources, targets in zip(right["pair"], right["dependency"], right["sources"], right["targets"], strict=True):
            found = next((name for kind, name in named.get(dependency, ()) if reaches(kind, list(sources), list(targets))), "none")
            rows.append((key[0], pair, found != "none", found))
        return pd.DataFrame(rows, columns=["func_id", "pair", "reachable", "path_type"])

    edges = dependence.select("func_id", "src", "dst", "kind").unionAll(flow.select("func_id", "src", "dst", F.lit("flow")))
    kind = pairs.schema["pair"].dataType.simpleString()
    found = by_function(edges, pairs.select("func_id", "pair", "dependency", "sources", "targets")).applyInPandas(run, f"func_id string, pair {kind}, reachable boolean, path_type string")
    return pairs.join(found, ["func_id", "pair"])


def chain_results(candidates: DataFrame, links: DataFrame, mapped: DataFrame, checked: DataFrame) -> DataFrame:
    """(candidate, reachable, path_type, skipped, reason) of every candidate (candidate, category).

    links: category, pos, source, target, is_optional. mapped: candidate, type, of the anchor types that were found.
    checked: candidate, pos, reachable, path_type, of the links that could be checked.

    A category without links passes unchecked. With fewer than two types found nothing is checked and nothing passes. If
    all links are optional the chain passes. Else no required link that was checked may have failed, and the kinds of
    paths found are none, one, or mixed; links whose anchors were not found are passed over.
    """
    types = mapped.groupBy("candidate").agg(F.countDistinct("type").alias("_types"))
    each = candidates.join(links, "category", "left").join(checked, ["candidate", "pos"], "left")
    failed = ~F.col("is_optional") & (F.col("reachable") == F.lit(False))
    kinds = F.array_sort(F.collect_set(F.when(F.col("reachable") & (F.col("path_type") != "none"), F.col("path_type"))))
    summed = each.groupBy("candidate", "category").agg(
        F.count("pos").alias("_links"), F.count_if(F.col("pos").isNotNull() & ~F.col("is_optional")).alias("_required"), F.count_if(failed).alias("_failed"), kinds.alias("_k")
    )
    rows = summed.join(types, "candidate", "left")
    reason = F.when(F.col("_links") == 0, "empty chain").when(F.coalesce("_types", F.lit(0)) < 2, "too few anchors").when(F.col("_required") == 0, "all links optional")
    kind = F.when(F.size("_k") == 0, "none").when(F.size("_k") == 1, F.col("_k")[0]).otherwise("mixed")
    return rows.select(
        "candidate", F.when(reason.isNull(), F.col("_failed") == 0).otherwise(reason != "too few anchors").alias("reachable"),
        F.when(reason.isNull(), kind).otherwise("none").alias("path_type"), reason.isNotNull().alias("skipped"), reason.alias("reason"),
    )


def consistency(anchors: DataFrame) -> DataFrame:
    """(candidate, decision): PROCEED if every anchor (candidate, is_optional, is_mapped, causality) that is not optional
    is mapped and the chain's causality holds, else SAFE."""
    mapped = F.bool_and(F.col("is_optional") | F.col("is_mapped"))
    return anchors.groupBy("candidate").agg(F.when(F.coalesce(mapped & F.bool_and("causality"), F.lit(False)), "PROCEED").otherwise("SAFE").alias("decision"))


def is_locatable(level: Column) -> Column:
    """Whether an anchor of this level has a place in code."""
    return F.lower(level).isin("concrete", "assumed")


def requires_assumption(level: Column) -> Column:
    return F.lower(level).isin("assumed", "conceptual")


def is_complete(anchors: Column) -> Column:
    """Whether there is an anchor at all."""
    return F.coalesce(F.size(anchors) > 0, F.lit(False))


def candidate_nodes(nodes: DataFrame, flow: DataFrame, accesses: DataFrame, changed: DataFrame, other: DataFrame | None = None, depth: int = 10) -> DataFrame:
    """(func_id, node, reasons): where anchors may be, seen from a patch's changed lines (func_id, line).

    changed: the nodes that start on those lines. reach: nodes whose code the other version's changes newly reach, given
    as other (func_id, code); see newly_reached(). body: what follows a changed condition, until the flow parts again,
    `depth` steps at most. variable: all other nodes that define or use a variable of the nodes found so far; where those
    have none, of any variable that the function defines. One function is one group.
    """

    def run(key, left, right):
        part = {k: g for k, g in left.groupby("what")}
        none = left.iloc[:0]
        after: dict[str, list] = {}
        for src, dst in zip(part.get("flow", none)["a"], part.get("flow", none)["b"], strict=True):
            after.setdefault(src, []).append(dst)
        own = part.get("node", none)
        kind, code = dict(zip(own["a"], own["b"], strict=True)), dict(zip(own["a"], own["code"], strict=True))
        lines_, codes = set(right["line"].dropna()), set(right["code"].dropna())
        why: dict[str, set] = {n: {"changed"} for n, line in zip(own["a"], own["line"], strict=True) if line in lines_}
        for n in [n for n in why if kind[n] == "CONDITION"]:
            work, seen = deque((m, 0) for m in after.get(n, ())), set()
            while work:
                m, d = work.popleft()
                if m in seen or d > depth or m not in kind:
                    continue
                seen.add(m)
                why.setdefault(m, set()).add("body")
                if len(after.get(m, ())) == 1:
                    work.extend((x, d + 1) for x in after[m])
        for n, text in code.items():
            if text in codes:
                why.setdefault(n, set()).add("reach")
        touched = part.get("access", none)
        names = {v for n, v in zip(touched["a"], touched["b"], strict=True) if n in why} or {v for v, how in zip(touched["b"], touched["code"], strict=True) if how == "def"}
        for n, v in zip(touched["a"], touched["b"], strict=True):
            if v in names and n not in why:
                why[n] = {"variable"}
        return pd.DataFrame([(key[0], n, sorted(w)) for n, w in sorted(why.items())], columns=["func_id", "node", "reasons"])

    shown = nodes.where(~F.col("type").isin("ENTRY", *SILENT))
    rows = shown.select("func_id", F.lit("node").alias("what"), F.col("node").alias("a"), F.col("type").alias("b"), "line", "code")
    rows = rows.unionAll(flow.select("func_id", F.lit("flow"), "src", "dst", F.lit(0), F.lit("")))
    rows = rows.unionAll(accesses.select("func_id", F.lit("access"), "node", "var", F.lit(0), "access"))
    given = changed.select("func_id", "line", F.lit(None).cast("string").alias("code"))
    if other is not None:
        given = given.unionAll(other.select("func_id", F.lit(None).cast("int"), "code"))
    return by_function(rows, given).applyInPandas(run, "func_id string, node string, reasons array<string>")


def newly_reached(old: tuple[DataFrame, DataFrame, DataFrame], new: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(func_id, code): code that the flow reaches from the changed lines of the new version and not from those of the old.

    A version is (nodes, flow, changed): changed has func_id and line.
    """

    def reached(nodes: DataFrame, flow: DataFrame, changed: DataFrame) -> DataFrame:
        starts = nodes.join(changed.select("func_id", "line").distinct(), ["func_id", "line"], "left_semi").select("func_id", "node")

        def run(key, left, right):
            after: dict[str, list] = {}
            for src, dst in zip(left["src"], left["dst"], strict=True):
                after.setdefault(src, []).append(dst)
            seen: set[str] = set()
            work = [m for n in right["node"] for m in after.get(n, ())]
            while work:
                n = work.pop()
                if n not in seen:
                    seen.add(n)
                    work.extend(after.get(n, ()))
            return pd.DataFrame([(key[0], n) for n in sorted(seen)], columns=["func_id", "node"])

        found = by_function(flow, starts).applyInPandas(run, "func_id string, node string")
        return nodes.where("code <> ''").join(found, ["func_id", "node"], "left_semi").select("func_id", "code").distinct()

    return reached(*new).join(reached(*old), ["func_id", "code"], "left_anti")


def quality(slices: DataFrame) -> DataFrame:
    """slices (anchors array, anchor_lines array, line_nos array) with valid, and why not: a slice needs an anchor, a line,
    and a line of an anchor."""
    reason = (
        F.when(~is_complete(F.col("anchors")), "no anchor")
        .when(F.coalesce(F.size("line_nos"), F.lit(0)) <= 0, "empty slice")
        .when(~F.coalesce(F.arrays_overlap("line_nos", "anchor_lines"), F.lit(False)), "no anchor in slice")
    )
    return slices.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def listed(items: Column, most: int) -> Column:
    """The first items of an array of texts on lines, and how many more there are."""
    left = F.size(items) - most
    return F.concat_ws("\n", F.slice(items, 1, most), F.when(left > 0, F.concat(F.lit("... "), left.cast("string"), F.lit(" more"))))
