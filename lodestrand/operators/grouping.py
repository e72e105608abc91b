"""Patches of a commit as groups: edges between patches, components, refinement, and the same for their hunks.

patches: commit, id, file, func, diff. A commit's patches are few and belong together, so a component is one group of
rows; edges and components are joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import diff_features, diff_side
from lodestrand.operators import graphs

def with_features(items: DataFrame, diff_col: str = "diff") -> DataFrame:
    """items with calls, members, tokens and the sets of lines that the diff deletes and adds."""
    made = items.withColumn("_f", diff_features(F.col(diff_col)))
    return made.select("*", "_f.calls", "_f.members", "_f.tokens", diff_side(F.col(diff_col), "-").alias("deleted"), diff_side(F.col(diff_col), "+").alias("added")).drop("_f")


def patch_edges(featured: DataFrame) -> DataFrame:
    """(commit, a, b, type): calls of a patched function, and members that patches of one file share.

    A call goes to the function of its own file, else to that of the only file that has it; the first id of several.
    Users of a member are linked with the one before, which joins the same components without all pairs.
    """
    calls = featured.select("commit", F.col("id").alias("a"), F.col("file").alias("_from"), F.explode("calls").alias("func"))
    made = calls.join(featured.select("commit", "func", F.col("id").alias("b"), F.col("file").alias("_to")), ["commit", "func"]).where("a <> b")
    of_call = Window.partitionBy("commit", "a", "func")
    near = F.max((F.col("_from") == F.col("_to")).cast("int")).over(of_call)
    only = F.size(F.collect_set("_to").over(of_call)) == 1
    fits = made.withColumns({"_near": near, "_only": only}).where("(_near = 1 and _from = _to) or (_near = 0 and _only)")
    called = fits.groupBy("commit", "a", "func").agg(F.min("b").alias("b")).select("commit", "a", "b").distinct().withColumn("type", F.lit("call"))
    used = featured.select("commit", "file", "id", F.explode("members").alias("member")).distinct()
    last = F.lag("id").over(Window.partitionBy("commit", "file", "member").orderBy("id"))
    shared = used.select("commit", last.alias("a"), F.col("id").alias("b")).where("a is not null").distinct()
    both = called.select("commit", "a", "b").unionAll(called.select("commit", F.col("b").alias("a"), F.col("a").alias("b")))
    return called.unionByName(shared.join(both, ["commit", "a", "b"], "left_anti").withColumn("type", F.lit("data")))


def hunks(patches: DataFrame) -> DataFrame:
    """(commit, id, parent, at, file, func, diff): the hunks of each patch; what stands before the first header, or a
    diff without headers, is one too. `at` is the hunk's first line in its diff."""
    rows = patches.select("commit", F.col("id").alias("parent"), "file", "func", F.posexplode(F.split("diff", "\n")).alias("i", "line"))
    order = Window.partitionBy("commit", "parent").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("_h", F.sum(F.col("line").startswith("@@").cast("int")).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n")
    made = numbered.groupBy("commit", "parent", "file", "func", "_h").agg(F.min("i").alias("at"), text.alias("diff"))
    return made.select("commit", F.concat_ws("#", "parent", "at").alias("id"), "parent", "at", "file", "func", "diff")


def hunk_edges(featured: DataFrame) -> DataFrame:
    """(commit, a, b, type), a < b: hunks of one patch that share a token, and hunks of different patches of one file that
    share a member. Hunks that share a name meet on it, not on all pairs of a commit."""

    def pairs(names: str, inside: bool) -> DataFrame:
        each = featured.select("commit", "file", "parent", "id", F.explode(names).alias("name"))
        x, y = each.alias("x"), each.alias("y")
        on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("commit", "file", "name")] + [F.col("x.id") < F.col("y.id")]
        same = F.col("x.parent") == F.col("y.parent")
        return x.join(y, on + [same if inside else ~same]).select("x.commit", F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()

    return pairs("tokens", True).withColumn("type", F.lit("data_intra")).unionByName(pairs("members", False).withColumn("type", F.lit("data_inter")))


def is_movement(a: dict, b: dict) -> bool:
    """What one deletes the other adds."""
    return bool(a["deleted"] & b["added"] or a["added"] & b["deleted"])


def is_parallel(a: dict, b: dict) -> bool:
    """One function name in two files, or the same line deleted or added in both."""
    return bool(a["func"] and a["func"] == b["func"] and a["file"] != b["file"] or a["deleted"] & b["deleted"] or a["added"] & b["added"])


def refined(items: list[dict], calls: set[frozenset]) -> list[list[str]]:
    """The ids of one component as groups in which no two are parallel instances.

    Where a name is patched in several files and no call crosses files, each file is a group. Else parallel instances
    that neither call each other nor move code between them are coloured apart, those with most conflicts first, ties by
    order; an item without conflicts joins every group that it shares calls with, directly or through such items; those
    that join none are grouped by the calls among them.
    """
    ids = [x["id"] for x in items]
    of = {x["id"]: x for x in items}
    if len(ids) < 2:
        return [ids]
    files: dict[str, set] = {}
    for x in items:
        files.setdefault(x["func"], set()).add(x["file"])
    crossing = any(len({of[i]["file"] for i in pair if i in of}) > 1 for pair in calls if pair <= of.keys())
    if any(name and len(where) > 1 for name, where in files.items()) and not crossing:
        by_file: dict[str, list] = {}
        for x in items:
            by_file.setdefault(x["file"], []).append(x["id"])
        return list(by_file.values())
    against: dict[str, set] = {}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if frozenset((a, b)) not in calls and not is_movement(of[a], of[b]) and is_parallel(of[a], of[b]):
                against.setdefault(a, set()).add(b)
                against.setdefault(b, set()).add(a)
    if not against:
        return [ids]
    colour: dict[str, int] = {}
    for n in sorted(against, key=lambda n: (-len(against[n]), ids.index(n))):
        taken = {colour.get(m) for m in against[n]}
        colour[n] = next(c for c in range(len(ids)) if c not in taken)
    near: dict[str, set] = {}
    for pair in calls:
        a, b = sorted(pair) if len(pair) == 2 else (None, None)
        if a in of and b in of:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    neutral, out, joined = [i for i in ids if i not in against], [], set()

    def reach(start: list[str]) -> list[str]:
        found, work = list(start), list(start)
        while work:
            for m in sorted(near.get(work.pop(), ()), key=ids.index):
                if m in neutral and m not in found:
                    found.append(m)
                    work.append(m)
        return found

    for c in sorted(set(colour.values())):
        group = reach([i for i in ids if colour.get(i) == c])
        joined.update(group)
        out.append(group)
    for i in neutral:
        if i not in joined:
            group = reach([i])
            joined.update(group)
            out.append(group)
    return out


def refine(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(commit, id, group_no) of items (commit, part, id, file, func, deleted, added); group_no counts from 0 in a part and
    an item can be in several groups. A part is handled as one group of rows."""

    def run(key, left, right):
        calls = {frozenset((a, b)) for a, b, kind in zip(right["a"], right["b"], right["type"], strict=True) if kind == "call"}
        items = [{**r, "deleted": set(r["deleted"]), "added": set(r["added"])} for r in left.sort_values("id").to_dict("records")]
        rows = [(key[0], key[1], i, n) for n, group in enumerate(refined(items, calls)) for i in group]
        return pd.DataFrame(rows, columns=["commit", "part", "id", "group_no"])

    inside = edges.join(parts.select("commit", F.col("id").alias("a"), "part"), ["commit", "a"]).select("commit", "part", "a", "b", "type")
    items = parts.select("commit", "part", "id", "file", "func", "deleted", "added")
    return graphs.by_function(items, inside, "commit", "part").applyInPandas(run, "commit string, part string, id string, group_no int")


def function_groups(patches: DataFrame) -> DataFrame:
    """(commit, part, id, group_no): patches that call each other or share members of a file, and each such component
    refined."""
    featured = with_features(patches)
    edges = patch_edges(featured)
    name = lambda c: F.concat_ws("\x00", "commit", c)
    found = graphs.components(featured.select(name("id").alias("id")), edges.select(name("a").alias("a"), name("b").alias("b")))
    parts = featured.join(found.select(F.split("id", "\x00")[0].alias("commit"), F.split("id", "\x00")[1].alias("id"), F.split("component", "\x00")[1].alias("part")), ["commit", "id"])
    return refine(parts, edges)


def hunk_groups(patches: DataFrame, groups: DataFrame) -> DataFrame:
    """(commit, part, group_no, hunk_group, id, diff): every function group cut again by its hunks, and each hunk group's
    diffs put together again by patch."""
    cut = with_features(hunks(patches))
    member = groups.select("commit", F.concat_ws("/", "part", "group_no").alias("part"), F.col("id").alias("parent"))
    parts = cut.join(member, ["commit", "parent"])
    found = refine(parts, hunk_edges(cut)).withColumnRenamed("group_no", "hunk_group")
    whole = found.join(cut.select("commit", "id", "parent", "at", "diff"), ["commit", "id"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "diff"))), lambda s: s["diff"]), "\n")
    merged = whole.groupBy("commit", "part", "hunk_group", F.col("parent").alias("id")).agg(text.alias("diff"))
    return merged.select("commit", F.substring_index("part", "/", 1).alias("part"), F.substring_index("part", "/", -1).cast("int").alias("group_no"), "hunk_group", "id", "diff")
