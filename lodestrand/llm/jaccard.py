"""Jaccard joins of word shingle sets by grouped prefixes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm.graph import components
from lodestrand.llm.tables import Groups, materialize, small_batches
from lodestrand.llm.words import BYTE_VALUES, U, mix, prefix_sums, span_hashes, text_slices, words
from lodestrand.llm.workers import settled

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 64-bit words of a set's parity map.
MAP_WORDS = 8
#: Frequency classes for a doubling.
CLASSES = 8
#: The sketch is added up in blocks of 2 ** BLOCK_BITS slots: of each, one worker gets as many copies as there are tasks.
BLOCK_BITS = 13


@dataclass(frozen=True)
class Settings:
    """Sets of `words`-word shingles link when 100 * intersection >= percent * union."""

    words: int = 4
    percent: int = 85
    sketch_bits: int = 22
    filter_bits: int = 21

    def least_common(self, total: Column) -> Column:
        """The fewest common shingles of two linked sets whose sizes add up to total."""
        return F.ceil(self.percent * total / F.lit(100 + self.percent))

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many of its rarest shingles a set of size n posts: linked sets share one of these."""
        return np.where(n > 0, n + (-self.percent * n // 100) + 1, 0)

    def second_prefix(self, n: np.ndarray) -> np.ndarray:
        """How many shingles behind an equal prefix two linked sets of size n share one of."""
        return np.minimum(n - self.prefix(n), n + (-2 * self.percent * n // (100 + self.percent)) + 1)


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every place: 64-bit hashes of the texts' n-word shingles; a text with fewer words has one, all
    of it."""
    data = LOWER[data]
    starts, ends, word_bounds = words(data, bounds)
    hashes = span_hashes(prefix_sums(BYTE_VALUES[data]), starts, ends)
    count = np.diff(word_bounds)
    each = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), each)
    at = word_bounds[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    return row, span_hashes(prefix_sums(hashes), at, at + np.minimum(n, count[row]))


def _once(row: np.ndarray, made: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row and made in an order that brings equal pairs together, each pair once."""
    row, made = row[order], made[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (made[1:] != made[:-1])
    return row[first], made[first]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) pairs, each once, sorted."""
    row, made = shingle_hashes(data, bounds, n)
    return _once(row, made, np.lexsort((made, row)))


def ranked_sets(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle) pairs, each once, every text's rarest shingles first, and the size of every set."""
    row, made = shingle_hashes(data, bounds, settings.words)
    rank = row << 8 | classes[(made >> U(64 - settings.sketch_bits)).astype(np.int64)]
    row, made = _once(row, made, np.lexsort((made, rank)))
    return row, made, np.bincount(row, minlength=len(bounds) - 1)


def frequency_classes(texts: DataFrame, settings: Settings) -> np.ndarray:
    """For every slot of a sketch, the class of the number of shingles that fall into it, CLASSES to a doubling.

    All shingles of all texts are counted. The sketch has 2 ** sketch_bits slots whatever the number of texts; it only decides the
    order of shingles, which any table would keep right.
    """
    bits, block = settings.sketch_bits, 1 << min(BLOCK_BITS, settings.sketch_bits)

    def count(batches):
        slots = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, data, bounds in text_slices(batch.column(0)):
                np.add.at(slots, (shingle_hashes(data, bounds, settings.words)[1] >> U(64 - bits)).astype(np.int64), 1)
        if slots.any():
            small = np.minimum(slots, 65535).astype("<u2").reshape(-1, block)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(small)), pa.int32()), pa.array([s.tobytes() for s in small], pa.binary())], names=["block", "counts"])

    def total(key, group):
        out = np.zeros(block, np.uint64)
        for blob in group.column("counts"):
            out += np.frombuffer(blob.as_buffer(), "<u2")
        classes = np.minimum(np.round(CLASSES * np.log2(out + 1.0)), 255).astype(np.uint8)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "classes": [classes.tobytes()]})

    merged = texts.mapInArrow(settled(count), "block int, counts binary").groupBy("block").applyInArrow(total, "block int, classes binary")
    out = np.zeros(1 << bits, np.uint8)
    for row in merged.collect():
        out[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["classes"], np.uint8)
    return out


def prefix_rows(docs: DataFrame, classes: np.ndarray, settings: Settings) -> DataFrame:
    """(_id, n, k1, k2, pk, tokens, b0...) of every document: its set's size, a 128-bit key of the set, a key of its
    prefix, the prefix itself, rarest first, and the set's parity map.

    Two sets that link share one of their n - ceil(percent * n / 100) + 1 first shingles in any common order. The
    parity maps of two sets differ in no more bits than the sets do in shingles.
    """
    held = docs.sparkSession.sparkContext.broadcast(classes)
    size = 64 * MAP_WORDS

    def run(batches):
        table = held.value
        for batch in batches:
            for first, data, bounds in text_slices(batch.column(1)):
                rows = len(bounds) - 1
                row, made, n = ranked_sets(data, bounds, table, settings)
                ordered, ends, take = made.astype(np.int64), np.cumsum(n), settings.prefix(n)
                spread, full = mix(made + U(29)), n > 0
                k1, k2 = np.zeros(rows, U), np.zeros(rows, U)
                if full.any():
                    k1[full] = np.add.reduceat(spread, (ends - n)[full])
                    k2[full] = np.bitwise_xor.reduceat(mix(spread + U(31)), (ends - n)[full])
                parity = (np.bincount(row * size + (mix(made + U(37)) >> U(64 - 9)).astype(np.int64) % size, minlength=rows * size) & 1).astype(np.uint8)
                maps = np.packbits(parity.reshape(rows, size), axis=1, bitorder="little").view("<i8")
                starts = ends - n
                cuts = np.concatenate([[0], np.cumsum(take)])
                flat = ordered[np.repeat(starts - cuts[:-1], take) + np.arange(cuts[-1])]
                sums = prefix_sums(flat.astype(U))
                pk = span_hashes(sums, cuts[:-1], cuts[1:])
                part = slice(first, first + rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part], pa.array(n, pa.int64()), pa.array(k1.astype(np.int64)), pa.array(k2.astype(np.int64)), pa.array(pk.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)), *(pa.array(np.ascontiguousarray(maps[:, i])) for i in range(MAP_WORDS)),
                    ],
                    names=["_id", "n", "k1", "k2", "pk", "tokens", *MAPS],
                )

    shape = f"_id {docs.schema['_id'].dataType.simpleString()}, n long, k1 long, k2 long, pk long, tokens array<long>, " + ", ".join(f"{m} long" for m in MAPS)
    return docs.mapInArrow(settled(run), shape)


MAPS = [f"b{i}" for i in range(MAP_WORDS)]


def chosen_rows(docs: DataFrame, ids: DataFrame, settings: Settings):
    """(rows, pick): docs with a slot for every id, and a function that keeps of a batch (_id, text, slot) the rows whose
    slot an id of ids has; None if there are no ids.

    The bit map of slots has 2 ** filter_bits bits at any size. It keeps most other documents from being cut into
    shingles; a join on the ids has to follow.
    """
    slot = F.pmod(F.xxhash64("_id"), F.lit(1 << settings.filter_bits))
    bits = np.zeros(1 << settings.filter_bits, bool)
    packed = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    for row in packed.collect():
        bits[row["w"] * 64 : row["w"] * 64 + 64] = np.unpackbits(np.array([row["bits"]], "<i8").view(np.uint8), bitorder="little")
    if not bits.any():
        return None
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def pick(batches):
        wanted = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(wanted[batch.column(2).to_numpy()]))

    return docs.select("_id", "text", slot.alias("s")), pick


def sets_of(docs: DataFrame, ids: DataFrame, settings: Settings) -> DataFrame:
    """(_id, shingles) of the documents in ids."""
    shape = f"_id {docs.schema['_id'].dataType.simpleString()}, shingles array<long>"
    some = chosen_rows(docs, ids, settings)
    if some is None:
        return docs.sparkSession.createDataFrame([], shape)
    rows, pick = some

    def run(batches):
        for batch in pick(batches):
            for first, data, bounds in text_slices(batch.column(1)):
                row, made = shingle_sets(data, bounds, settings.words)
                cuts = np.searchsorted(row, np.arange(len(bounds)))
                part = slice(first, first + len(bounds) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(made.astype(np.int64)))], names=["_id", "shingles"]
                )

    return rows.mapInArrow(settled(run), shape).join(ids, "_id", "left_semi")


def second_prefixes(docs: DataFrame, ids: DataFrame, classes: np.ndarray, settings: Settings) -> DataFrame:
    """(_id, n, pk, token) of the documents in ids, where pk is the key of the prefix: the shingles behind it of which two
    linked sets of one size and prefix share one."""
    shape = f"_id {docs.schema['_id'].dataType.simpleString()}, n long, pk long, tokens array<long>"
    some = chosen_rows(docs, ids, settings)
    if some is None:
        made = docs.sparkSession.createDataFrame([], shape)
    else:
        rows, pick = some
        held = docs.sparkSession.sparkContext.broadcast(classes)

        def run(batches):
            for batch in pick(batches):
                for first, data, bounds in text_slices(batch.column(1)):
                    _, made, n = ranked_sets(data, bounds, held.value, settings)
                    ordered = made.astype(np.int64)
                    starts = np.cumsum(n) - n
                    front, more = settings.prefix(n), settings.second_prefix(n)
                    cuts = np.concatenate([[0], np.cumsum(front)])
                    prefix = ordered[np.repeat(starts - cuts[:-1], front) + np.arange(cuts[-1])]
                    pk = span_hashes(prefix_sums(prefix.astype(U)), cuts[:-1], cuts[1:])
                    ends = np.concatenate([[0], np.cumsum(more)])
                    tail = ordered[np.repeat(starts + front - ends[:-1], more) + np.arange(ends[-1])]
                    part = slice(first, first + len(n))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[part], pa.array(n, pa.int64()), pa.array(pk.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tail))],
                        names=["_id", "n", "pk", "tokens"],
                    )

        made = rows.mapInArrow(settled(run), shape).join(ids, "_id", "left_semi")
    return made.select("_id", "n", "pk", F.explode("tokens").alias("token")).distinct()


def verified(docs: DataFrame, pairs: DataFrame, signs: DataFrame, settings: Settings) -> DataFrame:
    """Those of pairs (a, b) that link, each once: first by size and parity map, then by the whole sets."""
    left, right = signs.select([F.col(c).alias(f"a_{c}") for c in signs.columns]), signs.select([F.col(c).alias(f"b_{c}") for c in signs.columns])
    total = F.col("a_n") + F.col("b_n")
    apart = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in MAPS), F.lit(0))
    close = (apart <= total - 2 * settings.least_common(total)) & (100 * F.least("a_n", "b_n") >= settings.percent * F.greatest("a_n", "b_n"))
    likely = pairs.join(left, F.col("a") == F.col("a__id")).join(right, F.col("b") == F.col("b__id")).where(close).select("a", "b").distinct()
    likely = materialize(likely)
    ids = likely.select(F.col("a").alias("_id")).unionAll(likely.select("b")).distinct()
    sets = materialize(sets_of(docs, ids, settings))
    first, second = sets.select(F.col("_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("_id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    total = F.size("x") + F.size("y")
    return materialize(likely.join(first, "a").join(second, "b").where(common >= settings.least_common(total)).select("a", "b").distinct())


def jaccard_components(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents by the Jaccard similarity of their shingle sets and return each one's component.

    1. Documents with equal sets are one (two-level grouping, so a third of all rows may share a set). Of these,
       documents with equal size and equal prefix are one group, whose prefix is posted once.
    2. Shingles are ordered by the frequency class of a sketch, rarest first, so shingles of common passages fall
       behind the prefixes.
    3. Every posted shingle links its groups to the one that has it earliest, in most cases the least changed of a
       family of copies. These pairs, one for each posting, are expanded to members and verified.
    4. Pairs of groups that share a shingle and are still in different components are joined on it, filtered by size
       and by position: where a shingle is the first that two prefixes share, they have at most what follows in common. The
       survivors are expanded and verified too. So a family of copies costs its size, not its square.
    5. Members of one group, which have been compared with its head only, are joined in the same way on the shingles
       behind their common prefix if the group's members still are in different components. So no pair of linked
       documents is left in two components.

    Verification compares parity maps, which never reject a link, and then whole sets.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. Rows that repeat an id are
    one document with the links of all its rows. A null id links with nothing and is its own component (null). An
    empty table gives an empty result. Other columns are not read. Shingles are 64-bit hashes.

    Returns doc_id, n_shingles, component_id.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    classes = frequency_classes(texts.select("text"), settings)
    all_rows = materialize(prefix_rows(texts, classes, settings))
    keys = ["n", "k1", "k2"]
    equal = Groups(all_rows.select("_id", *keys), keys, "_id")
    whole = materialize(equal.whole.select(*keys, "least"))
    reps = all_rows.where("n > 0").join(whole.where("least is not null").select(F.col("least").alias("_id"), *keys), ["_id", *keys])
    reps = materialize(reps.dropDuplicates(["_id", *keys]))
    signs = reps.select("_id", "n", *MAPS)
    heads = reps.groupBy("n", "pk").agg(F.min("_id").alias("gid"))
    members = materialize(reps.select("_id", "n", "pk").join(heads, ["n", "pk"]).select("gid", "_id"))
    posted = reps.join(heads, ["n", "pk"]).where(F.col("_id") == F.col("gid")).select("gid", "n", F.posexplode("tokens").alias("pos", "token"))
    of_token = Window.partitionBy("token")
    hub = F.first(F.struct("gid", "n", "pos")).over(of_token.orderBy("pos", "n", "gid"))
    shared = materialize(posted.withColumns({"_many": F.count(F.lit(1)).over(of_token), "hub": hub}).where("_many > 1").drop("_many"))

    def may_link(n1: str, p1: str, n2: str, p2: str) -> Column:
        total = F.col(n1) + F.col(n2)
        sizes = 100 * F.least(n1, n2) >= settings.percent * F.greatest(n1, n2)
        return sizes & (F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2)) >= settings.least_common(total))

    stars = shared.where(F.col("gid") != F.col("hub.gid")).where(may_link("n", "pos", "hub.n", "hub.pos")).select(F.col("hub.gid").alias("a"), "gid").distinct()
    first = stars.join(members, "gid").select("a", F.col("_id").alias("b"))
    first = first.unionAll(members.where("gid <> _id").select(F.col("gid").alias("a"), F.col("_id").alias("b")))
    links = verified(texts, first, signs, settings)
    found = components(links)

    at = members.join(found.withColumnRenamed("node", "_id"), "_id", "left").select("gid", "_id", F.coalesce("component", "_id").alias("comp"))
    placed = materialize(shared.drop("hub").join(at, "gid").select("token", "_id", "n", "pos", "comp"))
    split = placed.groupBy("token").agg(F.min("comp").alias("_c"), F.max("comp").alias("_d")).where("_c <> _d").select("token")
    open_ = placed.join(split, "token", "left_semi")
    x, y = (open_.select("token", *(F.col(c).alias(f"{k}{c}") for c in ("_id", "n", "pos", "comp"))) for k in "xy")
    rest = x.join(y, "token").where("x_id < y_id and xcomp <> ycomp").where(may_link("xn", "xpos", "yn", "ypos")).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()
    apart = at.groupBy("gid").agg(F.min("comp").alias("_c"), F.max("comp").alias("_d")).where("_c <> _d").select("gid")
    loose = materialize(at.join(apart, "gid", "left_semi").select("_id", "comp").distinct())
    tails = materialize(second_prefixes(texts, loose.select("_id"), classes, settings).join(loose, "_id"))
    u, v = (tails.select("n", "pk", "token", *(F.col(c).alias(f"{k}{c}") for c in ("_id", "comp"))) for k in "uv")
    inner = u.join(v, ["n", "pk", "token"]).where("u_id < v_id and ucomp <> vcomp").select(F.col("u_id").alias("a"), F.col("v_id").alias("b")).distinct()
    more = verified(texts, rest.unionAll(inner).distinct(), signs, settings)
    ends = [found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("a", "b")]
    bridges = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    over = components(bridges).select(F.col("node").alias("_part"), F.col("component").alias("_over"))
    parts = whole.join(found.select(F.col("node").alias("least"), "component"), "least", "left").withColumn("_part", F.coalesce("component", "least"))
    answers = parts.join(over, "_part", "left").select(*keys, F.coalesce("_over", "_part").alias("_comp"))
    own = F.when((F.col("n") == 0) | F.col("_id").isNull(), F.col("_id")).otherwise(F.col("_comp"))
    return equal.hand_down(answers).select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
