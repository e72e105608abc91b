"""Best-fit packing of token sequences by exact complements."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm.tables import materialize, salt, small_batches
from lodestrand.llm.workers import settled

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Chunks of text, and words, in a generation of what a Python worker remembers, and bytes of text encoded at once.
MEMO, STEP = 250_000, 8 << 20
#: The pattern that ChunkEncoder takes apart itself. A tokenizer with another one encodes whole texts.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class Memo(dict):
    """What was asked for lately, in two generations: when the newer one is full the older one is forgotten."""

    def __init__(self, make, most: int = 0):
        self.make, self.most, self.older = make, most or MEMO, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class ChunkEncoder:
    """Ids of whole texts, chunk by chunk.

    Where the tokenizer drops white space and its normaliser and word pattern never look across it, a text's ids are
    those of its chunks between spaces and line ends in a row. Chunks are numbered by Arrow, and a chunk's ids are
    remembered. A chunk of printable ASCII is cut by the tokenizer's own pattern, and its pieces go to the merge model in
    lower case; so are words of Latin letters. All other chunks, and special tokens, are encoded as they are. Any other
    tokenizer gets every text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks, self.pieces = Memo(self._chunk), Memo(self._piece)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.by_chunk = _cuts_at_white_space(told)
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        if self.by_chunk:
            letters = filter(str.isalpha, map(chr, range(0x80, 0x100)))
            self.latin = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece of the word pattern in lower case, as the merge model spells it."""
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            chunk_ = chunk.lower()
            if chunk.isalpha():
                return self.pieces[chunk_]
            if chunk[-1:] in ".," and chunk[:-1].isalpha():
                return self.pieces[chunk_[:-1]] + self.pieces[chunk[-1]]
            if chunk.isprintable() and not any(t in chunk for t in self.special):
                return b"".join([self.pieces[p] for p in ASCII_PIECE.findall(chunk_)])
        elif chunk.isalpha() and max(chunk) <= "\xff":  # lower case is all that the normaliser changes
            return self.pieces[chunk.lower().translate(self.latin)]
        elif chunk[-1:] in ".," and chunk[:-1].isalpha() and max(chunk) <= "\xff":
            return self.pieces[chunk[:-1].lower().translate(self.latin)] + self.pieces[chunk[-1]]
        return self._encode(chunk)

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if not self.by_chunk:
            yield from (self._encode(text) for text in column.to_pylist())
            return
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())])
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + STEP, side="right")) - 1)
            text = pc.replace_substring(column[at:end], "\n", " ")
            if not any(pc.any(pc.match_substring(text, t, ignore_case=True)).as_py() for t in self.special):
                text = pc.ascii_lower(text)  # fewer chunks; a special token is one in its own case only
            parts = pc.split_pattern(text, " ")
            coded = parts.flatten().dictionary_encode()
            ids = pa.array(map(self.chunks.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary()).take(coded.indices)
            cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
            del text, parts, coded
            _, offsets, data = ids.buffers()
            bounds = np.frombuffer(offsets, np.int64)[cuts]
            whole = memoryview(data) if data is not None else memoryview(b"")
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield bytes(whole[a:b])
            at = end


def _cuts_at_white_space(told: dict) -> bool:
    """Whether a tokenizer file describes one that ChunkEncoder can take apart: NFC, white space and lower case as its
    normaliser, WORD_PATTERN and the byte alphabet behind it, and merges with word ends that nothing else follows."""
    steps = (told.get("normalizer") or {}).get("normalizers") or []
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0].get("pattern"), cuts[0].get("behavior"), cuts[0].get("invert")) == ({"Regex": WORD_PATTERN}, "Removed", True)
        and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
        and told.get("model", {}).get("type") == "BPE"
        and not told["model"].get("dropout")
        and told.get("post_processor") is None and told.get("truncation") is None
    )


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Documents as ids with an end id, cut where they are longer than capacity: a row per piece."""

    def cut(batches):
        own = ChunkEncoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for doc_id, flat in zip(ids, own.encode(batch.column(1)), strict=True):
                flat += end
                for piece, at in enumerate(range(0, len(flat), 4 * capacity)):
                    part = flat[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(settled(cut), PIECES)


class SumIndex:
    """Which single lengths, pairs and triples that are still available have a given sum.

    For every sum the index names the longest length that opens a pair, and one that opens a triple, of it. Counts only
    fall, so an entry that has become void never comes back: it moves on to the next shorter opening when it is next
    looked at, and an index over lengths up to n moves at most n * n times in all, however many pieces there are.
    """

    def __init__(self, counts: np.ndarray):
        self.free = counts.astype(np.int64).tolist()
        size, lengths = len(counts), np.flatnonzero(counts)
        pairs, triples = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for n in lengths:
            pairs[n + lengths[lengths <= min(n, size - 1 - n)]] = n
        sums = np.flatnonzero(pairs)
        for n in lengths:
            triples[n + sums[sums <= size - 1 - n]] = n
        self.pairs, self.triples = pairs.tolist(), triples.tolist()

    def pair(self, total: int, held: int = 0) -> tuple[int, ...]:
        """Two available lengths with this sum, the longer one first, besides one of length held; or none."""
        free, n, moves = self.free, self.pairs[total], True
        while n and 2 * n >= total:
            other = total - n
            if other > 0 and free[n] and free[other] > (other == n):
                if moves:
                    self.pairs[total], moves = n, False
                if free[held] > (held == n) + (held == other) or not held:
                    return n, other
            n -= 1
        if moves:
            self.pairs[total] = 0
        return ()

    def triple(self, total: int) -> tuple[int, ...]:
        """Three available lengths with this sum, the longest first, or none."""
        n = self.triples[total]
        while n and 3 * n >= total:
            if self.free[n] and total > n and (two := self.pair(total - n, n)):
                self.triples[total] = n
                return n, *two
            n -= 1
        self.triples[total] = 0
        return ()

    def exact(self, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths that fill gap exactly, or none."""
        if self.free[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def fill_plan(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns of lengths that fill sequences, with how often each is used; counts[l] pieces have length l.

    The longest length left opens a sequence. What is left of it is looked up in the index of sums: a single length, a
    pair or a triple that is available fills it exactly; else the longest length that fits goes in (best fit), and what
    is then left is looked up again. A pattern is used as often as the counts allow, which leaves less of some length
    than the pattern takes of it, so there are a few times capacity patterns at most, whatever the number of documents.
    """
    index = SumIndex(np.concatenate([counts, np.zeros(max(0, capacity + 1 - len(counts)), np.int64)]))
    free, plan, top = index.free, [], capacity
    while True:
        while top and not free[top]:
            top -= 1
        if not top:
            return plan
        used: dict[int, int] = {}
        gap, fits = capacity, capacity

        def take(*lengths: int) -> None:
            for n in lengths:
                used[n] = used.get(n, 0) + 1
                free[n] -= 1

        take(top)
        gap -= top
        while gap > 0:
            if exact := index.exact(gap):
                take(*exact)
                break
            fits = min(fits, gap)
            while fits and not free[fits]:
                fits -= 1
            if not fits:
                break
            take(fits)
            gap -= fits
        times = 1 + min(free[n] // k for n, k in used.items())
        for n, k in used.items():
            free[n] -= k * (times - 1)
        plan.append((sorted(used.items(), reverse=True), times))


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by their rank in it: a row per length of a pattern, by length and first rank."""
    rows, taken, base = [], {}, 0
    for pattern, times in plan:
        at = 0
        for length, k in pattern:
            low = taken.get(length, 0)
            rows.append((length, low, k, base, at))
            taken[length] = low + k * times
            at += length * k
        base += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "low", "each", "base", "at"), columns, strict=True))


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1
) -> DataFrame:
    """Pack whole documents into sequences of at most capacity tokens.

    Only how many pieces have each length goes to the driver: at most capacity numbers. There fill_plan() forms
    patterns by exact complements. The plan's size depends on capacity alone, and a piece finds its sequence
    and offset from its rank among the pieces of its length. Ranks come from counts per (length, salt), so a length
    that a third of all pieces have is spread over many tasks.

    Null and empty texts are one end id. Rows that repeat an id are packed one by one; ranks among equal rows are
    arbitrary, which changes no column but sequence_id and offset. A null id is packed like any other. Columns other
    than id and text are not read. An empty table gives an empty result. Texts are encoded whole and cut only beyond
    capacity.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    small_batches(docs.sparkSession)
    pieces = materialize(token_pieces(docs, id_col, text_col, tokenizer, capacity, end_id).withColumn("_salt", salt("doc_id")))
    by_salt = pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    columns = slots(fill_plan(counts, capacity))

    def place(batches):
        key = columns["length"] << 44 | columns["low"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            row = np.searchsorted(key, length << 44 | rank, side="right") - 1
            nth = rank - columns["low"][row]
            each = columns["each"][row]
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(columns["base"][row] + nth // each), pa.array(columns["at"][row] + nth % each * length)],
                names=[*(batch.schema.names[:5]), "sequence_id", "offset"],
            )

    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = pieces.join(starts, ["length", "_salt"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.row_number().over(inside) - 1 + F.col("_before")).cast("long").alias("_rank")
    )
    return ranked.mapInArrow(settled(place), f"{PIECES}, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
