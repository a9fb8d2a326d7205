"""Documents into training sequences of fixed token capacity: shortest-pack-first over the length histogram."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import salted_row_number
from weftline.plans.durable import materialize

# Fixed value: how the vocabularies of rank files split text before merging (see their README).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("WEFTLINE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE encoder of a rank file, made once per worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _count(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in it:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "tokens"])

    return run


def token_lengths(documents: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id``, ``tokens``: the length of every whole text in tokens; NULL and empty texts have 0."""
    kind = documents.schema[doc].dataType.simpleString()
    return documents.select(F.col(doc).alias("id"), text).mapInArrow(_count(vocabulary), f"id {kind}, tokens long")


def _shortest_pack_first(histogram: Mapping[int, int], capacity: int, opened: int) -> list[tuple[int, list[int]]]:
    """One pass with ``opened`` empty packs to begin with; more are opened when the shortest is too full."""
    open_: dict[int, list[list]] = {}  # room left -> [count, chain of lengths]
    rooms: list[int] = []  # heap of minus room

    def put(room: int, count: int, lengths) -> None:
        if room not in open_:
            open_[room] = []
            heapq.heappush(rooms, -room)
        open_[room].append([count, lengths])

    if opened:
        put(capacity, opened, None)
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            while rooms and not open_[-rooms[0]]:
                del open_[-heapq.heappop(rooms)]
            room = -rooms[0] if rooms else 0
            if room < length:
                put(capacity - length, n, (length, None))
                break
            pack = open_[room][-1]
            k = min(n, pack[0])
            pack[0] -= k
            n -= k
            if not pack[0]:
                open_[room].pop()
            put(room - length, k, (length, pack[1]))
    out = []
    for packs in open_.values():
        for count, c in packs:
            lengths = []
            while c:
                lengths.append(c[0])
                c = c[1]
            if lengths:
                out.append((count, lengths[::-1]))
    return sorted(out, key=lambda p: (-p[1][0], p[1], p[0]))


def pack_histogram(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Packing patterns (count, lengths in order of placement) for a histogram of lengths 1..capacity.

    Shortest-pack-first: lengths are placed longest first, each in the pack with the most
    room, for as many packs of that pattern as there are items; a pattern used
    in part is split in two, and new packs are opened when the shortest is too full. Filling the shortest pack spreads
    what stays unused over all packs, so the number of packs to begin with is
    chosen by bisection between the least possible and what is opened unasked: the
    smallest that needs no further ones. The work depends on the numbers of
    lengths and patterns, not on the number of documents.
    """
    histogram = {x: n for x, n in histogram.items() if n > 0}
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    used = lambda p: sum(c for c, _ in p)
    best = _shortest_pack_first(histogram, capacity, 0)
    low = -(-sum(x * n for x, n in histogram.items()) // capacity)
    while low < used(best):
        middle = (low + used(best)) // 2
        tried = _shortest_pack_first(histogram, capacity, middle)
        if used(tried) <= middle:
            best = tried
        else:
            low = middle + 1
    return best


def placements(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): documents of a length, by rank, go to consecutive sequences from there."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in patterns:
        at = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), sequence, at))
            used[x] = used.get(x, 0) + count
            at += x
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(table: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (table[:, 0] << 40) + table[:, 1]
        for b in it:
            n, rank = b["n_tokens"].to_numpy(), b["rank"].to_numpy()
            row = np.searchsorted(key, (n << 40) + rank, "right") - 1
            empty = n == 0  # takes no room
            row = np.where(empty, 0, row)
            seq = np.where(empty, 0, table[row, 2] + rank - table[row, 1]) if len(table) else np.zeros(len(n), np.int64)
            off = np.where(empty, 0, table[row, 3]) if len(table) else np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([b["id"], b["part"], b["start"], b["n_tokens"], pa.array(seq), pa.array(off)], ["id", "part", "start", "n_tokens", "sequence_id", "sequence_offset"])

    return run


def pack_documents(documents: DataFrame, capacity: int = 2048, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document in training sequences of ``capacity`` tokens.

    ``doc_id``, ``part``, ``start`` (first token of the part in its document), ``n_tokens``, ``sequence_id``,
    ``sequence_offset``. A document is split only if longer than the capacity: into full
    parts, each a sequence of its own, and a rest. The driver sees the histogram
    of lengths (at most ``capacity`` rows) and the patterns made of it; documents find their
    sequence by their rank among those of equal length, a salted rank that keeps no
    length in one task. Empty and NULL texts take no room and stand in sequence 0;
    an empty table gives no rows. Ids should be unique; repeated ids are packed as separate rows.
    """
    lengths = materialize(token_lengths(documents, doc, text, vocabulary), "lengths")
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    parts = lengths.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    parts = parts.withColumn("start", (F.col("part") * F.lit(capacity)).cast("long"))
    parts = parts.withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("start"))).drop("tokens")
    histogram = {r["n_tokens"]: r["n"] for r in parts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram.pop(0, None)
    table = placements(pack_histogram(histogram, capacity))
    ranked = salted_row_number(parts, ["n_tokens"], ["id", "part"], "rank")
    kind = lengths.schema["id"].dataType.simpleString()
    out = ranked.select("id", "part", "start", "n_tokens", "rank").mapInArrow(_place(table), f"id {kind}, part int, start long, n_tokens long, sequence_id long, sequence_offset long")
    return out.withColumnRenamed("id", doc)


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Sequences, documents' parts, tokens and the share of the sequences' room that is unused."""
    per = packed.groupBy("sequence_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"))
    return per.agg(F.count(F.lit(1)).alias("sequences"), F.sum("parts").alias("parts"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.round(1 - F.sum("tokens") / (F.count(F.lit(1)) * capacity), 6).alias("unused"))
