"""Best-fit packing into bins of several permitted lengths.

Pieces are dealt by a hash into shards of about SHARD_ROWS, and each shard is packed on its own: longest
pieces first, each into the open bin with the least room that still takes it. Where none does, a bin of the
length is opened whose cost a token it can be expected to hold is least, given the piece and the shorter pieces
that are left for its room; so all lengths compete for every piece. At the end each bin shrinks to the
shortest permitted length that takes its contents. The cost of a length is itself plus its attention share.

Edge cases: documents longer than the longest length are cut into pieces of it, and nothing is dropped; null
and empty texts are one end token; ties go to the smaller doc_id and piece, then to the older bin, so packing is
deterministic; equal rows are packed each; null doc_ids are packed like others, in shards that follow their place in the table; an empty table gives no rows; other
columns are not read, so names can't clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, map_arrow, map_batches, shuffle_partitions
from .tokens import WordCache, count_of, default_vocabulary

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD_ROWS = 20_000
ATTENTION = 65_536  # length at which attention costs as much as the rest
PACKED = "doc_id long, piece int, piece_start long, n_tokens long, shard long, bin long, bin_length int, bin_offset int"


def cost(length: int) -> float:
    return length * (1 + length / ATTENTION)


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> list[tuple[int, int, int]]:
    """(bin, its final length, offset in it) of each size; sizes come longest first, none over the longest length."""
    kinds = sorted(lengths)
    n = len(sizes)
    arr = np.array(sizes, np.int64)
    ahead = np.concatenate([[0], np.cumsum(arr)])  # of the sizes in their order
    price = [cost(c) for c in kinds]
    rooms: list[tuple[int, int]] = []  # (room, bin) of open bins, sorted
    filled: list[int] = []
    place: list[tuple[int, int]] = []
    least = sizes[-1] if n else 0
    falling = -arr
    for i, s in enumerate(sizes):
        at = bisect_left(rooms, (s, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            best = None
            for c, p in zip(kinds, price, strict=True):
                if c >= s:
                    from_ = max(i + 1, int(np.searchsorted(falling, -(c - s), "left")))  # pieces left that fit beside it
                    held = s + min(c - s, int(ahead[n] - ahead[from_]) if from_ < n else 0)
                    if best is None or p / held < best[0] - 1e-12:
                        best = (p / held, c)
            room, b = best[1], len(filled)
            filled.append(0)
        place.append((b, filled[b]))
        filled[b] += s
        if room - s >= least:
            insort(rooms, (room - s, b))
    final = [kinds[bisect_left(kinds, f)] for f in filled]
    return [(b, final[b], o) for b, o in place]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and n_tokens with the end token."""
    vocabulary = vocabulary or default_vocabulary()

    def make():
        cache = WordCache(vocabulary)
        return lambda x: {"doc_id": x["doc_id"], "n_tokens": [count_of(t, cache) + 1 for t in x["text"]]}

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long")


def pack_documents(lengths_of: DataFrame, n_rows: int, lengths: tuple[int, ...] = LENGTHS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack rows of doc_id and n_tokens; ``n_rows`` is about how many there are and sets the number of shards."""
    most = max(lengths)
    shards = max(1, -(-n_rows // shard_rows))
    last = F.greatest(F.ceil(F.col("n_tokens") / most).cast("int"), F.lit(1)) - 1
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("place")  # rows without an id are dealt by where they stand, else all of one size would meet
    pieces = lengths_of.select("doc_id", "n_tokens", place, F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("doc_id", "place", "piece", (F.col("piece") * F.lit(most).cast("long")).alias("piece_start"), F.least(F.lit(most).cast("long"), F.col("n_tokens") - F.col("piece") * F.lit(most)).alias("size"))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "size", "place"), F.lit(shards))
    dealt = pieces.withColumn("shard", shard).repartition(max(shuffle_partitions(lengths_of.sparkSession), min(shards, 2000)), "shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "piece")

    schema = _arrow_schema(PACKED)

    def run(batches):
        import pyarrow as pa

        rows, own = [], None

        def done():
            if rows:
                put = pack([r[3] for r in rows], lengths)
                cols = list(zip(*((d, p, s, n, own, b, c, o) for (d, p, s, n), (b, c, o) in zip(rows, put, strict=True)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for d, p, s, n, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != own:
                    yield from done()
                    rows, own = [], k
                rows.append((d, p, s, n))
        yield from done()

    return map_arrow(dealt.select("doc_id", "piece", "piece_start", "size", "shard"), run, PACKED)


def pack_corpus(docs: DataFrame) -> DataFrame:
    """Tokenize, cut and pack every row of ``docs``."""
    return pack_documents(token_counts(docs), docs.count())
