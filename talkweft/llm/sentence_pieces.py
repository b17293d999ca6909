"""SentencePiece encoding and decoding by a max-plus parallel scan.

A sequence of pieces is the BPE encoding of its text exactly when every two neighbours are the encoding of their
own concatenation (a merge across a border of pieces would show in that pair). So encoding is a best path: pieces
are nodes, fitting neighbours are edges of weight 0, all others weigh minus infinity, and one path is left.

A text of 2 * CHUNK characters and more is cut into chunks anywhere. The state at a boundary is the piece that holds
the character before it. Each chunk yields the matrix of best weights from every state at its start to every
state at its end; matrices are multiplied in the max-plus semiring, BLOCK chunks at a time, which fixes the state
at every boundary; then each chunk is traced back on its own. No piece goes across a place before a run of word
marks or around a line break, so every path passes it, and what lies between such places is encoded word by word
by the sentencepiece library; words are remembered.

Edge cases: null and empty texts have no pieces; U+2581 in a text is encoded as the space it stands for; rows
that repeat are encoded each; a null doc_id is kept. ``decoded`` says that decoding gives the given text back, which
it can't where the text holds U+2581 itself; a null text is decoded as an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_batches, written

CHUNK = 32_768
BLOCK = 64
WORDS = 300_000
NEVER = -np.inf
MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _no_prefix(proto: bytes) -> bytes:
    """The model without its word mark before every text: field 3 of the normalizer, which is field 3 of the model."""
    at = 0
    while at < len(proto):
        tag, size, shift = proto[at], 0, 0
        start = at
        at += 1
        while True:
            size |= (proto[at] & 127) << shift
            shift += 7
            at += 1
            if proto[at - 1] < 128:
                break
        if tag == 0x1A:
            return proto[:start] + _field(0x1A, proto[at : at + size] + b"\x18\x00") + proto[at + size :]  # the last value of a field holds
        at += size
    raise ValueError("the model has no normalizer")


def _field(tag: int, data: bytes) -> bytes:
    n, size = len(data), b""
    while n > 127:
        size += bytes([n & 127 | 128])
        n >>= 7
    return bytes([tag]) + size + bytes([n]) + data


class Lattice:
    """The pieces of a BPE model file, and which of them may follow each other."""

    def __init__(self, model: str) -> None:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=model)
        self.library = SentencePieceProcessor(model_proto=_no_prefix(p.serialized_model_proto()))
        n = p.get_piece_size()
        self.pieces = {p.id_to_piece(i): i for i in range(n) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))}
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.text_of = {i: s.encode() for s, i in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.longest = max(map(len, self.pieces))
        if any(MARK in s.lstrip(MARK) or "\n" in s for s in self.pieces):
            raise ValueError("a piece goes across a word mark or a line break")
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def ids(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        return [found] if found is not None else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]

    def fit(self, x: str, y: str) -> bool:
        """Whether piece y may follow piece x."""
        found = self.pairs.get((x, y))
        if found is None:
            if len(self.pairs) >= WORDS:
                self.pairs.clear()
            found = self.pairs[x, y] = self.library.encode(x + y) == self.ids(x) + self.ids(y)
        return found

    def word(self, w: str) -> list[int]:
        found = self.words.get(w)
        if found is None:
            found = self.library.encode(w)
            if len(w) < 64:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[w] = found
        return found

    def ends(self, text: str, i: int) -> list[int]:
        """Where pieces that begin at ``i`` end; a character without a piece is one by itself."""
        out = [j for j in range(i + 2, min(len(text), i + self.longest) + 1) if text[i:j] in self.pieces]
        return [i + 1, *out]

    def holding(self, text: str, at: int) -> list[tuple[int, int]]:
        """The pieces that hold the character before ``at``: the states of that boundary, in a fixed order."""
        return [(i, j) for i in range(max(0, at - self.longest), at) for j in self.ends(text, i) if j >= at]

    def reach(self, text: str, starts: list[tuple[int, int]], stop: int) -> dict[tuple[int, int], tuple[int, tuple | None]]:
        """From pieces ``starts``, every piece that a path leads to and that begins before ``stop``: a bit mask of
        the starts that lead to it (paths of weight 0), and the piece before it on one path."""
        found: dict[tuple[int, int], tuple[int, tuple | None]] = {s: (1 << k, None) for k, s in enumerate(starts)}
        upto: dict[int, list[tuple[int, int]]] = {}
        for s in starts:
            upto.setdefault(s[1], []).append(s)
        for i in range(min((j for _, j in starts), default=stop), stop):
            for before in upto.get(i, ()):
                for j in self.ends(text, i):
                    if self.fit(text[before[0] : i], text[i:j]):
                        mask, back = found.get((i, j), (0, before))
                        if (i, j) not in found:
                            upto.setdefault(j, []).append((i, j))
                        found[i, j] = (mask | found[before][0], back)
        return found

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "surrogatepass")


UNITS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def marked(text: str | None) -> str:
    """The text as the model sees it: a word mark first and for each space."""
    return MARK + text.replace(" ", MARK) if text else ""


def unmarked(text: str) -> str:
    """The text that was marked()."""
    return text[1:].replace(MARK, " ")


def _cut(text: str, low: int, high: int, last: bool) -> int:
    """The first or last place of low..high that no piece goes across; -1 if there is none."""
    for k in range(high, low - 1, -1) if last else range(low, high + 1):
        if text[k] == "\n" or text[k - 1] == "\n" or (text[k] == MARK and text[k - 1] != MARK):
            return k
    return -1


def transfer(lattice: Lattice, text: str, start: int, end: int) -> np.ndarray:
    """Best weights [state at ``start``, state at ``end``]. ``text`` holds what pieces at both places can reach;
    at start 0 the only state is the begin of the text."""
    ahead = lattice.holding(text, start) if start else [(0, 0)]
    behind = lattice.holding(text, end)
    first = _cut(text, start + lattice.longest, end - 1, False)
    found = lattice.reach(text, ahead, end if first < 0 else first)
    if first < 0:
        masks = [found[b][0] if b in found else 0 for b in behind]
    else:  # all paths pass first and last, so what leads to first leads to all that last leads to
        mask = 0
        for (_, j), (m, _) in found.items():
            if j == first:
                mask |= m
        last = _cut(text, first, end - 1, True)
        tail = lattice.reach(text, [(last, last)], end)
        masks = [mask if b in tail else 0 for b in behind]
    return np.array([[0.0 if m >> a & 1 else NEVER for m in masks] for a in range(len(ahead))])


def _back(lattice: Lattice, text: str, found: dict, node: tuple, stop: tuple) -> list[int]:
    parts = []
    while node != stop:
        parts.append(lattice.ids(text[node[0] : node[1]]))
        node = found[node][1]
    return [x for p in reversed(parts) for x in p]


def trace(lattice: Lattice, text: str, start: int, end: int, a: int, b: int) -> tuple[list[int], str]:
    """Ids after state ``a`` of a chunk's start up to state ``b`` of its end, and the text they stand for."""
    p = lattice.holding(text, start)[a] if start else (0, 0)
    q = lattice.holding(text, end)[b]
    first = _cut(text, start + lattice.longest, end - 1, False)
    found = lattice.reach(text, [p], end if first < 0 else first)
    if first < 0:
        return _back(lattice, text, found, q, p), text[p[1] : q[1]]
    ids = _back(lattice, text, found, next(n for n in found if n[1] == first), p)
    last = _cut(text, first, end - 1, True)
    for w in UNITS.findall(text[first:last]):
        ids += lattice.word(w)
    tail = lattice.reach(text, [(last, last)], end)
    return ids + _back(lattice, text, tail, q, (last, last)), text[p[1] : q[1]]


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (x[:, :, None] + y[None, :, :]).max(1)


def states(matrices: list[np.ndarray], a: int, b: int | None) -> list[int]:
    """The states at all boundaries of a best path from ``a`` before the first matrix to ``b`` (or the best) after the last."""
    v = np.full(len(matrices[0]), NEVER)
    v[a] = 0
    before = []
    for m in matrices:
        before.append(v)
        v = (v[:, None] + m).max(0)
    out = [int(np.argmax(v)) if b is None else b]
    for m, v in zip(reversed(matrices), reversed(before), strict=True):
        out.append(int(np.argmax(v + m[:, out[-1]])))
    return out[::-1]


def encode_text(lattice: Lattice, text: str | None) -> list[int]:
    """A text of one chunk: nothing but its words."""
    return [x for w in UNITS.findall(marked(text)) for x in lattice.word(w)]


def chunks_of(s: str, chunk: int, reach: int) -> list[tuple[str, int, int]]:
    """(text, start, end) of every chunk of a marked text, with what pieces at its ends can reach."""
    n = max(1, len(s) // chunk)  # the last chunk takes the rest
    out = []
    for c in range(n):
        low, end = c * chunk, len(s) if c == n - 1 else (c + 1) * chunk
        at = max(0, low - reach)
        out.append((s[at : end + reach], low - at, end - at))
    return out


def digest_of(ids: np.ndarray) -> str:
    """SHA-1 of the ids in order, four bytes each, the lowest first."""
    return hashlib.sha1(ids.astype("<u4").tobytes()).hexdigest()


RESULT = "doc_id long, n_pieces long, ids array<int>, ids_digest string, decoded boolean"


def _whole(docs: DataFrame, model: str) -> DataFrame:
    def make():
        lattice = Lattice(model)

        def work(x: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_pieces", "ids", "ids_digest", "decoded")}
            for text in x["text"]:
                found = encode_text(lattice, text)
                ids = np.array(found, np.int32)
                for k, v in zip(out, (len(ids), ids, digest_of(ids), unmarked(lattice.decode(found)) == (text or "")), strict=True):
                    out[k].append(v)
            return {"doc_id": x["doc_id"]} | out

        return work

    return map_batches(docs, make, RESULT)


def _chunks(docs: DataFrame, chunk: int, reach: int) -> DataFrame:
    """row, doc_id, chunk, chunks_of() and whether the text has no word mark of its own, of every text."""

    def make():
        def work(x: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "chunk", "text", "low", "high", "plain")}
            for row, doc_id, text in zip(x["row"], x["doc_id"], x["text"], strict=True):
                for c, part in enumerate(chunks_of(marked(text), chunk, reach)):
                    for k, v in zip(out, (row, doc_id, c, *part, MARK not in (text or "")), strict=True):
                        out[k].append(v)
            return out

        return work

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return map_batches(rows, make, "row long, doc_id long, chunk int, text string, low int, high int, plain boolean")


def _scanned(docs: DataFrame, model: str, chunk: int) -> DataFrame:
    """Texts of several chunks."""
    chunks = written(_chunks(docs, chunk, Lattice(model).longest), "chunks")

    def make():
        lattice = Lattice(model)

        def work(x: dict) -> dict:
            made = [transfer(lattice, t, a, b) for t, a, b in zip(x["text"], x["low"], x["high"], strict=True)]
            return {"row": x["row"], "chunk": x["chunk"], "height": [len(m) for m in made], "matrix": [m.tobytes() for m in made]}

        return work

    matrices = map_batches(chunks.select("row", "chunk", "text", "low", "high"), make, "row long, chunk int, height int, matrix binary")
    matrices = written(matrices.withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("int")), "matrices")

    def read(pdf) -> list[np.ndarray]:
        return [np.frombuffer(m).reshape(h, -1) for m, h in zip(pdf["matrix"], pdf["height"], strict=True)]

    def block_matrix(pdf):
        first, *rest = read(pdf.sort_values("chunk"))
        for m in rest:
            first = product(first, m)
        return pdf.iloc[:1][["row", "block"]].assign(height=len(first), matrix=[first.tobytes()])

    def block_states(pdf):
        pdf = pdf.sort_values("block")
        s = states(read(pdf), 0, None)
        return pdf[["row", "block"]].assign(a=s[:-1], b=s[1:])

    def chunk_states(left, right):
        left = left.sort_values("chunk")
        s = states(read(left), int(right["a"].iloc[0]), int(right["b"].iloc[0]))
        return left[["row", "chunk"]].assign(a=s[:-1], b=s[1:])

    blocks = matrices.groupBy("row", "block").applyInPandas(block_matrix, "row long, block int, height int, matrix binary")
    fixed = blocks.groupBy("row").applyInPandas(block_states, "row long, block int, a int, b int")
    ends = matrices.groupBy("row", "block").cogroup(fixed.groupBy("row", "block")).applyInPandas(chunk_states, "row long, chunk int, a int, b int")

    def make_traces():
        lattice = Lattice(model)

        def work(x: dict) -> dict:
            out: dict[str, list] = {"ids": [], "decoded": []}
            for plain, *at in zip(x["plain"], x["text"], x["low"], x["high"], x["a"], x["b"], strict=True):
                ids, span = trace(lattice, *at)
                out["ids"].append(np.array(ids, np.int32))
                out["decoded"].append(plain and lattice.decode(ids) == span)
            return {k: x[k] for k in ("row", "doc_id", "chunk")} | out

        return work

    def joined(pdf):
        pdf = pdf.sort_values("chunk")
        ids = np.concatenate(pdf["ids"].to_list())
        return pdf.iloc[:1][["doc_id"]].assign(n_pieces=len(ids), ids=[ids], ids_digest=digest_of(ids), decoded=bool(pdf["decoded"].all()))

    traced = map_batches(chunks.join(ends, ["row", "chunk"]).select("row", "doc_id", "chunk", "text", "low", "high", "plain", "a", "b"), make_traces, "row long, doc_id long, chunk int, ids array<int>, decoded boolean")
    return traced.groupBy("row").applyInPandas(joined, RESULT)  # a group is one text


def encode_pieces(docs: DataFrame, model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_pieces, ids, ids_digest and decoded of every row; nothing of it depends on ``chunk``."""
    model = model or default_model()
    docs = docs.select("doc_id", "text")
    giant = F.length(F.coalesce("text", F.lit(""))) >= 2 * chunk
    return _whole(docs.where(~giant), model).union(_scanned(docs.where(giant), model, chunk))


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of every row of doc_id and ids, one row's ids at a time."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model)
        for batch in batches:
            texts = [unmarked(lattice.decode(ids.as_py() or [])) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
