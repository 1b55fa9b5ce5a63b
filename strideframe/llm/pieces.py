"""SentencePiece encoding and decoding: Aho-Corasick over the pieces, Viterbi over its matches.

The text gets a space in front and each space becomes U+2581. The automaton over all pieces runs
once over the bytes; at each position the output links give every piece that ends there, from
the longest to the shortest, and each relaxes the best score of that position. A character that
no piece covers is written with byte pieces, and so is U+2581 itself, so that decoding gives
back every text. Of equal scores the path with the longest last piece wins.

No piece goes on past a space that follows another character, so the best path of a text is the
best paths of its chunks (a run of spaces and the run of other characters after it) in a row.
Distinct chunks of a batch are encoded once, all together and position by position in NumPy; so a very long text costs
no more memory than its chunks.

The piece file is a BPE file whose scores are ranks. They are turned into log probabilities by
Zipf's law over the ranks. Runs of spaces of which the file gives no rank, and bytes, come below the last.

A null text is an empty text and has no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType

from strideframe.llm.text import Texts, byte_table, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: the stand-in for the space within a chunk; it is no UTF-8 byte
_MARK = 0xFF
_BARE = byte_table(b" ", inverted=True)
#: chunks advanced together
_LANES = 1 << 16
#: bytes in a slice, of which the distinct chunks are encoded together
SLICE = 2 << 20


@dataclass
class Pieces:
    """Piece texts (as bytes, spaces as one mark), ids, scores, and the ids of the single bytes.

    Scores are whole millionths, so that sums are exact and ties are real.
    """

    texts: list[bytes]
    ids: list[int]
    scores: list[int]
    byte_ids: list[int]
    byte_score: int


def read_pieces(path: str = MODEL) -> Pieces:
    """Pieces of a SentencePiece file; read on the driver, as the file is a parameter of bounded size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = [0] * 256
    named = []
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            named.append((i, model.id_to_piece(i), model.get_score(i)))
    total = np.log(np.sum(1 / np.arange(1, n + 1)))
    worst = -np.log(n + 1) - total
    exact = lambda x: round(1e6 * float(x))
    scores = [exact(-np.log(2 - s) - total) if s > -n else exact(worst) for _, _, s in named]
    return Pieces([p.replace(SPACE, "\n").encode().replace(b"\n", bytes([_MARK])) for _, p, _ in named], [i for i, _, _ in named], scores, byte_ids, exact(worst - 10))


class Automaton:
    """Aho-Corasick over byte strings: transitions for every state and byte, and output links."""

    def __init__(self, words: list[bytes]):
        used = sorted({b for w in words for b in w})
        self.symbol = np.full(256, len(used), np.int64)
        self.symbol[used] = np.arange(len(used))
        children: list[dict[int, int]] = [{}]
        word = [-1]
        levels: list[list[tuple[int, int, int]]] = []
        for k, w in enumerate(words):
            at = 0
            for depth, b in enumerate(w):
                new = children[at].get(b)
                if new is None:
                    new = children[at][b] = len(children)
                    children.append({})
                    word.append(-1)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((at, int(self.symbol[b]), new))
                at = new
            if word[at] < 0:
                word[at] = k
        n = len(children)
        #: the last column is any byte that no word has
        self.next = np.zeros((n, len(used) + 1), np.int32)
        self.word = np.array(word, np.int32)
        fail = np.zeros(n, np.int32)
        self.link = np.zeros(n, np.int32)  # nearest proper suffix that is a word, 0 if none
        for depth, level in enumerate(levels):
            parent, symbol, state = np.array(level).T
            # a state's fallback follows its parent's fallback; both are complete, being shallower
            fail[state] = self.next[fail[parent], symbol] if depth else 0
            self.next[parent, symbol] = state
            self.next[state] = self.next[fail[state]]
            self.link[state] = np.where(self.word[fail[state]] >= 0, fail[state], self.link[fail[state]])


class Encoder:
    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.auto = Automaton(pieces.texts)
        self.length = np.array([len(t) for t in pieces.texts] or [0])
        self.score = np.array(pieces.scores or [0], np.int64)
        self.ids = np.array(pieces.ids or [0])
        self.byte_ids = np.array(pieces.byte_ids)

    def paths(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of each chunk in a row, and the chunks' bounds in them."""
        size = np.diff(offsets)
        n, longest = len(size), int(size.max(initial=0))
        best = np.full((n, longest + 1), np.iinfo(np.int64).min >> 1)
        best[:, 0] = 0
        back = np.zeros((n, longest + 1), np.int32)  # bytes of the last piece
        last = np.zeros((n, longest + 1), np.int32)  # its number; -1: a byte
        order = np.argsort(-size, kind="stable")  # the longest first: the open ones are a prefix
        state = np.zeros(n, np.int32)
        for k in range(1, longest + 1):
            open_ = int(np.searchsorted(-size[order], -k, "right"))
            rows = order[:open_]
            byte = data[offsets[rows] + k - 1]
            state = self.auto.next[state[:open_], self.auto.symbol[byte]]
            out = np.where(self.auto.word[state] >= 0, state, self.auto.link[state])
            lane = np.flatnonzero(out)
            while len(lane):  # output links, from the longest piece to the shortest
                piece = self.auto.word[out[lane]]
                row, long_ = rows[lane], self.length[piece]
                new = best[row, k - long_] + self.score[piece]
                better = new > best[row, k]
                row, piece = row[better], piece[better]
                best[row, k], back[row, k], last[row, k] = new[better], self.length[piece], piece
                out[lane] = self.auto.link[out[lane]]
                lane = lane[out[lane] > 0]
            # the rest of a character as single bytes
            new = best[rows, k - 1] + self.p.byte_score
            better = new > best[rows, k]
            row = rows[better]
            best[row, k], back[row, k], last[row, k] = new[better], 1, -1
        at, count, found = size.copy(), np.zeros(n, np.int64), []
        rows = np.flatnonzero(at)
        while len(rows):
            piece = last[rows, at[rows]]
            byte = data[offsets[rows] + at[rows] - 1]
            found.append((rows, np.where(piece < 0, self.byte_ids[byte], self.ids[piece])))
            count[rows] += 1
            at[rows] -= back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        bounds = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(bounds[-1], np.int32)
        for step, (rows, ids) in enumerate(found):
            out[bounds[rows + 1] - 1 - step] = ids
        return out, bounds

    def encode(self, texts: pa.Array) -> pa.ListArray:
        parts = [self.encode_slice(part) for _, part in slices(texts, most=SLICE)]
        return pa.chunked_array(parts, pa.list_(pa.int32())).combine_chunks() if parts else pa.array([], pa.list_(pa.int32()))

    def encode_slice(self, part: Texts) -> pa.ListArray:
        # a space in front of every text with characters, spaces as the mark; a mark in the text is escaped by its own bytes
        full = np.diff(part.offsets) > 0
        raw = np.insert(part.data, part.offsets[:-1][full], 0x20)
        offsets = part.offsets + np.concatenate([[0], np.cumsum(full)])
        raw = Texts(raw, offsets)
        bare = _BARE[raw.data]
        starts = ~bare.copy()
        starts[1:] &= bare[:-1]
        starts[offsets[:-1][full]] = True
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(raw.data))
        keys = raw.hashes(start, end) if len(start) else np.zeros(0, np.uint64)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        size = (end - start)[first]
        marked = np.where(bare, raw.data, _MARK).astype(np.uint8)
        ids, bounds = self._lanes(marked, start[first], size)
        width = np.diff(bounds)[which]
        flat = np.repeat(bounds[which] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        per_text = np.concatenate([[0], np.cumsum(width)])[np.searchsorted(start, offsets)]
        return pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.array(ids[flat].astype(np.int32)))

    def _lanes(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths of chunks, taken by size so that those advanced together are about as long."""
        order = np.argsort(size, kind="stable")
        found, widths, at = [], np.zeros(len(size), np.int64), 0
        while at < len(order):
            some = order[at : at + _LANES]
            # tables have a row of the longest size for each chunk: at most about a million cells, or one chunk
            room = max(1, (1 << 20) // int(size[some[-1]] + 1))
            some = order[at : at + min(_LANES, room)]
            offsets = np.concatenate([[0], np.cumsum(size[some])])
            index = np.repeat(start[some] - offsets[:-1], size[some]) + np.arange(offsets[-1])
            ids, bounds = self.paths(data[index], offsets)
            widths[some] = np.diff(bounds)
            found.append(ids)
            at += len(some)
        bounds = np.concatenate([[0], np.cumsum(widths)])
        out = np.zeros(bounds[-1], np.int32)
        sorted_widths = widths[order]
        spot = np.repeat(bounds[order] - (np.cumsum(sorted_widths) - sorted_widths), sorted_widths) + np.arange(bounds[-1])
        if found:
            out[spot] = np.concatenate(found)
        return out, bounds

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids; a null list is a null text, ids outside the vocabulary raise."""
        table = dict(zip(self.p.ids, self.p.texts, strict=True)) | {i: bytes([b]) for b, i in enumerate(self.p.byte_ids)}
        mark = bytes([_MARK])
        most = max(table, default=-1) + 1
        known = pa.array([table.get(i, b"").replace(mark, b" ") for i in range(most)], pa.binary())
        flat = pc.take(known, ids.flatten())
        offsets = ids.offsets.to_numpy()
        data, at = flat.buffers()[2], np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        raw = data.to_pybytes() if data is not None else b""
        bounds = at[offsets - offsets[0]]
        out = [raw[a:b][1:].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.array(out, pa.string(), mask=~np.array(ids.is_valid()) if ids.null_count else None)


_built: dict[int, Encoder] = {}


def _encoder(broadcast) -> Encoder:  # noqa: ANN001
    """One automaton for each Python worker."""
    if broadcast.bid not in _built:
        _built.clear()
        _built[broadcast.bid] = Encoder(broadcast.value)
    return _built[broadcast.bid]


class _Shared:
    """The pieces as a broadcast (a few MB, fixed by the file), with a key that workers keep."""

    def __init__(self, spark: SparkSession, path: str):
        self.held = spark.sparkContext.broadcast(read_pieces(path))
        self.bid = hash(path)

    @property
    def value(self) -> Pieces:
        return self.held.value


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, ids: str = "piece_ids", decoded: str | None = None) -> DataFrame:
    """The documents with their piece ids, and with the text decoded from those if a name is given; columns of these names are replaced."""
    shared, place = _Shared(docs.sparkSession, model), docs.columns.index(text)
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    at = [docs.columns.index(c) for c in kept]
    names = [*kept, ids, *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for a, part in slices(batch.column(place), most=SLICE):
                found = encoder.encode_slice(part)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, part.n) for i in at), found, *([encoder.decode(found)] if decoded else [])], names=names)

    schema = docs.select(*[docs[c] for c in kept]).schema.add(ids, ArrayType(IntegerType()))
    return docs.mapInArrow(run, schema.add(decoded, StringType()) if decoded else schema)


def decode(encoded: DataFrame, ids: str = "piece_ids", model: str = MODEL, text: str = "decoded") -> DataFrame:
    """The rows with the text of their piece ids; a column of that name is replaced."""
    shared, place = _Shared(encoded.sparkSession, model), encoded.columns.index(ids)
    kept = [c for c in encoded.columns if c != text]
    at = [encoded.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), encoder.decode(batch.column(place))], names=[*kept, text])

    return encoded.mapInArrow(run, encoded.select(*[encoded[c] for c in kept]).schema.add(text, StringType()))
