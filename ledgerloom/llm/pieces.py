"""SentencePiece encoding and decoding of whole texts, giant ones in chunks that are joined by a max-plus scan.

A sequence of pieces is what the merges of a BPE model give if, and only if, they give every two
neighbours of it: encoding is the one path through the text whose steps are all possible. A
step weighs its piece's score, or minus infinity where two pieces can't be neighbours. So a chunk
of text is a matrix in (max, +) from the states at its start to those at its end, a state
being a piece that reaches the boundary and how far it reaches over it. Matrices of
neighbouring chunks multiply associatively; when the states of all boundaries are known, each chunk
is traced back on its own. Between places where no piece goes on, such as spaces, there is
one state only, and the path is searched for once for every distinct string.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SPACE = "▁"
#: Characters of a chunk; only longer texts are split.
CHUNK = 4096
#: Bytes that a worker's table of units and that of neighbours may each take, about.
TABLE_BYTES = 48 << 20
#: What an entry takes beside its characters: objects and their place in a dict; and what a pair of neighbours takes.
ENTRY_BYTES, PAIR_BYTES = 230, 160
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Before a space mark that follows another character no piece goes on.
_SAFE = re.compile(f"(?<=[^{SPACE}]){SPACE}")

State = tuple[int, str]
#: Where nothing comes before.
FRESH: State = (0, "")
Matrix = dict[State, dict[State, float]]


class Pieces:
    """A model's pieces and what may follow what."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, self.raw, self.byte = {}, {}, [], {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.raw.append(bytes([int(piece[3:5], 16)]))
            else:
                self.raw.append(b"" if model.is_control(k) else piece.replace(SPACE, " ").encode())
                if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                    self.ids[piece], self.score[piece] = k, model.get_score(k)
        self.longest = max(map(len, self.ids))
        #: Scores of pieces, and None for what pieces begin with.
        self._begins = {p[:k]: None for p in self.ids for k in range(1, len(p))} | self.score
        if any(_SAFE.search(p) for p in self.ids):
            raise ValueError("this model has pieces that go on over a space")
        # other places where no piece goes on, so that what stands between is looked up as a unit
        marks = [m for m in "!\"#$%&()*+,-./:;<=>?@[]^_|~" if not any(re.search(f"[{_LETTERS}]{re.escape(m)}", p) for p in self.ids)]
        parted = [f"(?<=[^{SPACE}])(?={SPACE})", f"(?<=[{_LETTERS}])(?=[{re.escape(''.join(marks))}])"]
        self._parted = re.compile("|".join(parted + [r"(?<=\n)|(?=\n)"] * all("\n" not in p for p in self.ids)))
        self._most, self._follows, self._pairs = table_bytes, {}, 0
        # units met since the table was half full, and those met before; memory is bounded whatever the vocabulary
        self._units, self._old, self._size = {}, {}, 0

    def merged(self, text: str) -> list[str]:
        """The merges in their order on a short text: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether the merges leave these two as neighbours."""
        if not left or (right[0] == SPACE and left[-1] != SPACE) or left not in self.ids or right not in self.ids:
            return True
        return self.merged(left + right) == [left, right]

    def _known(self, left: str) -> dict[str, bool]:
        if self._pairs * PAIR_BYTES >= self._most:
            self._follows, self._pairs = {}, 0
        return self._follows.setdefault(left, {})

    def paths(self, text: str, end: int, state: State, last: bool) -> dict[int, tuple[int, str, float]]:
        """Positions reached from a state: where the piece that ends there starts, the piece, and the best weight.

        Pieces start before ``end``; where the text goes on behind it (not ``last``), they may reach over.
        """
        stop = end if last else len(text)
        begins, longest = self._begins, self.longest
        live: dict[int, tuple[int, str, float]] = {state[0]: (-1, state[1], 0.0)}
        for at in range(state[0], end):
            here = live.get(at)
            if here is None:
                continue
            _, before, weight = here
            known = self._known(before)
            for to in range(at + 1, min(stop, at + longest) + 1):
                piece = text[at:to]
                score = begins.get(piece, self)
                if score is self or score is None:
                    if to == at + 1 and piece not in self.ids:
                        score = 0.0  # a character without a piece: bytes
                    elif score is None:
                        continue
                    else:
                        break
                if to in live and live[to][2] >= weight + score:
                    continue
                ok = known.get(piece)
                if ok is None:
                    ok = known[piece] = self.follows(before, piece)
                    self._pairs += 1
                if ok:
                    live[to] = (at, piece, weight + score)
        return live

    def trace(self, live: dict[int, tuple[int, str, float]], end: int, start: int) -> list[str]:
        out = []
        while end != start:
            end, piece, _ = live[end]
            out.append(piece)
        return out[::-1]

    def pack(self, parts: list[str]) -> bytes:
        ids = [k for p in parts for k in ([self.ids[p]] if p in self.ids else [self.byte[b] for b in p.encode()])]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _choices(self, text: str, at: int) -> list[str]:
        """What may come next, longest last."""
        begins, found = self._begins, []
        for to in range(at + 1, min(len(text), at + self.longest) + 1):
            score = begins.get(text[at:to], self)
            if score is self:
                break
            if score is not None:
                found.append(text[at:to])
        return found if found and len(found[0]) == 1 else [text[at], *found]

    def path(self, text: str) -> list[str]:
        """The one path through text that starts and ends where no piece goes on, longest steps tried first."""
        failed = set()
        stack = [(0, "", self._choices(text, 0))]
        while True:
            at, before, choices = stack[-1]
            if at == len(text):
                return [step[1] for step in stack[1:]]
            known = self._known(before)
            while choices:
                piece = choices.pop()
                ok = known.get(piece)
                if ok is None:
                    ok = known[piece] = self.follows(before, piece)
                    self._pairs += 1
                to = at + len(piece)
                if ok and (to, piece) not in failed:
                    stack.append((to, piece, self._choices(text, to) if to < len(text) else []))
                    break
            else:
                failed.add((at, before))
                stack.pop()

    def unit(self, text: str) -> bytes:
        """Ids of text that starts and ends where no piece goes on."""
        packed = self._units.get(text)
        if packed is None:
            packed = self._old.get(text)
            if packed is None:
                packed = self.pack(self.path(text)) if text else b""
            if self._size >= self._most // 2:
                self._old, self._units, self._size = self._units, {}, 0
            self._units[text] = packed
            self._size += ENTRY_BYTES + len(text) + len(packed)
        return packed

    def whole(self, text: str) -> bytes:
        """Ids of text that starts and ends where no piece goes on, unit by unit."""
        return b"".join(map(self.unit, self._parted.split(text))) if text else b""

    def entries(self, before: str, text: str) -> list[State]:
        """States possible at the start of ``text``: pieces that end there or reach over it."""
        if not before:
            return [FRESH]
        reach = [(over, before[-back:] + text[:over]) for back in range(1, min(self.longest, len(before)) + 1) for over in range(min(self.longest - back, len(text)) + 1)]
        return [(over, piece) for over, piece in reach if piece in self.ids or (over == 0 and len(piece) == 1)]

    def matrix(self, before: str, text: str, after: str) -> Matrix:
        """The chunk's transfer matrix. ``before`` and ``after`` are the ``longest`` - 1 characters around it, or all there are."""
        rest, last = text + after, not after
        safe = _SAFE.search(text)
        out: Matrix = {}
        if safe is None:
            for state in self.entries(before, rest):
                live = self.paths(rest, len(text), state, last)
                out[state] = {(to - len(text), piece): weight for to, (_, piece, weight) in live.items() if to >= len(text)}
            return {s: ends for s, ends in out.items() if ends}
        first, final = safe.start(), max(m.start() for m in _SAFE.finditer(text))
        ends = self.paths(rest[final:], len(text) - final, FRESH, last)
        ends = {(to - len(text) + final, piece): weight for to, (_, piece, weight) in ends.items() if to >= len(text) - final}
        for state in self.entries(before, rest):
            live = self.paths(rest[:first], first, state, True)
            if first in live:
                out[state] = {end: live[first][2] + weight for end, weight in ends.items()}
        return out

    def traced(self, text: str, after: str, enter: State, leave: State) -> bytes:
        """Ids of the pieces that start in the chunk, on the path between two states."""
        rest, last = text + after, not after
        safe = _SAFE.search(text)
        if safe is None:
            return self.pack(self.trace(self.paths(rest, len(text), enter, last), len(text) + leave[0], enter[0]))
        first, final = safe.start(), max(m.start() for m in _SAFE.finditer(text))
        head = self.trace(self.paths(rest[:first], first, enter, True), first, enter[0])
        tail = self.trace(self.paths(rest[final:], len(text) - final, FRESH, last), len(text) - final + leave[0], 0)
        return self.pack(head) + self.whole(text[first:final]) + self.pack(tail)

    def measured(self, before: str, text: str, after: str) -> tuple[Matrix, tuple]:
        """The chunk's transfer matrix, and what its ids are made of when the states around it are known.

        That is (ids before the first safe place by the state at the start, those inside, those behind
        the last safe place by the state at the end), or (text, after) where there is no safe place.
        """
        rest, last = text + after, not after
        safe = _SAFE.search(text)
        if safe is None:
            return self.matrix(before, text, after), (text, after)
        first, final = safe.start(), max(m.start() for m in _SAFE.finditer(text))
        live = self.paths(rest[final:], len(text) - final, FRESH, last)
        ends = {(to - len(text) + final, piece): (weight, to) for to, (_, piece, weight) in live.items() if to >= len(text) - final}
        tails = {end: self.pack(self.trace(live, to, 0)) for end, (_, to) in ends.items()}
        heads, matrix = {}, {}
        for state in self.entries(before, rest):
            live = self.paths(rest[:first], first, state, True)
            if first in live:
                heads[state] = self.pack(self.trace(live, first, state[0]))
                matrix[state] = {end: live[first][2] + weight for end, (weight, _) in ends.items()}
        inside = np.frombuffer(self.whole(text[first:final]), "<u4")
        return matrix, (heads, inside.astype("<u2" if len(self.raw) <= 1 << 16 else "<u4"), tails)

    def joined(self, made: tuple, enter: State, leave: State) -> bytes:
        """Ids of the pieces that start in a chunk that was ``measured``, on the path between two states."""
        if len(made) == 2:
            return self.traced(*made, enter, leave)
        heads, inside, tails = made
        return heads[enter] + inside.astype("<u4").tobytes() + tails[leave]

    def decode(self, packed: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed)))
        return raw.decode("utf-8", "replace")[1:]


def times(left: Matrix, right: Matrix) -> Matrix:
    """The (max, +) product."""
    out: Matrix = {}
    for start, middle in left.items():
        row: dict[State, float] = {}
        for state, weight in middle.items():
            for end, more in right.get(state, {}).items():
                if row.get(end, float("-inf")) < weight + more:
                    row[end] = weight + more
        if row:
            out[start] = row
    return out


def boundaries(matrices: list[Matrix]) -> list[State]:
    """The states before, between and after the chunks on the best path from FRESH."""
    if len(matrices) == 1:
        ends = matrices[0][FRESH]
        return [FRESH, max(ends, key=ends.get)]

    def between(low: int, high: int, enter: State, leave: State) -> list[State]:
        """States at the boundaries inside chunks low to high, both ends known."""
        if high - low == 1:
            return []
        half = (low + high) // 2
        first, second = product(low, half), product(half, high)
        middle = max((s for s in first[enter] if leave in second.get(s, {})), key=lambda s: first[enter][s] + second[s][leave])
        return [*between(low, half, enter, middle), middle, *between(half, high, middle, leave)]

    @functools.lru_cache(maxsize=None)
    def product(low: int, high: int) -> Matrix:
        return matrices[low] if high - low == 1 else times(product(low, (low + high) // 2), product((low + high) // 2, high))

    ends = product(0, len(matrices))[FRESH]
    leave = max(ends, key=ends.get)
    return [FRESH, *between(0, len(matrices), FRESH, leave), leave]


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One model and its tables for all tasks of a worker."""
    return Pieces(path)


def _marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def encoded(docs: DataFrame, model_path: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, copy, row, parts, part, ids): a text's ids are those of its parts in order, as little-endian 32-bit numbers.

    The union of ``encoded_parts``; who reads short and long texts apart takes those.
    """
    short, long_ones = encoded_parts(docs, model_path, chunk, id_col, text_col)
    return short.unionByName(long_ones)


def encoded_parts(docs: DataFrame, model_path: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of ``encoded`` of texts of one part, and those of longer texts.

    A text of up to ``chunk`` characters has one part, a longer one as many as it takes. A null or
    empty text has one part without ids. ``copy``, a hash of the text, tells texts of one id
    apart, ``row`` (from 0) repeated rows of a long text; repeated short ones have row 0. Null
    ids stay. Other columns are not read. Only long texts are shuffled: their chunks, which are dealt to
    all tasks, and the chunks' ids, which meet by text, where a task holds those of one text. With ``whole`` a
    longer text is one row, too, part 0, with all its ids; ``parts`` still counts its chunks.
    """
    c = F.col
    text = F.coalesce(c(text_col).cast("string"), F.lit(""))
    rows = docs.select(c(id_col).alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, copy long, parts int, part int, ids binary"

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces_of(model_path)
        for frame in frames:
            frame["ids"] = [model.whole(_marked(t)) for t in frame["text"]]
            yield frame.assign(parts=1, part=0)[["id", "copy", "parts", "part", "ids"]]

    long_rows = rows.filter(F.char_length("text") > chunk)
    last_part = F.floor((F.char_length("text") - 1) / chunk).cast("int")
    cut = long_rows.select("id", "copy", "text", (last_part + 1).alias("parts"), F.explode(F.sequence(F.lit(0), last_part)).alias("part"))
    around = 32
    low = F.greatest(c("part") * chunk - around, F.lit(0))
    chunks = cut.select("id", "copy", "parts", "part", F.substring("text", low + 1, F.lit(chunk + 2 * around)).alias("text"))
    # deals the chunks and finds repeated ones at once
    chunks = chunks.groupBy("id", "copy", "part").agg(F.first("parts").alias("parts"), F.count("*").cast("int").alias("n"), F.first("text").alias("text"))

    def split(part: int, text: str) -> tuple[str, str, str]:
        lead = min(part * chunk, around)
        marked = text.replace(" ", SPACE)
        before, body, after = marked[:lead], marked[lead : lead + chunk], marked[lead + chunk :]
        return before, (SPACE + body if part == 0 else body), after

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(model_path)
        near = model.longest - 1
        for batch in batches:
            texts = map(split, batch.column(2).to_pylist(), batch.column(5).to_pylist())
            made = pa.array([pickle.dumps(model.measured(b[-near:], x, a[:near])) for b, x, a in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], made], names=[*batch.schema.names[:5], "made"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by text and part."""
        model = pieces_of(model_path)
        kinds = []

        def chunks_of() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = [f.type for f in batch.schema]
                yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

        for (key, copy), rows_of in groupby(chunks_of(), key=lambda r: r[:2]):
            of = list(rows_of)
            made = [pickle.loads(r[5]) for r in of]
            states = boundaries([m for m, _ in made])
            ids = [model.joined(x, *ends) for (_, x), *ends in zip(made, states[:-1], states[1:], strict=True)]
            ids = [b"".join(ids)] if whole else ids
            many = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * many, kinds[0]), pa.array([copy] * many, pa.int64()), pa.array([len(of)] * many, pa.int32()), pa.array(range(many), pa.int32()), pa.array(ids, pa.binary()), pa.array([of[0][4]] * many, pa.int32())],
                names=["id", "copy", "parts", "part", "ids", "n"],
            )

    measured = chunks.select("id", "copy", "part", "parts", "n", "text").mapInArrow(measure, f"id {id_type}, copy long, part int, parts int, n int, made binary")
    by_text = measured.repartition("id", "copy").sortWithinPartitions("id", "copy", "part")
    traced = by_text.mapInArrow(join, f"{schema}, n int").select("id", "copy", "parts", "part", "ids", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("row"))
    firsts = rows.filter(F.char_length("text") <= chunk).mapInPandas(short, schema).withColumn("row", F.lit(0))
    return firsts.withColumnRenamed("id", id_col), traced.withColumnRenamed("id", id_col)


def decoded(ids: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``text`` to rows of whole texts' ids. A space mark in a text was read as a space."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema) + ", text string"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces_of(model_path)
        for frame in frames:
            yield frame.assign(text=[model.decode(x or b"") for x in frame[ids_col]])

    return ids.mapInPandas(read, schema)


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    """Every document's ids, digested, and the digest of its text as read back from them."""
    path = model_file()
    short, cut = encoded_parts(spark.read.parquet(f"{d}/documents.parquet"), path, whole=True)
    names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "parts"]
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, parts int"

    def digest(key, packed: bytes, n: int) -> tuple:
        return key, len(packed) // 4, zlib.crc32(packed), hashlib.sha256(pieces_of(path).decode(packed).encode()).hexdigest(), n

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([digest(k, x or b"", n) for k, x, n in zip(frame["doc_id"], frame["ids"], frame["parts"], strict=True)], columns=names)

    return short.mapInPandas(each, schema).unionByName(cut.mapInPandas(each, schema))


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLE: dict[str, str] = {}
