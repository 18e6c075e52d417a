"""SentencePiece BPE encoding by a table of prefixes, and decoding.

For BPE by merges, the encoding of a text restricted to its first tokens is
the encoding of the prefix that they spell.  So each prefix has one last
token, and the table of last tokens holds every prefix's encoding.  It is
filled from left to right: an automaton gives the pieces that end at a
position, and the one whose pair with the last token before it would not be
merged differently is the right one.  The ids come from walking back from the
end.

The model file is read here; the sentencepiece library is not used.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[i : i + n]
        i += n


class Model:
    """Pieces, scores and types of a model file, and what its encoder needs."""

    def __init__(self, data: bytes, cache: int = 600_000):
        self.pieces: list[str] = []
        scores, kinds = [], []
        normaliser: dict[int, bytes | int] = {}
        for number, value in _fields(data):
            if number == 1:
                one = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                self.pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one[2])[0])
                kinds.append(one[3])
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2:
                    raise ValueError("the model is not of the BPE type")
            elif number == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or USER_DEFINED in kinds:
            raise ValueError("only models with identity normalisation and no user-defined pieces are supported")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        special = {self.pieces[i]: i for i, k in enumerate(kinds) if k in (CONTROL, UNKNOWN)}
        self.bos, self.eos = special["<s>"], special["</s>"]
        self.silent = np.array([k == CONTROL for k in kinds])
        self.unknown = next(i for i, k in enumerate(kinds) if k == UNKNOWN)
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        self.scores = scores
        self.compatible: dict[int, bool] = {}
        # Pieces that merging their own characters does not give are never a token of an encoding.
        reachable = {p: i for p, i in self.ids.items() if len(p) == 1 or self._merge(p) == [i]}
        self.automaton = ahocorasick.Automaton()
        for p, i in reachable.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        # No piece spans these pairs of characters, so no merge does: texts are cut there.
        inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        newline = not any("\n" in x for x in inner)
        space = not any(x[1] == SPACE != x[0] for x in inner)
        self.cutter = re.compile((rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if newline else rf"{SPACE}*[^{SPACE}]+|{SPACE}+") if space else r"(?s).+")
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache
        self.table = np.array(["" if s or i == self.unknown else p.replace(SPACE, " ") for i, (p, s) in enumerate(zip(self.pieces, self.silent, strict=True))], object)

    def _merge(self, s: str) -> list[int]:
        """Ids of a short string by merging: the pair with the best score first, the leftmost of equals."""
        symbols: list[str | None] = list(s)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbols) and (k := self.ids.get(symbols[i] + symbols[j])) is not None:
                heap.append((-self.scores[k], i, symbols[i], symbols[j])) if not started else heappush(heap, (-self.scores[k], i, symbols[i], symbols[j]))

        started = False
        for i in range(len(s) - 1):
            offer(i)
        heapify(heap)
        started = True
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ids.get(x, -1) for x in symbols if x is not None]

    def _fits(self, a: int, b: int) -> bool:
        """Would merging leave the border between these tokens alone?"""
        fits = self._merge(self.pieces[a] + self.pieces[b]) == [a, b]
        if len(self.compatible) > 500_000:
            self.compatible.clear()
        self.compatible[a << 32 | b] = fits
        return fits

    def _tokens(self, s: str) -> list[int]:
        """The ids of a normalised string, by the table of prefixes."""
        n = len(s)
        last = [-1] * (n + 1)  # of the prefix of each length; -1: a character that is no piece
        size = [1] * (n + 1)
        fits, known = self._fits, self.compatible.get
        for end, (length, token) in self.automaton.iter(s):
            end += 1
            if last[end] < 0:
                before = last[end - length]
                if before < 0 or (fits(before, token) if (fit := known(before << 32 | token)) is None else fit):
                    last[end], size[end] = token, length
        out: list[int] = []
        i = n
        while i:
            if last[i] >= 0:
                out.append(last[i])
            else:
                b = s[i - 1].encode()
                out.extend(self.byte_id[x] for x in reversed(b)) if self.byte_id else out.append(self.unknown)
            i -= size[i]
        out.reverse()
        return out

    def _bytes(self, segment: str) -> bytes:
        """The ids of a segment as little-endian 32-bit integers; short segments are remembered."""
        made = self.cache.get(segment)
        if made is None:
            made = np.array(self._tokens(segment), "<u4").tobytes()
            if len(segment) <= 64:
                if len(self.cache) >= self.cache_size:
                    self.cache.clear()
                self.cache[segment] = made
        return made

    def forget(self) -> None:
        """Drop what encoding has remembered; a worker that lives on for other tasks need not hold it."""
        self.cache, self.compatible = {}, {}

    def encode(self, s: str) -> np.ndarray:
        """All ids of a text, with the begin and end ids."""
        if s:
            s = (SPACE if self.dummy_prefix else "") + s.replace(" ", SPACE)
        known = self.cache.get
        body = b"".join([known(x) or self._bytes(x) for x in self.cutter.findall(s)])
        return np.concatenate([[self.bos], np.frombuffer(body, "<u4"), [self.eos]]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the space put before the text goes, bytes join to characters, bad bytes become U+FFFD."""
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return ""
        parts = self.table[ids].tolist()
        first = parts[0]
        if self.dummy_prefix and first.startswith(" "):
            parts[0] = first[1:]
        if self.byte_of:
            i = 0
            at = np.flatnonzero(np.isin(ids, list(self.byte_of)))
            while i < len(at):
                j = i
                while j + 1 < len(at) and at[j + 1] == at[j] + 1:
                    j += 1
                run = bytes(self.byte_of[int(x)] for x in ids[at[i] : at[j] + 1])
                parts[at[i]] = _characters(run)
                parts[at[i] + 1 : at[j] + 1] = [""] * int(at[j] - at[i])
                i = j + 1
        return "".join(parts)


def _characters(run: bytes) -> str:
    """UTF-8 text; each byte that is in no well-formed character becomes U+FFFD."""
    out = []
    while run:
        try:
            return "".join(out) + run.decode()
        except UnicodeDecodeError as e:
            out.append(run[: e.start].decode() + "�")
            run = run[e.start + 1 :]
    return "".join(out)


_models: dict[str, Model] = {}


def _model(data: bytes) -> Model:
    key = hashlib.sha256(data).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(data)
    return _models[key]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of docs; on demand also ids and decoded.

    A null text counts as empty: its ids are the begin and end ids, its decoded
    text is empty.  Rows are independent; rows with equal or null ids are all
    kept, and an empty table gives no rows.  The model (a vocabulary of bounded
    size) travels to the workers with the task.
    """
    with open(model_file, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("the model file is too large to be sent with tasks")
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def encoded(model: Model, batches):
        for batch in scratch.cut(batches, 256):
            texts = batch.column(1)
            out: dict[str, list] = {k: [] for k in ("n", "ids", "i", "t", "d")}
            for x in texts:
                ids = model.encode(x.as_py() or "")
                decoded = model.decode(ids)
                out["n"].append(len(ids))
                out["i"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out["t"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(ids.astype(np.int32))
                if with_text:
                    out["d"].append(decoded)
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(out["n"], pa.int64()), "ids_sha256": pa.array(out["i"], pa.string()), "decoded_sha256": pa.array(out["t"], pa.string())}
            if with_ids:
                columns["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
            if with_text:
                columns["decoded"] = pa.array(out["d"], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    def run(batches):
        model = _model(shared.value)
        try:
            yield from encoded(model, batches)
        finally:
            model.forget()
            scratch.give_back()

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return slim.mapInArrow(run, schema)
