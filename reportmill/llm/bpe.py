"""BPE encoding by forced boundaries: cut where no vocabulary token can span, encode the parts."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches

# The vocabulary's own splitting pattern and word-end mark, white space as its library reads it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"
# Letters and numbers that the pattern module knows and the vocabulary's library does not yet.
_LATE = """
0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf
10940-10959 10d40-10d49 10ec5-10ec7 10ed9-10eee 116d0-116e3 11b0a 11bf0-11bf9 11db0-11ddb 11de0-11de9 11df1
1246f 12475-1247f 12550-12686 16130-16139 16d70-16d79 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff
18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1ccf0-1ccf9 1d6a6 1df1f-1df24
1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e5f1-1e5fa 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
# Capitals that the vocabulary's library lowers and Python does not yet.
_LATE_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {
    c: c + 0x20 for c in range(0x10D50, 0x10D66)
}
_PLAIN_BELOW = "\u0530"
_END = "</w>"
_CACHE = 150_000
_LONG = 64
_TEXT_PART = 1 << 20


def _splitter(late: bool) -> regex.Pattern:
    """The splitting pattern; `late` also keeps late letters and numbers out of both classes."""
    if not late:
        return regex.compile(_PIECES.format(letter=r"\p{L}", number=r"\p{N}", space=_SPACE))
    ends = [(r.split("-") * 2)[:2] for r in _LATE.split()]
    out = "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in ends)
    letter, number = rf"[\p{{L}}--[{out}]]", rf"[\p{{N}}--[{out}]]"
    pattern = _PIECES.replace("[{letter}]", letter).replace("[{number}]", number)
    return regex.compile(pattern.replace("{letter}{number}", letter + number).replace("{space}", _SPACE), regex.V1)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b if b in set(shown) else 256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """A word-end BPE vocabulary with the byte pairs that some token holds inside.

    Two neighbouring symbols that no token holds side by side can never be merged, nor can
    anything across them: the cut is certain, and parts are encoded on their own. Words and
    parts are remembered in bounded tables.
    """

    def __init__(self, model: str) -> None:
        spec = json.loads(model)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + _END] for c in letters]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        code = {c: b for b, c in enumerate(letters)}
        self.inside = np.zeros((256, 512), bool)
        for token in vocab:
            ends = token.endswith(_END) and token != _END
            body = [code[c] for c in (token[: -len(_END)] if ends else token)]
            for k in range(1, len(body)):
                self.inside[body[k - 1], body[k] + (256 if ends and k == len(body) - 1 else 0)] = True
        self.held = [frozenset(np.flatnonzero(row).tolist()) for row in self.inside]
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special = special
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces, self.any_pieces = _splitter(False), _splitter(True)
        self.words: dict[str, bytes] = {}
        self.parts: dict[tuple[bytes, bool], list[int]] = {}

    def _merge(self, ids: list[int]) -> list[int]:
        """Merge the lowest-ranked pair, leftmost first, until none is left."""
        merges = self.merges
        if len(ids) > _LONG:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at = None, -1
            for k in range(len(ids) - 1):
                found = merges.get((ids[k], ids[k + 1]))
                if found and (best is None or found[0] < best[0]):
                    best, at = found, k
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked symbols, for parts of any length."""
        merges, n = self.merges, len(ids)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(merges[p][0], k, p) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in merges]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            right = nxt[k] if ids[k] >= 0 else -1
            if right < 0 or (ids[k], ids[right]) != pair:
                continue
            ids[k], ids[right] = merges[pair][1], -1
            nxt[k] = nxt[right]
            if nxt[k] >= 0:
                prv[nxt[k]] = k
            for left in (prv[k], k):
                if left >= 0 and nxt[left] >= 0 and (p := (ids[left], ids[nxt[left]])) in merges:
                    heapq.heappush(heap, (merges[p][0], left, p))
        return [i for i in ids if i >= 0]

    def _part(self, data: bytes, final: bool) -> list[int]:
        found = self.parts.get((data, final))
        if found is None:
            ids = [self.inner[b] for b in data]
            if final:
                ids[-1] = self.last[data[-1]]
            found = self._merge(ids)
            if len(data) <= _LONG:
                if len(self.parts) >= _CACHE:
                    self.parts.clear()
                self.parts[data, final] = found
        return found

    def boundaries(self, data: bytes) -> list[int]:
        """Positions where no token can span, for the bytes of one word."""
        held, end = self.held, len(data) - 1
        return [k for k in range(1, len(data)) if (data[k] + 256 if k == end else data[k]) not in held[data[k - 1]]]

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            data = word.encode()
            cuts = [0, *self.boundaries(data), len(data)]
            ids: list[int] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                ids += self._part(data[a:b], b == len(data))
            found = np.array(ids, "<u4").tobytes()
            if len(word) <= _LONG:
                if len(self.words) >= _CACHE:
                    self.words.clear()
                self.words[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        plain = max(text) < _PLAIN_BELOW
        flat = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        flat = (flat if plain else flat.translate(_LATE_LOWER)).lower()
        word, known, pieces = self.word, self.words, self.pieces if plain else self.any_pieces
        out, at = [], 0
        while at < len(flat):  # pieces hold no space, so a long text is cut at one
            cut = flat.find(" ", at + _TEXT_PART)
            cut = len(flat) if cut < 0 else cut
            out.append(b"".join([known.get(w) or word(w) for w in pieces.findall(flat, at, cut)]))
            at = cut
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text has none."""
        if not text:
            return b""
        if self.splitter is None:
            return self._plain(text)
        out = []
        for k, piece in enumerate(self.splitter.split(text)):
            out.append(np.array([self.special[piece]], "<u4").tobytes() if k % 2 else self._plain(piece) if piece else b"")
        return b"".join(out)


class Decoder:
    """The tokens of a vocabulary by id."""

    def __init__(self, model: str) -> None:
        spec = json.loads(model)
        self.tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space: the vocabulary names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_LOADED: dict[type, tuple[int, Encoder | Decoder]] = {}


def _tool(kind: type, model: str):
    """One coder of a kind per worker process, for the vocabulary used last."""
    if _LOADED.get(kind, (None,))[0] != hash(model):
        _LOADED[kind] = (hash(model), kind(model))
    return _LOADED[kind][1]


def read_model(path: str) -> str:
    """Vocabulary file as text: of fixed size, read once and sent to tasks as a broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, n_tokens) per row: ids as little-endian unsigned 32-bit integers.

    Whole texts of any length are encoded row by row without a shuffle. A null or empty
    text has zero ids; repeated rows repeat; other columns are not read; an empty table
    gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(read_model(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(Encoder, model.value)
        for batch in sliced(batches):
            ids = [tool.encode(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
                names=["id", "ids", "n_tokens"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """Adds `decoded` to (id, ids, n_tokens); null ids decode to an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(vocab_path))
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(Decoder, model.value)
        for batch in sliced(batches):
            texts = [tool.decode(i.as_py() or b"") for i in batch.column(1)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=["id", "ids", "n_tokens", "decoded"])

    return encoded.select("id", "ids", "n_tokens").mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint, decoded string")


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass, without a second worker process per task."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(read_model(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, back = _tool(Encoder, model.value), _tool(Decoder, model.value)
        for batch in sliced(batches):
            ids = [there.encode(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(back.decode, ids), pa.string())],
                names=["id", "ids", "n_tokens", "decoded"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint, decoded string")


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded text."""
    both = round_trip(docs, vocab_path)
    return both.select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
