"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text gets the word mark in front and in place of its spaces and is cut into chunks where no merge can reach across: before
a word mark that follows another character, and around characters that only ever stand alone in the vocabulary. (Vocabularies
with a piece that holds a mark after another character are not cut at marks.) A chunk starts as single characters; every
adjacent pair that forms a piece goes on an agenda ordered by score, then by place. The best pair is merged, stale entries are
skipped, and the pairs with the new neighbours are added, until the agenda is empty. The agendas of short chunks stand side by
side in numpy arrays and advance together; a long chunk has a heap. Characters outside the vocabulary become their UTF-8
bytes. Chunks are remembered per worker, so a repeated word is merged once; the chunks that an Arrow batch adds are also
encoded by the sentencepiece library, and any difference raises. Decoding joins the pieces, takes the mark at the
very start away and checks runs of byte pieces: a byte that belongs to no character becomes U+FFFD.

The model file is read once by the driver (its size is that of one vocabulary) and travels with the function.

Cases: null encodes as the empty text; an empty text has only the end id; spaces, control characters and special names in a
text (``</s>``) are ordinary text; a literal word mark decodes as a space, as in the library; the agenda of a long text without a cut has
one entry per pair of neighbours; null ids decode to an empty text; an id outside the vocabulary raises. Vocabularies of
another type, with a normaliser, without byte fallback, or with user-defined or unused pieces raise.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.llm.common import table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
REMEMBERED = 1 << 19  # chunks that a worker keeps; beyond it the store starts anew
SHORT = 32  # longer chunks have an agenda of their own
ROWS, WAITING = 1 << 15, 1 << 19  # chunks merged together; chunks of texts that wait for their new ones
CHECKED = 256  # chunks in one text of the check
NONE = np.iinfo(np.int32).max  # the rank of a pair that forms no piece


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message; fixed-width values as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at, out, shift = at + 1, out | (byte & 127) << shift, shift + 7
            if byte < 128:
                return out
    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size = number()
            yield tag >> 3, data[at:at + size]
            at += size


class Vocabulary:
    """Pieces, scores and flags of a model file."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for field, value in fields(model):
            if field == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(fields(value))
            elif field == 3:
                normalizer = dict(fields(value))
        kinds = {kind for _, _, kind in self.pieces}
        wrong = {
            "type is not BPE": trainer.get(3, 1) != 2,
            "no byte fallback": not trainer.get(35, 0) or sum(kind == BYTE for _, _, kind in self.pieces) != 256,
            "word marks as suffixes": trainer.get(24, 0),
            "a normaliser": normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1),
            "user-defined or unused pieces": kinds - {NORMAL, UNKNOWN, CONTROL, BYTE},
        }
        if any(wrong.values()):
            raise ValueError("vocabulary not supported: " + ", ".join(k for k, v in wrong.items() if v))
        self.prefix = MARK if normalizer.get(3, 1) else ""
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        ranks = {x: i for i, x in enumerate(sorted({-score for _, score, _ in self.pieces}))}
        self.rank = {piece: ranks[-score] for piece, score, kind in self.pieces if kind == NORMAL}
        self.bytes = {int(piece[1:-1], 16): i for i, (piece, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.end = next(i for i, (piece, _, kind) in enumerate(self.pieces) if kind == CONTROL and piece == trainer.get(47, b"</s>").decode())

        joined = [piece for piece in self.ids if len(piece) > 1]
        pairs = {}
        for piece in joined:
            for i in range(1, len(piece)):
                left, right = self.ids.get(piece[:i]), self.ids.get(piece[i:])
                if left is not None and right is not None:
                    pairs[left * len(self.pieces) + right] = piece
        self.pair_keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_ranks = np.array([self.rank[pairs[k]] for k in sorted(pairs)] or [NONE], np.int32)
        self.pair_ids = np.array([self.ids[pairs[k]] for k in sorted(pairs)] or [-1], np.int32)
        self.letter_ids = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.letter_ids[ord(piece)] = i
        letters = "".join(sorted(set("".join(joined)) - {MARK}))
        letters = "[" + re.escape(letters) + "]" if letters else "(?!)"
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in joined):
            self.cut = re.compile(f"(?:{letters}|{MARK})+|.", re.DOTALL)
        else:
            self.cut = re.compile(f"{MARK}*{letters}+|{MARK}+|.", re.DOTALL)

        # Kinds of characters: 0 stands alone; which kinds some piece holds in sequence.
        kinds = {c: i for i, c in enumerate(sorted(set("".join(joined))), 1)}
        self.letter_kinds = np.zeros(0x110000, np.int32)
        self.letter_kinds[[ord(c) for c in kinds]] = list(kinds.values())
        self.joined_kinds = np.zeros((len(kinds) + 1, len(kinds) + 1), bool)
        for piece in joined:
            for i in range(len(piece) - 1):
                self.joined_kinds[kinds[piece[i]], kinds[piece[i + 1]]] = True

        self.surface = [piece.replace(MARK, " ").encode() if kind == NORMAL else b"" for piece, _, kind in self.pieces]
        self.byte_ids = frozenset(self.bytes.values())
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])
        for i, (_, _, kind) in enumerate(self.pieces):
            if kind == UNKNOWN:
                self.surface[i] = trainer.get(44, " ⁇ ".encode())

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def merged(self, chunk: str) -> list[int]:
        """The ids of a chunk, by the agenda of its adjacent pairs: (rank of the score, place) in one number."""
        rank, parts = self.rank, list(chunk)
        n = len(parts)
        shift = n.bit_length()
        place = (1 << shift) - 1
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None:
                agenda.append(r << shift | i)
        heapify(agenda)
        while agenda:
            best = heappop(agenda)
            left = best & place
            right = after[left]
            if right < 0 or not parts[left]:
                continue
            both = parts[left] + parts[right]
            if rank.get(both) != best >> shift:
                continue  # one of the two was merged meanwhile
            parts[left], parts[right] = both, ""
            after[left] = following = after[right]
            if following >= 0:
                before[following] = left
                r = rank.get(both + parts[following])
                if r is not None:
                    heappush(agenda, r << shift | left)
            previous = before[left]
            if previous >= 0:
                r = rank.get(parts[previous] + both)
                if r is not None:
                    heappush(agenda, r << shift | previous)
        ids, out = self.ids, []
        for p in parts:
            if p:
                i = ids.get(p)
                if i is None:
                    out += [self.bytes[b] for b in p.encode()]
                else:
                    out.append(i)
        return out

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair of ids forms; NONE where it forms no piece."""
        keys = left.astype(np.int64) * len(self.pieces) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_ranks[at], NONE), self.pair_ids[at]

    def merged_together(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of many chunks as 32-bit numbers. Chunks are cut once more, between neighbours that no piece holds in sequence, and
        the distinct parts are merged: short ones share numpy agendas, a row per part with its pairs' ranks in place; in each round
        every row merges its best pair, the leftmost of equals, and looks up the two new pairs."""
        whole = "".join(chunks)
        if not whole:
            return dict.fromkeys(chunks, b"")
        kinds = self.letter_kinds[np.frombuffer(whole.encode("utf-32-le"), "<u4")]
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        cut = np.ones(len(whole) + 1, bool)
        cut[1:-1] = ~self.joined_kinds[kinds[:-1], kinds[1:]]
        cut[ends] = True
        at = np.flatnonzero(cut)
        parts = [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        found = self._merged_parts(list(set(parts)))
        data = list(map(found.__getitem__, parts))
        last = np.searchsorted(at, ends).tolist()
        return {c: data[a] if b - a == 1 else b"".join(data[a:b]) for c, a, b in zip(chunks, [0, *last], last)}

    def _merged_parts(self, parts: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        by_width: dict[int, list[str]] = {}
        for part in parts:
            by_width.setdefault(-(-len(part) // 2) if len(part) <= SHORT else 0, []).append(part)
        for width, some in by_width.items():
            for i in range(0, len(some), ROWS) if width else ():
                rest = self._merge_rows(some[i:i + ROWS], 2 * width, out)
                out.update((part, array("i", self.merged(part)).tobytes()) for part in rest)
            if not width:
                out.update((part, array("i", self.merged(part)).tobytes()) for part in some)
        return out

    def _merge_rows(self, chunks: list[str], width: int, out: dict[str, bytes]) -> list[str]:
        """Fills ``out``; returns the chunks with a character that is no piece."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ids = np.full((len(chunks), width + 1), -1, np.int32)
        ids[np.arange(width + 1) < lengths[:, None]] = self.letter_ids[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        known = (ids >= 0).sum(axis=1) == lengths
        rest = [chunks[i] for i in np.flatnonzero(~known)]
        rows, ids = np.flatnonzero(known), ids[known]
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.ranks_of(ids[:, :-1], ids[:, 1:])[0]
        columns = np.arange(width + 1)
        while len(rows):
            place = ranks.argmin(axis=1)
            open_ = ranks[np.arange(len(rows)), place] < NONE
            done = ~open_
            if done.any():
                sizes = (ids[done] >= 0).sum(axis=1).tolist()
                data, step = ids[done].tobytes(), 4 * (width + 1)
                for k, (row, size) in enumerate(zip(rows[done].tolist(), sizes)):
                    out[chunks[row]] = data[k * step:k * step + 4 * size]
                rows, ids, ranks, place = rows[open_], ids[open_], ranks[open_], place[open_]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            both = self.ranks_of(ids[every, place], ids[every, place + 1])[1]
            shift = np.minimum(columns + (columns > place[:, None]), width)
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            ids[:, width], ranks[:, width] = -1, NONE
            ids[every, place] = both
            ranks[every, place] = self.ranks_of(both, ids[every, np.minimum(place + 1, width)])[0]
            inner = place > 0
            before = every[inner], place[inner] - 1
            ranks[before] = self.ranks_of(ids[before], both[inner])[0]
        return rest

    def text(self, ids: list[int]) -> str:
        """The text of ids."""
        surface = self.surface
        parts = [surface[i] for i in ids]
        if self.prefix:  # the first piece that is text, or bytes, ends the search
            for k, i in enumerate(ids):
                if parts[k]:
                    if parts[k][:1] == b" " and self.pieces[i][2] == NORMAL:
                        parts[k] = parts[k][1:]
                    break
        data = b"".join(parts)
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._mended(ids, parts)

    def _mended(self, ids: list[int], parts: list[bytes]) -> str:
        """Runs of byte pieces, each invalid byte as U+FFFD."""
        out, run = [], b""
        for i, part in zip([*ids, None], [*parts, b""]):
            if i in self.byte_ids:
                run += part
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        run = run[size:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    run = run[1:]
            out.append(part.decode())
        return "".join(out)


class Encoder:
    """One worker's vocabulary, remembered chunks, and the library to check against."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = Vocabulary(model), remembered
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.known: dict[str, bytes] = {}

    def check(self, new: dict[str, bytes]) -> None:
        """The library encodes the same chunks in texts of many, each behind a line feed, which is a chunk of its own."""
        v, chunks = self.vocabulary, list(new)
        line = v.merged_together(["\n"])["\n"]
        lead = array("i", v.merged(v.prefix)).tobytes() if v.prefix else b""
        groups = [chunks[i:i + CHECKED] for i in range(0, len(chunks), CHECKED)]
        texts = ["\n" + "\n".join(g).replace(MARK, " ") for g in groups]
        for group, found in zip(groups, self.library.encode(texts, num_threads=1)):
            want = lead + line + line.join(map(new.__getitem__, group))
            if np.array(found, np.int32).tobytes() != want:
                self._differs(group, new)

    def _differs(self, chunks: list[str], new: dict[str, bytes]) -> None:
        if len(chunks) == 1:
            raise RuntimeError(f"the sentencepiece library encodes {chunks[0]!r} otherwise than as {array('i', new[chunks[0]]).tolist()}")
        for chunk in chunks:
            self.check({chunk: new[chunk]})
        raise RuntimeError(f"the sentencepiece library encodes {chunks!r} otherwise than one by one")

    def learn(self, chunks: set[str], checked: bool) -> None:
        new = self.vocabulary.merged_together(list(chunks))
        if checked and new:
            self.check(new)
        self.known.update(new)

    def encoded(self, texts: pa.Array, checked: bool, end: bool) -> pa.Array:
        flat, offsets = bytearray(), [0]
        last = array("i", [self.vocabulary.end] if end else []).tobytes()
        waiting: list[list[str]] = []
        new: set[str] = set()

        def put() -> None:
            self.learn(new, checked)
            for chunks in waiting:
                flat.extend(b"".join(map(self.known.__getitem__, chunks)))
                flat.extend(last)
                offsets.append(len(flat) // 4)
            waiting.clear()
            new.clear()
            if len(self.known) > self.remembered:
                self.known.clear()
        size = 0
        for text in texts:
            chunks = self.vocabulary.chunks(text.as_py() or "")
            waiting.append(chunks)
            new.update(filterfalse(self.known.__contains__, chunks))
            size += len(chunks)
            if size > WAITING:
                put()
                size = 0
        put()
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)]))


_open: dict[int, Encoder] = {}  # of this worker


def _opened(model: bytes) -> Encoder:
    key = hash(model)
    if key not in _open:
        _open[key] = Encoder(model)
    return _open[key]


def encoder(model: bytes, checked: bool = True, end: bool = True) -> Callable[[Column], Column]:
    """A column function: text to array<int> of ids."""
    def run(texts: pa.Array) -> pa.Array:
        return _opened(model).encoded(texts, checked, end)
    return F.arrow_udf(run, "array<int>")


def decoded(vocabulary: Vocabulary, ids: pa.Array) -> pa.Array:
    """The texts of lists of ids, each taken from the flat numbers of the batch; one Arrow object per id would cost more than decoding."""
    numbers, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
    rows = zip(at[:-1], at[1:], ids.is_valid().to_pylist())
    return pa.array([vocabulary.text(numbers[a:b].tolist() if there else []) for a, b, there in rows], pa.string())


def decoder(model: bytes) -> Callable[[Column], Column]:
    """A column function: array<int> of ids to text."""
    def run(ids: pa.Array) -> pa.Array:
        return decoded(_opened(model).vocabulary, ids)
    return F.arrow_udf(run, "string")


def round_trip(model: bytes, checked: bool = True, end: bool = True) -> Callable[[Column], Column]:
    """A column function: text to struct<ids, decoded>. A decoder over an encoder's column would have Spark encode every text twice, once
    for the ids and once within the chain."""
    def run(texts: pa.Array) -> pa.Array:
        ids = _opened(model).encoded(texts, checked, end)
        return pa.StructArray.from_arrays([ids, decoded(_opened(model).vocabulary, ids)], ["ids", "decoded"])
    return F.arrow_udf(run, "struct<ids:array<int>,decoded:string>")


def with_ids(docs: DataFrame, model: bytes, text: str = "text", into: str = "ids", checked: bool = True) -> DataFrame:
    """``docs`` with the ids of a text column; a column of the result's name is replaced."""
    return docs.withColumn(into, encoder(model, checked)(F.col(text)))


def with_round_trip(docs: DataFrame, model: bytes, text: str = "text", into: str = "ids", back: str = "decoded", checked: bool = True) -> DataFrame:
    """``docs`` with the ids of a text column and the text decoded from them, each text encoded once; columns of these names are replaced."""
    both = round_trip(model, checked)(F.col(text))
    return docs.withColumns({into: both["ids"], back: both["decoded"]})


def op11(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = f.read()
    out = with_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
