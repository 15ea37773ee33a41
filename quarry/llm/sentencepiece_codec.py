"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array
trie of pieces.

*Vocabulary.*  Pieces, scores and byte pieces are read from a public
``.model`` file with the sentencepiece library; nothing is trained.  The
ordinary pieces, as UTF-8, fill a double-array trie (``base``/``check``: the
child of node s by byte c is ``t = base[s] + c`` if ``check[t] == s``), built
once on the driver; its size is that of the vocabulary.

*Scores.*  A Unigram model's scores are log probabilities and stay as they
are.  A merge model's are whole numbers, the negative ranks of its pieces by
frequency (and ``NO_RANK`` for pieces outside of the merges, whose rank is
their place in the list); by Zipf's law a piece of rank r has a probability
in proportion to 1 / (1 + r), so its log score is ``-ln(1 + r)``.

*Encoding.*  A text gets the white-space marker in front and for each space.
No piece holds a marker after another character (checked when the trie is
built), so the best path of a text is the best paths of its marker-led
segments in a row; segments are memoised per task in a table of bounded
size.  Viterbi keeps the best score up to every character; a character that
is no piece itself may pass as unknown at the least score minus
``UNKNOWN_PENALTY`` and becomes its UTF-8 bytes' pieces (byte fallback).  Of
equal paths the one that was found first stays: earlier starts, then shorter
pieces.

*Decoding.*  Pieces and bytes are joined, markers become spaces, the leading
one goes.

Defined results: null and empty texts have no pieces and decode to the empty
text; a marker character in a text decodes to a space (the only loss);
repeated rows each give a row; an empty table gives none; texts are encoded
whole; only id and text (and columns ``keep``) are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import whole_text

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
NO_RANK = -1e9  # fixed: the score of a piece that no merge makes
NEVER = float("-inf")
MEMO_SEGMENTS = 500_000
MEMO_CHARS = 48
SEGMENT = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")


class DoubleArray:
    """A trie of byte strings; ``value[node]`` is the string's number or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: dict[int, dict[int, int]] = defaultdict(dict)  # of the plain trie
        ends: dict[int, int] = {}
        n = 1
        for key, number in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = n
                    n += 1
                node = children[node][c]
            ends[node] = number
        size = n + 512
        self.base, self.check = array("i", [0]) * size, array("i", [-1]) * size
        self.value = array("i", [-1]) * size
        taken = bytearray(size)
        taken[0] = 1
        queue = [(0, 0)]  # plain node and its place
        free = wide = 1  # where to look for room for one child, for several
        for node, place in queue:
            self.value[place] = ends.get(node, -1)
            kids = children.get(node)
            if not kids:
                continue  # base 0: no place there has this node as its parent
            codes = sorted(kids)
            while taken[free]:
                free += 1
            wide = max(wide, free)
            # may be below 0: a byte that leads nowhere then reads from the
            # array's end, where no place has this early node as its parent
            at = (free if len(codes) == 1 else wide) - codes[0]
            while any(taken[at + c] for c in codes):
                at += 1
                if at + 256 >= len(taken):
                    more = len(taken)
                    taken.extend(bytes(more))
                    for a, x in ((self.base, 0), (self.check, -1), (self.value, -1)):
                        a.extend(array("i", [x]) * more)
            if len(codes) > 1:
                wide = at + codes[0]
            self.base[place] = at
            for c in codes:
                taken[at + c] = 1
                self.check[at + c] = place
                queue.append((kids[c], at + c))


class Vocabulary:
    """Pieces of a model file, their scores and the trie of ordinary ones."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.score = array("d")
        ordinary: dict[bytes, int] = {}
        for i in range(sp.get_piece_size()):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            self.score.append(score)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                if MARKER in piece.lstrip(MARKER):
                    raise ValueError(f"piece {i} holds a marker after another character")
                ordinary[piece.encode()] = i
                self.bytes_of.append(piece.encode())
        if len(self.byte_id) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        places = sorted(ordinary.values())
        if all(self.score[i].is_integer() for i in places):
            for place, i in enumerate(places):
                rank = place if self.score[i] <= NO_RANK else -self.score[i]
                self.score[i] = -math.log1p(rank)
        self.unknown = min((self.score[i] for i in places), default=0.0) - UNKNOWN_PENALTY
        self.trie = DoubleArray(ordinary)
        self._encoder: Encoder | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoder": None}

    def encoder(self) -> Encoder:
        """The encoder of this process: its memo serves all tasks of a worker."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder


class Encoder(dict):
    """Piece ids of each segment, filled as segments are asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        trie = vocabulary.trie
        self.base, self.check, self.value = list(trie.base), list(trie.check), list(trie.value)
        # what a path gains at a node: its piece's score, nothing reachable otherwise
        self.gain = [vocabulary.score[k] if k >= 0 else NEVER for k in self.value]
        pieces = (vocabulary.bytes_of[k] for k in self.value if k >= 0)
        self.alone = {p for p in pieces if len(p.decode("utf-8")) == 1}

    def viterbi(self, segment: str) -> array:
        base, check, gain, alone = self.base, self.check, self.gain, self.alone
        s = segment.encode()
        n = len(s)
        best = [NEVER] * (n + 1)
        best[0] = 0.0
        back = [0] * (n + 1)  # where the last piece of the best path begins
        node_of = [0] * (n + 1)  # and its node, 0 for an unknown character
        for i in range(n):
            so_far = best[i]
            if so_far == NEVER:  # inside a character
                continue
            node = 0
            for j in range(i, n):
                to = base[node] + s[j]
                if check[to] != node:
                    break
                node = to
                at = so_far + gain[to]
                if at > best[j + 1]:
                    best[j + 1] = at
                    back[j + 1] = i
                    node_of[j + 1] = to
            c = s[i]
            end = i + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            if s[i:end] not in alone and so_far + self.v.unknown > best[end]:
                best[end], back[end], node_of[end] = so_far + self.v.unknown, i, 0
        ids: list[int] = []
        j = n
        while j > 0:
            i = back[j]
            if node_of[j]:
                ids.append(self.value[node_of[j]])
            else:
                ids.extend(self.v.byte_id[b] for b in reversed(s[i:j]))
            j = i
        ids.reverse()
        return array("i", ids)

    def __missing__(self, segment: str) -> array:
        ids = self.viterbi(segment)
        if len(segment) <= MEMO_CHARS:
            if len(self) >= MEMO_SEGMENTS:
                self.clear()
            self[segment] = ids
        return ids

    def encode(self, text: str) -> array:
        out = array("i")
        if text:
            for segment in SEGMENT.findall(MARKER + text.replace(" ", MARKER)):
                out.extend(self[segment])
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.v.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARKER, " ")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, *keep, ids (piece ids of the whole text), n_pieces,
    n_byte_pieces, decoded_sha256 (of the decoded ids), round_trip (the
    decoded text is the text) per row.

    ``path``: a ``.model`` file that the driver can read; default: the public
    ``piece_bpe_32k.model``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value.encoder()
        byte_ids = frozenset(enc.v.byte_id.values())
        for b in batches:
            flat, ends, fallback, digest, same = array("i"), [0], [], [], []
            for value in b.column(b.num_columns - 1):
                text = value.as_py()
                ids = enc.encode(text)
                flat.extend(ids)
                ends.append(len(flat))
                fallback.append(sum(map(byte_ids.__contains__, ids)))
                back = enc.decode(ids)
                digest.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(
                pa.int32(), len(flat), [None, pa.py_buffer(flat.tobytes())]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], lists, pa.array([y - x for x, y in zip(ends, ends[1:])], pa.int64()),
                 pa.array(fallback, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())],
                names=[*b.schema.names[:-1], "ids", "n_pieces", "n_byte_pieces", "decoded_sha256", "round_trip"])

    rows = docs.select(F.col(id_col), *[F.col(f"`{c}`") for c in keep], whole_text(text_col).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "ids array<int>", "n_pieces long", "n_byte_pieces long",
                                           "decoded_sha256 string", "round_trip boolean"]))


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, text: the decoded text of each row's piece ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value.encoder()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([enc.decode(x.as_py() or []) for x in b.column(1)], pa.string())],
                names=[id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")
