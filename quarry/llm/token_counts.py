"""Token counts with the whole-token shortcut.

Counts the tokens that a ``tokenizers`` BPE file gives, without merging the
words that need no merging:

1. *Offline proof* (``whole_tokens``): every vocabulary string that ends a
   word is encoded alone by the library's own model; those that come back as
   exactly one token are whole tokens.  This reads the vocabulary only.
2. A text is cut at ASCII white space.  No pre-token and no special string of
   the file holds white space, and Unicode composition never crosses it, so
   the pieces between are normalised and pre-tokenised alone by the library.
3. A pre-token that is a whole token counts one; only the rest is merged.
4. A piece that holds a special string (``<|endoftext|>`` ...) goes through
   the library's full ``encode``, which cuts special strings out first.

Counts of pieces are memoised per task in a table of bounded size.  Rows stay
where they are: one ``mapInArrow`` over the scan, no shuffle.

Defined results: null and empty texts have 0 bytes and 0 tokens; a text of
any length is counted whole; repeated rows each give a row; an empty table
gives none; only ``id_col`` and ``text_col`` are read, so other columns can
have any name; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import whole_text

VOCABULARY = "word_bpe_49k.json"
MEMO_PIECES = 400_000  # memoised pieces per task ...
MEMO_BYTES = 64  # ... of at most this length


def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> frozenset[str]:
    """Word-ending vocabulary strings (without the end mark) that the model
    encodes alone as one token: the shortcut's proof, one pass over the
    vocabulary."""
    import json

    with open(path, encoding="utf-8") as f:
        mark = json.load(f)["model"]["end_of_word_suffix"] or ""
    tok = _library(path)
    ends = (s[: len(s) - len(mark)] for s in tok.get_vocab(with_added_tokens=False) if s.endswith(mark))
    return frozenset(s for s in ends if s and len(tok.model.tokenize(s)) == 1)


class PieceCounts(dict):
    """Tokens of each piece between white space, filled as pieces are asked for."""

    def __init__(self, path: str):
        super().__init__()
        self.tok = _library(path)
        added = self.tok.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or not t.content.strip()
               or any(c.isspace() for c in t.content) for t in added):
            raise ValueError("special tokens of this file may reach over white space")
        self.special = [t.content for t in added]
        self.whole = whole_tokens(path)

    def count(self, piece: bytes) -> int:
        s = piece.decode("utf-8")
        if any(x in s for x in self.special):
            return len(self.tok.encode(s, add_special_tokens=False).ids)
        pre = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(s))
        merge = self.tok.model.tokenize
        return sum(1 if p in self.whole else len(merge(p)) for p, _ in pre)

    def __missing__(self, piece: bytes) -> int:
        n = self.count(piece)
        if len(piece) <= MEMO_BYTES:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = n
        return n


def token_counts(docs: DataFrame, limit: int = 2048, path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit (n_tokens > limit) per row.

    ``path`` is a ``tokenizers`` JSON file that every executor can read;
    default: the public ``word_bpe_49k.json``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path
        if file is None:
            import public_tokenizers

            file = public_tokenizers.path(VOCABULARY)
        counts = PieceCounts(file)
        for b in batches:
            sizes, tokens = [], []
            for text in b.column(1):
                t = text.as_buffer().to_pybytes()
                sizes.append(len(t))
                tokens.append(sum(map(counts.__getitem__, t.split())))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("__text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
