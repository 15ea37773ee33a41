"""Token counts and SentencePiece against the libraries and brute force."""

import hashlib
from collections import Counter
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

from quarry.llm import sentencepiece_codec as S
from quarry.llm import token_counts as T


def test_token_counts_equal_library(spark, edge, real):
    tok = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    special = spark.createDataFrame(
        [(900, "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>"), (901, "ÉCOLE école Σας ﬁ ́x don't 3rd!!??"),
         (902, "a\x1cb\x85c　d İ")], "doc_id long, text string")
    for docs in (edge, real, special):
        rows = docs.select("doc_id", "text").collect()
        want = Counter((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids))
                       for r in rows)
        got = T.token_counts(docs, limit=100).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_token_counts_of_no_rows(none):
    assert T.token_counts(none).collect() == []


def test_whole_tokens_are_single_tokens():
    tok = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    whole = T.whole_tokens(public_tokenizers.path(T.VOCABULARY))
    assert len(whole) > 30_000 and "the" in whole
    assert all(len(tok.encode(w, add_special_tokens=False).ids) == 1 for w in ("the", "house", "!"))


def test_double_array_finds_its_keys_and_no_others():
    keys = {k.encode(): i for i, k in enumerate(["a", "ab", "abc", "b", "é", "éa", "zz", "▁the"])}
    d = S.DoubleArray(keys)

    def find(s):
        node = 0
        for c in s:
            to = d.base[node] + c
            if d.check[to] != node:
                return -1
            node = to
        return d.value[node]

    assert all(find(k) == i for k, i in keys.items())
    assert all(find(k.encode()) == -1 for k in ("", "z", "abcd", "c", "▁"))


def brute(v, text):
    """Best score over all segmentations of a short text."""
    pieces = {b: i for i, b in enumerate(v.bytes_of) if b and i not in set(v.byte_id.values())}

    @lru_cache(None)
    def best(i):
        if i == len(text):
            return 0.0
        found = [v.score[pieces[text[i:j].encode()]] + best(j) for j in range(i + 1, len(text) + 1)
                 if text[i:j].encode() in pieces]
        if text[i].encode() not in pieces:
            found.append(v.unknown + best(i + 1))
        return max(found)

    return best(0)


def test_viterbi_is_the_best_path():
    v = S.Vocabulary(public_tokenizers.path(S.MODEL))
    enc = S.Encoder(v)
    bytes_ids = set(v.byte_id.values())
    for word in ("theaeati", "hested", "unbelievable", "naïve", "\n", "a\nb", "日本語x", "🙂🙂", "internationalization"):
        text = S.MARKER + word
        ids = enc.viterbi(text)
        unknown = sum(1 for c in text if c.encode() not in set(v.bytes_of) - {bytes([b]) for b in range(256)} and
                      c.encode() not in {p for i, p in enumerate(v.bytes_of) if i not in bytes_ids})
        score = sum(v.score[i] for i in ids if i not in bytes_ids) + unknown * v.unknown
        assert abs(score - brute(v, text)) < 1e-9, word
        assert enc.decode(enc.encode(word)) == word


def test_encode_round_trip_and_decode(spark, edge, real):
    enc = S.Encoder(S.Vocabulary(public_tokenizers.path(S.MODEL)))
    for docs in (edge, real):
        rows = docs.select("doc_id", "text").collect()
        got = S.encode(docs).collect()
        want = Counter((r.doc_id, tuple(enc.encode(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest())
                       for r in rows)
        assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in got) == want
        assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    back = S.decode(S.encode(edge)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.text or "") for r in edge.collect())


def test_marker_in_text_is_a_space(spark, none):
    docs = spark.createDataFrame([(1, "a▁b"), (2, "  a")], "doc_id long, text string")
    got = {r.doc_id: (r.round_trip, r.decoded_sha256) for r in S.encode(docs).collect()}
    assert got == {1: (False, hashlib.sha256(b"a b").hexdigest()), 2: (True, hashlib.sha256(b"  a").hexdigest())}
    assert S.encode(none).collect() == []


def test_paths_equal_the_library_lattice(real):
    """The same pieces read as a Unigram model by the library: its best
    lattice path scores as ours (its fast ``encode`` may settle for less)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = public_tokenizers.path(S.MODEL)
    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    enc = S.Encoder(S.Vocabulary(path))
    for piece, score in zip(model.pieces, enc.v.score):
        piece.score = score
    lib = sentencepiece.SentencePieceProcessor()
    lib.LoadFromSerializedProto(model.SerializeToString())
    words = sorted({w for r in real.limit(60).collect() for w in (r.text or "").split()})
    assert len(words) > 500
    same = 0
    for w in words:
        ours, theirs = list(enc.encode(w)), lib.NBestEncodeAsIds(w, 4)[0]
        # the library adds in single precision
        assert abs(sum(enc.v.score[i] for i in ours) - sum(enc.v.score[i] for i in theirs)) < 1e-4, w
        same += ours == theirs
    assert same > 0.99 * len(words)


def test_scores_are_log_scores():
    import math

    import sentencepiece

    path = public_tokenizers.path(S.MODEL)
    sp, v = sentencepiece.SentencePieceProcessor(model_file=path), S.Vocabulary(path)
    ordinary = [i for i in range(3, sp.get_piece_size()) if not sp.is_byte(i)]
    for place, i in enumerate(ordinary):
        rank = place if sp.get_score(i) <= S.NO_RANK else -sp.get_score(i)
        assert v.score[i] == -math.log1p(rank)
    assert v.unknown == min(v.score[i] for i in ordinary) - 10 > -25
    assert all(v.score[i] == 0 for i in v.byte_id.values())
