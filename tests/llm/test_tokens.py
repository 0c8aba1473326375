"""Splices of huge documents with no help from the vocabulary: other pieces, other scripts, no spaces."""

import random

import pytest
from sentencepiece import sentencepiece_model_pb2 as pb

from velarium.llm import tokencount
from velarium.llm.queries import PIECE_BPE, tokenizer_path


def vocabulary(path, pieces, kind="BPE", **normaliser):
    """A model file with the given pieces, the first ones merged first."""
    m = pb.ModelProto()
    m.trainer_spec.model_type = getattr(m.trainer_spec, kind)
    m.trainer_spec.byte_fallback = True
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.remove_extra_whitespaces = False
    for k, v in normaliser.items():
        setattr(m.normalizer_spec, k, v)
    for name, of in (("<unk>", m.SentencePiece.UNKNOWN), ("<s>", m.SentencePiece.CONTROL), ("</s>", m.SentencePiece.CONTROL)):
        m.pieces.add(piece=name, score=0, type=of)
    for b in range(256):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=m.SentencePiece.BYTE)
    for i, p in enumerate(dict.fromkeys(pieces)):
        m.pieces.add(piece=p, score=-i)
    path.write_bytes(m.SerializeToString())
    return tokencount.Counter(str(path))


def grown(seed, n=60):
    """Pieces with marks anywhere in them, each made of two earlier ones."""
    draw = random.Random(seed)
    pieces = ["a", "b", "c", "é", "▁"]
    while len(pieces) < n:
        pieces.append(draw.choice(pieces) + draw.choice(pieces))
    merged = list(dict.fromkeys(pieces[5:]))
    draw.shuffle(merged)
    return [*merged, *pieces[:5]]


@pytest.mark.parametrize("seed", range(12))
def test_any_pieces(tmp_path, monkeypatch, seed):
    c = vocabulary(tmp_path / "m.model", grown(seed))
    assert c.spliced and not c.stable
    draw = random.Random(seed)
    texts = ["".join(draw.choice("aabc é  \n漢😀") for _ in range(draw.randrange(50, 900))) for _ in range(20)]
    texts += ["a" * 700, "ab " * 200, " " * 400, "abc" * 150, "漢" * 300, "a b" * 100 + "c" * 300, "▁a▁" * 90]
    for chunk, overlap in ((40, 6), (64, 20), (300, 10)):
        monkeypatch.setattr(tokencount, "CHUNK", chunk)
        monkeypatch.setattr(tokencount, "OVERLAP", overlap)
        assert [c.huge(t) for t in texts] == [len(c.model.encode(t)) for t in texts]
    assert c.widened


def test_overlaps_are_widened_until_tokens_agree(tmp_path, monkeypatch):
    monkeypatch.setattr(tokencount, "CHUNK", 50)
    monkeypatch.setattr(tokencount, "OVERLAP", 7)
    c = vocabulary(tmp_path / "m.model", ["aa", "aaaa", "a", "b", "▁"])
    text = "b" * 3 + "a" * 400
    assert c.huge(text) == len(c.model.encode(text))
    assert c.widened >= 7  # runs of fours that begin elsewhere never meet: at each chunk the overlap grows to the text's start
    c.widened = 0
    text = "ba" * 300
    assert c.huge(text) == len(c.model.encode(text)) and c.widened == 0


def test_scripts_without_the_proof_of_spaces(monkeypatch):
    c = tokencount.Counter(tokenizer_path(PIECE_BPE))
    c.stable = False
    draw = random.Random(4)
    scripts = ["etaoin shrdlu", "абвгдеж зиклмн", "漢字仮名交文書", "हिन्दी लिपि", "العربية", "😀👍🏽é́ ", "ภาษาไทย", "0123456789abcdef", "aA1.,;\n\t "]
    texts = ["".join(draw.choice(s) for _ in range(3000)) for s in scripts] + ["".join(draw.choice(draw.choice(scripts)) for _ in range(3000)) for _ in range(5)]
    monkeypatch.setattr(tokencount, "HUGE", 500)
    monkeypatch.setattr(tokencount, "CHUNK", 400)
    monkeypatch.setattr(tokencount, "OVERLAP", 40)
    assert c.counts(texts) == [len(c.model.encode(t)) for t in texts]
    encoded = []
    real = c._chunk
    monkeypatch.setattr(c, "_chunk", lambda data, start, stop: encoded.append(stop - start) or real(data, start, stop))
    assert c.huge(texts[2]) == len(c.model.encode(texts[2])) and max(encoded) < 1000 and c.widened <= 2  # no space in it, and never encoded whole


def test_vocabularies_without_the_proof_go_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(tokencount, "HUGE", 50)
    monkeypatch.setattr(tokencount, "CHUNK", 30)
    for c in (vocabulary(tmp_path / "u.model", grown(1), "UNIGRAM"), vocabulary(tmp_path / "n.model", grown(1), remove_extra_whitespaces=True)):
        assert not c.spliced
        monkeypatch.setattr(c, "huge", lambda t: 1 / 0)
        texts = ["abc  a" * 40, "a b"]
        assert c.counts(texts) == [len(c.model.encode(t)) for t in texts]
