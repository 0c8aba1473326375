"""Token counts with overlap resynchronisation for huge documents.

A document longer than ``HUGE`` characters is encoded in chunks that overlap,
with the place of each token, and two chunks are spliced at a token that both
have in the overlap, at the same place.  Such a token is a proven boundary,
whatever the vocabulary, if pieces come from merges in a fixed order of
priority (BPE).  A run of tokens is the encoding of its text if and only if
each two neighbours are that of theirs: as long as no merge has crossed a
boundary, what lies between two boundaries evolves as it does alone, so the
first merge to cross one would cross it in the text of the two neighbours as
well.  Up to the common token all neighbours are neighbours in the old chunk,
from it on in the new one, so all neighbours of the spliced run are right, and
with them the run.  The first token of a chunk does not count, since the
library puts a mark in front of it.  If the chunks have no token in common, the
overlap is widened; at last the new chunk begins at the text's start and takes
the old one's place.  Other kinds of vocabulary, and normalisers that change
texts, have no such proof: their documents go to the library whole.

Ordinary documents are cut where a space follows something else, and each
distinct segment is encoded by the library once per worker; ``stable_marks``
proves for the loaded vocabulary that this changes nothing, and where it does
not hold such documents go to the library whole.

Defined cases: null and empty texts have 0 tokens; ordinary texts with U+2581
itself (the word mark) are encoded whole; columns named like the results are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: In characters, bytes and bytes.
HUGE, CHUNK, OVERLAP = 16_000, 8_000, 400
#: Entries of a worker's memo; longer segments than LONGEST are not kept.
MEMO, LONGEST = 800_000, 48
_loaded: dict[str, Counter] = {}


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memo: dict[str, int] = {}
        self.stable, self.spliced, self.widened = self.stable_marks(), self.merges_by_rank(), 0

    def stable_marks(self) -> bool:
        """Whether no piece has the mark behind another character, and texts reach the model as they are."""
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inner = any(MARK in p.lstrip(MARK) for p in pieces)
        probe = " a  b \tcÅ\n "
        plain = "".join(p.surface for p in self.model.encode(probe, return_type="proto").pieces) == probe
        return not inner and plain and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")

    def merges_by_rank(self) -> bool:
        """Whether the vocabulary is a BPE one that takes texts as they are, all of it open to merges: what the proof of the splices needs."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.model.serialized_model_proto())
        spec = model.normalizer_spec
        fixed = any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces)
        return model.trainer_spec.model_type == model.trainer_spec.BPE and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and not fixed

    def _chunk(self, data: bytes, start: int, stop: int) -> list[tuple[int, int, int]]:
        """Begin, end (in bytes of the text) and id of the tokens of data[start:stop]."""
        return [(p.begin + start, p.end + start, p.id) for p in self.model.encode(data[start:stop].decode(), return_type="proto").pieces]

    def huge(self, text: str) -> int:
        """Tokens of a huge text, by splicing chunks."""
        data = text.encode()
        end, count = _whole(data, CHUNK), 0
        tokens = self._chunk(data, 0, end)
        while end < len(data):
            overlap, stop = OVERLAP, _whole(data, end + CHUNK)
            while True:
                start = _whole(data, max(end - overlap, 0))
                new = self._chunk(data, start, stop)
                if start == 0:  # nothing to splice: this is the encoding of all up to here
                    count, tokens = 0, new
                    break
                joined = self._splice(tokens, new)
                if joined is not None:
                    count += joined[0]
                    tokens = new[joined[1] :]
                    break
                overlap *= 4
                self.widened += 1
            end = stop
        return count + len(tokens)

    def _splice(self, old: list[tuple[int, int, int]], new: list[tuple[int, int, int]]) -> tuple[int, int] | None:
        """Tokens kept of the old chunk and dropped of the new one: up to and with the last token that both have; None without one.

        Tokens of unknown characters, and the bytes of one, are no pieces that
        merges made: they are passed over.
        """
        places = {t: n for n, t in enumerate(new) if n}
        for n in range(len(old) - 1, -1, -1):
            t = old[n]
            if t[0] < new[0][0]:
                return None
            if t in places and t[1] > t[0] and not self.model.is_unknown(t[2]) and not self.model.is_byte(t[2]):
                return n + 1, places[t] + 1
        return None

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = [0] * len(texts)
        split: list[list[str] | None] = []
        for i, t in enumerate(texts):
            if not t:
                split.append([])
            elif len(t) > HUGE and self.spliced:
                split.append(None)
                out[i] = self.huge(t)
            elif not self.stable or MARK in t:
                split.append(None)
                out[i] = len(self.model.encode(t))
            else:
                split.append(segments(t))
        new = set().union(*(s for s in split if s)).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set().union(*(s for s in split if s))
        fresh = list(new)
        learnt: dict[str, int] = {}
        for k in range(0, len(fresh), 4096):
            learnt.update(zip(fresh[k : k + 4096], map(len, self.model.encode(fresh[k : k + 4096], num_threads=1)), strict=True))
        if "" in learnt:
            learnt[""] = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.memo.update((w, n) for w, n in learnt.items() if len(w) <= LONGEST)
        long = {w: n for w, n in learnt.items() if len(w) > LONGEST}
        get = (lambda w: long[w] if w in long else self.memo[w]) if long else self.memo.__getitem__
        for i, s in enumerate(split):
            if s:
                out[i] = sum(map(get, s))
        return out


def _whole(data: bytes, end: int) -> int:
    """The last end of a character up to ``end``."""
    end = min(end, len(data))
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return end


def segments(text: str) -> list[str]:
    """A text cut where a space follows something else; each segment without the one space that the library puts back.

    A last segment of one space is thus an empty one; it counts as one token.
    """
    words = text.split(" ")
    if "" not in words:
        return words
    # Runs of spaces: all but the last belong in front of the word behind them.
    out, spaces = [], 0
    for n, w in enumerate(words):
        if w == "" and n + 1 < len(words):
            spaces += 1
            continue
        out.append(" " * spaces + w)
        spaces = 0
    return out


def counter(path: str) -> Counter:
    """This worker's counter for the file."""
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(df: DataFrame, model: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """Add n_bytes, n_tokens and over_limit."""

    @F.arrow_udf("long")
    def tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(model)
        for batch in texts:
            out: list[int] = []
            for k in range(0, len(batch), 1024):
                out += c.counts([t or "" for t in batch.slice(k, 1024).to_pylist()])
            yield pa.array(out, pa.int64())

    kept = df.drop("n_bytes", "n_tokens", "over_limit")
    out = kept.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")).withColumn("n_tokens", tokens(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
