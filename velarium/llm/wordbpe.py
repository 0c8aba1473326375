"""Whole texts encoded by a BPE tokenizer, one distinct word at a time.

A text's ids are its words' ids in a row, if nothing the tokenizer does looks
past white space.  ``separable`` proves that for the loaded file from its
parts: every normaliser step treats the two sides of a space apart (canonical
composition, folding of white space, lower-casing), every piece that the
pre-tokenizer cuts is a run of one kind of character without white space, and
no added token holds white space.  Of a file that it cannot prove this for,
whole texts go to the library.

Words are cut at spaces and line feeds only; what else Unicode calls white
space stays inside a word and is left to the library.  ASCII signs behind a
word of letters are a piece of the pre-tokenizer's own, so letters and signs
are looked at apart.  Cutting and finding what is distinct in a run of texts happen
in Arrow and numpy; the library encodes what a worker has not met.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of letters in a worker's memo, and their bytes, at most.
MEMO, MEMO_BYTES = 600_000, 16 << 20
#: Bytes of text encoded at once, and words that the library gets in a row.
TEXTS, ROW = 4 << 20, 2048
#: Normalisers that never join the two sides of a space, with the settings that this holds for.
STEPS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
#: Alternatives of a pre-tokenizer's pattern that match no white space; runs of letters and of signs are one match each.
LETTERS, SIGNS = r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"
KINDS = re.compile(r"'[a-z]+|\[\\p\{[LN]\}\]\+?|" + re.escape(SIGNS))

#: ASCII signs but the apostrophe, which may begin a piece together with letters.
SIGN = np.zeros(256, bool)
SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and c != ord("'")]] = True
#: Bytes of Latin-1's letters in UTF-8: ASCII ones, and those behind the byte 0xC3 but for the two signs among them.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
LEAD = 0xC3
_after = np.zeros(256, bool)
_after[0x80:0xC0] = True
_after[[0x97, 0xB7]] = False
_loaded: dict[str, WordEncoder] = {}


def separable(spec: dict) -> bool:
    """Whether a tokenizer's file proves that words between white space are encoded apart."""
    steps, cuts = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = steps.get("normalizers", [steps] if steps else [])
    cuts = cuts.get("pretokenizers", [cuts])
    if not all(s in STEPS for s in steps) or len(cuts) != 2:
        return False
    split, bytes_ = cuts
    kinds = split.get("pattern", {}).get("Regex", "").split("|")
    return (
        split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
        and all(KINDS.fullmatch(k) for k in kinds) and LETTERS in kinds and SIGNS in kinds
        and bytes_.get("type") == "ByteLevel" and not bytes_.get("add_prefix_space") and not bytes_.get("use_regex", True)
        and spec["model"].get("type") == "BPE" and bool(spec["model"].get("end_of_word_suffix"))
        and not spec["model"].get("dropout") and spec["model"].get("unk_token") is None
        and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
    )


def parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and its n + 1 offsets into them."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def whole(raw: np.ndarray, length: np.ndarray) -> pa.Array:
    """A string array of these bytes."""
    at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())])


def cut_signs(words: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Which words are Latin-1 letters and perhaps signs behind them; those words' letters, and their signs."""
    raw, at = parts(words)
    place, size = np.arange(len(raw)), np.diff(at)
    behind = np.concatenate([[0], raw[:-1]]) == LEAD
    bad = np.concatenate([[0], np.cumsum(~(LETTER[raw] | (raw == LEAD) | (_after[raw] & behind)))])
    last = np.maximum.accumulate(np.where(SIGN[raw], -1, place)) if len(raw) else place
    end = np.where(size > 0, last[np.maximum(at[1:] - 1, 0)] + 1 if len(raw) else 0, 0)  # behind the last byte that is no sign
    plain = (end > at[:-1]) & (bad[np.maximum(end, at[:-1])] == bad[at[:-1]])
    of = np.repeat(plain, size)
    head = place < np.repeat(end, size)
    return plain, whole(raw[of & head], (end - at[:-1])[plain]), whole(raw[of & ~head], (at[1:] - end)[plain])


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.separable = separable(spec)
        self.lowers = {"type": "Lowercase"} in (spec.get("normalizer") or {}).get("normalizers", [])
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        #: Words, their ids one after another, and how many each has.
        self.memo = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.separable:
            suffix = spec["model"]["end_of_word_suffix"]
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[n for t, n in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def _library(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of strings and how many each has."""
        ids, size = [], []
        for k in range(0, len(texts), ROW):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.slice(k, ROW).to_pylist(), add_special_tokens=False)]
            size.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((i for f in found for i in f), np.uint32, int(size[-1].sum())))
        return ids, size

    def _letters(self, words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same for distinct words of letters, through the memo."""
        known, flat, size = self.memo
        at = pc.index_in(words, value_set=known)
        new = words.filter(at.is_null())
        if len(new):
            found, sizes = self._rows(new)
            known, flat, size = pa.concat_arrays([known, new]), np.concatenate([flat, *found]), np.concatenate([size, *sizes])
        pick = np.asarray(at.fill_null(0).to_numpy()).astype(np.int64)
        pick[at.is_null().to_numpy(zero_copy_only=False)] = len(known) - len(new) + np.arange(len(new))
        ids, upto = gathered(flat, size, pick)
        while len(known) > 1 and (len(known) > MEMO or parts(known)[1][-1] > MEMO_BYTES):
            half = len(known) // 2  # the older half goes
            known, flat, size = pa.concat_arrays([known.slice(half)]), flat[size[:half].sum() :].copy(), size[half:].copy()
        self.memo = known, flat, size
        return [ids], [np.diff(upto, prepend=0)]

    def _rows(self, words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same for any words of letters: the library gets many in a row; the first piece that ends a word ends it."""
        at = pa.array([*range(0, len(words), ROW), len(words)], pa.int32())
        rows = pc.binary_join(pa.ListArray.from_arrays(at, words), " ").to_pylist()
        ids, size = [], []
        for k, row in enumerate(self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)):
            found = np.array(row.ids, np.uint32)
            last = np.flatnonzero(self.ends[found]) + 1
            some = words.slice(k * ROW, ROW)
            if len(last) == len(some) and last[-1] == len(found):
                one, n = [found], [np.diff(last, prepend=0)]
            else:
                one, n = self._library(some)
            ids += one
            size += n
        return ids, size

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and how many each has."""
        plain, letters, signs = cut_signs(words)
        letters, signs = letters.dictionary_encode(), signs.dictionary_encode()
        found = [self._letters(letters.dictionary), self._library(signs.dictionary), self._library(words.filter(pa.array(~plain)))]
        flat = np.concatenate([np.zeros(0, np.uint32), *(a for ids, _ in found for a in ids)])
        size = np.concatenate([np.zeros(0, np.int64), *(a for _, sizes in found for a in sizes), [0]])
        n, m = len(letters.dictionary), len(signs.dictionary)
        pick = np.full((len(words), 2), len(size) - 1)  # the last item is empty
        pick[plain, 0], pick[plain, 1] = letters.indices.to_numpy(), n + signs.indices.to_numpy()
        pick[~plain, 0] = n + m + np.arange(len(words) - plain.sum())
        ids, upto = gathered(flat, size, pick.reshape(-1))
        return ids, np.diff(upto[1::2], prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (strings, null as empty), one text after another, and where each text's end."""
        texts = pc.fill_null(texts, "")
        if not self.separable:
            ids, size = self._library(texts)
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum(np.concatenate([np.zeros(0, np.int64), *size]))
        words = pc.split_pattern(pc.replace_substring(self._folded(texts), "\n", " "), " ")
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        ids, upto = gathered(*self._table(coded.dictionary), coded.indices.to_numpy())
        ends = np.concatenate([[0], upto])[ends]
        del words, coded, upto
        pa.default_memory_pool().release_unused()
        return ids, ends

    def _folded(self, texts: pa.Array) -> pa.Array:
        """A-Z lowered ahead of the library's own step, for fewer distinct words, where that changes no id.

        A combining mark may compose with one case only, and added tokens are
        looked for before that step: texts with a character from U+0300 on, or
        with an added token in some case, stay as they are.
        """
        if not self.lowers:
            return texts
        raw, at = parts(texts)
        high = raw >= 0xCC
        stays = pa.array(np.diff(np.concatenate([[0], np.cumsum(high)])[at]) > 0) if high.any() else None
        for token in self.added:
            holds = pc.match_substring(texts, token, ignore_case=True)
            stays = holds if stays is None else pc.or_(stays, holds)
        lowered = pc.ascii_lower(texts)
        return lowered if stays is None else pc.if_else(stays, texts, lowered)


def gathered(flat: np.ndarray, length: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items ``pick`` of a table of ids, one after another, and where each ends; the table's items have these lengths."""
    begin, of = np.cumsum(length) - length, length[pick]
    upto = np.cumsum(of)
    place = np.repeat((begin[pick] - upto + of).astype(np.int32), of)  # there are fewer ids than bytes, and Arrow holds less than 2**31 of these
    place += np.arange(len(place), dtype=np.int32)
    return flat[place], upto


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def runs(texts: pa.Array, most: int = TEXTS):
    """Consecutive index ranges of about ``most`` bytes of text; a longer text stands alone."""
    size = np.diff(parts(pc.fill_null(texts, ""))[1])
    start = total = 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(size):
        yield start, len(size)
