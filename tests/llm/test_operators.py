"""Each operator against a plain version, and its defined cases."""

import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from velarium.llm import neardup, packing, tokencount, tokenfiles, toxicity, urlfilter, wordbpe
from velarium.llm.common import shared_dir
from velarium.llm.queries import PIECE_BPE, WORD_BPE, tokenizer_path
from velarium.llm.wordbpe import WordEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, u string"
BITS = ["a", "the", "tion", " ", "  ", "\n", " ", "é", "É", "ß", "漢", ".", ",", "<s>", "\u0301", "Ω", "0", "12", "'s", "\t", "<|endoftext|>", "İ", "Σ", "\x1c", "…", "..", "!?", "▁"]


def prose(n, seed, alphabet=BITS):
    draw = random.Random(seed)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def odd_rows():
    base = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(i % 40)), "en", f"s{i % 3}", 0, 1, "x") for i in range(60)]
    return [*base, *base[:5], (None, "a null id", "en", None, 0, 1, "x"), (100, None, None, None, None, None, None), (101, "", "en", "s1", 0, 1, "x"), (102, "x" * 50_000, "en", "s2", 0, 1, "x"), (103, "w1 w2 w3 " * 9_000, "en", "s2", 0, 1, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1


def test_toxicity_learns_pairs_and_stems(spark):
    draw = random.Random(3)
    rows = []
    for i in range(900):
        words = [draw.choice("alpha beta gamma delta omega".split()) for _ in range(20)]
        toxic = i % 3 == 0
        if toxic:
            words += ["fiend" + draw.choice("abcdefgh"), "clan"]
        elif i % 3 == 1:
            words += [draw.choice(["clan", "fiendish"[:3]])]
        rows.append((i, " ".join(words), int(toxic)))
    documents = spark.createDataFrame(rows, "doc_id long, text string, t int")
    labels = documents.select("doc_id", F.col("t").alias("toxic"))
    model = toxicity.fit(toxicity.training_rows(documents, labels))
    out = toxicity.score(documents, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held"]]
    assert {r["doc_id"] for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == r["t"] for r in held]) > 0.97


def test_toxicity_odd_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    out = toxicity.score(docs.withColumn("score", F.lit("clash")), model)
    assert out.count() == len(odd_rows()) and dict(out.dtypes)["score"] == "double"
    assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, toxicity.fit(toxicity.training_rows(none, labels.limit(0)))).count() == 0


# 3


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = re.split(r"[?#]", rest[end:])[0]
    best = max(((len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    hosts = ["com", "x.example.com", "EXAMPLE.com", "a.b.example.net", "net", "dotcom", "Örg.org", "u@h.com:80", "", "a..com", "com."]
    paths = ["/en/", "/en/7", "/en/71?x", "/de/8#a", "/de/9", "/es/", "", "?/en/", "#x", "/EN/7", "/en"]
    urls = [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths] + [None, "", "com/en/7", "a://b://com/en/", "http://" + "a." * 3000 + "com/en/" + "q" * 9000, "http://x.com\n/en/7\n"]
    urls += urls[:3]
    pages = spark.createDataFrame([(i % 200, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = urlfilter.judge(pages, urlfilter.rules_table(spark)).collect()
    assert sorted((r["page_id"], r["url"] or "", r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in out) == sorted((i % 200, u or "", *(x or "" for x in brute_url(u))) for i, u in enumerate(urls))
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_table(spark)).count() == 0
    assert urlfilter.judge(pages, urlfilter.rules_table(spark).limit(0)).where("verdict <> 'allow'").count() == 0


def test_bloom_has_no_false_negatives(spark):
    rules = [(f"h{i}.org", f"/p{i % 7}", "block") for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://www.h{i}.org/p{i % 7}/x") for i in range(3500)], "page_id long, url string")
    out = urlfilter.judge(pages, urlfilter.rules_table(spark, rules))
    assert out.where("verdict = 'block'").count() == 3000


# 7, 8, 9


def test_word_memo_equals_the_library():
    codec = WordEncoder(tokenizer_path(WORD_BPE))
    texts = prose(1500, 1) + ["A.B, c.", "Été, où.", "x" * 3000, "don't we'll", "", " "]
    assert ids_of(codec, texts) == [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_estimate_loses_less_than_the_bands():
    fields, chance = neardup.BANDS * neardup.ROWS, 2.0**-neardup.BITS
    equal = 0.75 * (1 - chance) + chance
    least = next(n for n in range(fields + 1) if (n / fields - chance) / (1 - chance) >= neardup.LENIENT)
    lost = sum(math.comb(fields, n) * equal**n * (1 - equal) ** (fields - n) for n in range(least))
    assert lost < (1 - 0.75**neardup.ROWS) ** neardup.BANDS


def ids_of(codec, texts):
    ids, ends = codec.encode(pa.array(texts, pa.string()))
    return [part.tolist() for part in np.split(ids, ends[:-1])]


def test_added_tokens_are_matched_as_they_are_written():
    codec = WordEncoder(tokenizer_path(WORD_BPE))
    special = ["<|ENDOFTEXT|>", "<|StartOfText|>", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "a", "B", "É", " ", "\n", ",", "漢"]
    texts = ["a <|ENDOFTEXT|> b", "X<|StartOfText|>Y", *prose(800, 12, special)]
    for t, ids in zip(texts, ids_of(codec, texts), strict=True):
        assert ids == codec.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_words_signs_and_the_memo(monkeypatch):
    monkeypatch.setattr(wordbpe, "MEMO", 300)
    codec = WordEncoder(tokenizer_path(WORD_BPE))
    assert codec.separable
    alphabet = ["Ab", "tion", "é", "É", "×", "÷", "ÿ", "µ", "***", "$", ",", "..", "'", "'S", "-", "7", " ", " ", "\n", "\u0301", "J", "\u030c", "İ", "\x85", "<|", "_"]
    for seed in range(12):
        texts = [None, "", *prose(120, seed, alphabet)]
        for t, ids in zip(texts, ids_of(codec, texts), strict=True):
            assert ids == codec.tokenizer.encode(t or "", add_special_tokens=False).ids, t
        assert len(codec.memo[0]) <= 300


def test_a_file_that_proves_nothing_is_left_to_the_library(tmp_path):
    with open(tokenizer_path(WORD_BPE), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+\s\S+|\S+"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    codec = WordEncoder(str(other))
    assert not codec.separable
    texts = ["a b c, d", "", "é  x", *prose(50, 2)]
    assert ids_of(codec, texts) == [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, docs, none):
    folder = shared_dir(spark)
    tokenfiles.write(docs, folder, tokenizer_path(WORD_BPE), 2)
    codec = WordEncoder(tokenizer_path(WORD_BPE)).tokenizer
    start, want = 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*codec.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokenfiles.read(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    least = spark.createDataFrame([(-(2**63), "a"), (None, "b"), (2**63 - 1, None)], "doc_id long, text string").withColumn("part", F.lit("x"))
    ends = shared_dir(spark)
    tokenfiles.write(least, ends, tokenizer_path(WORD_BPE), 2)
    assert [r["doc_id"] for r in tokenfiles.read(spark, ends).orderBy("start").collect()] == [None, -(2**63), 2**63 - 1]
    empty = shared_dir(spark)
    tokenfiles.write(none, empty, tokenizer_path(WORD_BPE), 2)
    assert tokenfiles.read(spark, empty).count() == 0


def test_packing(docs, none):
    rows = packing.pack(packing.pieces(docs, tokenizer_path(WORD_BPE), 1)).collect()
    codec = WordEncoder(tokenizer_path(WORD_BPE)).tokenizer
    want = []
    for doc_id, text in ((r[0], r[1] or "") for r in odd_rows()):
        ids = [*codec.encode(text, add_special_tokens=False).ids, 1]
        want += [(doc_id, k, k * 4096, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[i : i + 4096] for i in range(0, len(ids), 4096))]
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    check_places(rows)
    total = sum(w[3] for w in want)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 4096) + 1
    assert packing.pack(packing.pieces(none, tokenizer_path(WORD_BPE), 1)).count() == 0


def check_places(rows):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    draw = random.Random(4)
    sizes = [draw.choice([4096, draw.randint(1, 4095), draw.randint(1, 300)]) for _ in range(3000)]
    parts = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], "doc_id long, piece long, start long, length long, ids_crc32 long")
    rows = packing.pack(parts).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    check_places(rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(sizes) // 4096) * 1.02 + 1


def optimum(sizes, room):
    sizes = sorted(sizes, reverse=True)
    best = [len(packing.best_fit(sizes, room))]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + sizes[i] <= room:
                k = bins.index(b)
                go(i + 1, [*bins[:k], b + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_bin_completion_beats_best_fit_and_finds_optima():
    draw, better = random.Random(6), 0
    for _ in range(250):
        sizes = [draw.randint(1, 60) for _ in range(draw.randint(1, 11))]
        bins = packing.complete(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert packing.least_bins(sizes, 100) <= optimum(sizes, 100) == len(bins)
        better += len(bins) < len(packing.best_fit(sizes, 100))
    hard = [6, 6, 6, 4, 4, 4, 3, 3, 3, 7, 7, 7]
    assert len(packing.complete(hard, 20)) == 3


def test_fillings_come_fullest_first_and_whole():
    draw = random.Random(8)
    for _ in range(150):
        sizes = sorted((draw.randint(1, 30) for _ in range(draw.randint(0, 10))), reverse=True)
        found = list(packing.fillings(sizes, 50, [1 << 60]))
        fill = [sum(sizes[j] for j in f) for f in found]
        assert fill == sorted(fill, reverse=True) and len(set(found)) == len(found)
        every = {tuple(sizes[j] for j in c) for n in range(len(sizes) + 1) for c in itertools.combinations(range(len(sizes)), n) if sum(sizes[j] for j in c) <= 50}
        assert fill[0] == max(map(sum, every))
        # Every fullest filling is there; one that is missing can be improved by one piece.
        got = {tuple(sizes[j] for j in f) for f in found}
        for f in every - got:
            unused = Counter(sizes) - Counter(f)
            assert any(u > t and sum(f) + u - t <= 50 for u in unused for t in (0, *f))


def test_blocks_of_many_sequences_reach_the_bound():
    draw, missed = random.Random(9), 0
    for _ in range(4):
        sizes = [min(4096, int(draw.lognormvariate(6.7, 0.8)) + 1) for _ in range(2000)]
        bins = packing.complete(sizes, 4096)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 4096 for b in bins)
        assert len(bins) == packing.least_bins(sizes, 4096)
        missed += len(packing.best_fit(sizes, 4096)) > len(bins)
        loose = [b for b in packing.tightened(bins, sizes, 4096) if sum(sizes[i] for i in b) < 4096]
        assert len(loose) <= 8
    assert missed


def test_pieces_that_never_share_a_sequence_stay_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 500)
    parts = spark.range(6000).selectExpr("cast(if(id % 3 = 0, null, 7) as long) as doc_id", "0L as piece", "0L as start", "2100L as length", "1L as ids_crc32")
    rounds = []
    monkeypatch.setattr(packing, "_packer", lambda length, make=packing._packer: rounds.append(length) or make(length))
    out = packing.pack(parts)
    assert out.select("sequence_id").distinct().count() == out.count() == 6000
    assert len(rounds) == 2  # the second one gains nothing
    # Equal rows and rows without an id are spread: a block number is the upper part of a sequence's.
    sizes = [r["count"] for r in out.groupBy(F.shiftright("sequence_id", 24)).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 700


def test_packing_rounds_lose_no_sequence(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 200)
    draw = random.Random(5)
    sizes = [draw.choice([4096, draw.randint(1, 2500), draw.randint(1, 300)]) for _ in range(3000)]
    parts = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], "doc_id long, piece long, start long, length long, ids_crc32 long")
    rows = packing.pack(parts).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    check_places(rows)
    assert len({r["sequence_id"] for r in rows}) == -(-sum(sizes) // 4096)


def test_token_counts(docs, none):
    c = tokencount.Counter(tokenizer_path(PIECE_BPE))
    assert c.stable
    texts = prose(2000, 2) + ["a ", " a", "  ", " ", "a  ", "\n", "a\n b "]
    assert c.counts(texts) == [len(c.model.encode(t)) for t in texts]
    out = tokencount.count_tokens(docs, tokenizer_path(PIECE_BPE)).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        assert r["n_tokens"] == len(c.model.encode(r["text"] or "")) and r["n_bytes"] == len((r["text"] or "").encode())
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert tokencount.count_tokens(none, tokenizer_path(PIECE_BPE)).count() == 0


def test_huge_documents_are_spliced(monkeypatch):
    c = tokencount.Counter(tokenizer_path(PIECE_BPE))
    long = prose(40, 3, BITS[:11])
    texts = [" ".join(long[i : i + 12]) for i in range(28)] + ["漢" * 500, "ab" * 400, " " * 300, "a " + "b" * 300 + " c"]
    for chunk, overlap in ((40, 8), (64, 30), (200, 20)):
        monkeypatch.setattr(tokencount, "CHUNK", chunk)
        monkeypatch.setattr(tokencount, "OVERLAP", overlap)
        assert [c.huge(t) for t in texts] == [len(c.model.encode(t)) for t in texts]


# 10


def plain_sets(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = {i: plain_sets(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies(seed, n=30):
    draw, rows = random.Random(seed), []
    for g in range(n):
        words = [f"w{draw.randint(0, 400)}" for _ in range(draw.choice([3, 5, 6, 40, 120, 300]))]
        for _ in range(draw.randint(1, 9)):
            w = list(words)
            for _ in range(draw.randint(0, max(1, len(w) // 40))):
                w[draw.randrange(len(w))] = draw.choice(["x", "Y", "z"])
            rows.append(" ".join(w) if draw.random() < 0.7 else "\n".join(w).upper())
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("group", [1024, 6])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(neardup, "GROUP", group)
    monkeypatch.setattr(neardup, "SAMPLE", 1)
    rows = [*copies(11), (5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE")]
    rows.append(rows[0])
    df = spark.createDataFrame([*rows, (None, "one")], "doc_id long, text string").repartition(4)
    want = plain_components(rows)
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_odd_cases(docs, none):
    assert neardup.near_duplicates(none).count() == 0
    left = neardup.deduplicated(docs)
    want = {i for i, (_, c) in plain_components([(r[0], r[1]) for r in odd_rows()]).items() if i == c}
    got = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1 and left.columns == docs.columns


def test_estimate_is_close():
    draw = random.Random(8)
    for same in (0.3, 0.6, 0.8, 0.95):
        errors = []
        for _ in range(20):
            x = np.array([draw.getrandbits(64) for _ in range(2000)], np.uint64)
            k = int(1000 * 2 * same / (1 + same))
            a, b = x[:1000], np.r_[x[1000 - k : 1000], x[1000 : 2000 - k]]
            s = [np.frombuffer(neardup.packed(neardup.minima(v)), "<u8") for v in (a, b)]
            errors.append(neardup.estimate(s[0], s[1][None])[0] - k / (2000 - k))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07
