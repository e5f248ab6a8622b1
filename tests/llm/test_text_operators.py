"""Token counts, encoding, mixing, removal, near duplicates and the classifier against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bandloom.llm import bpe, mixing, neardup, passages, quality, suffixes, token_count, windows
from bandloom.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def odd_texts():
    rng = random.Random(3)
    alpha = "abcAB 'stmdrevl  \n\t\x1c\x85　é中文123٣²Ⅷ!?<|>🙂ǅʰ"
    texts = [None, "", " ", "a" * 3000, "ab" * 2000, " " * 500 + "x", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "x'll 're's'S", "\r\n\r\n a"]
    texts += ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(1, 300)])) for _ in range(40)) for _ in range(200)]
    return texts + texts[:3]


def test_token_counts_as_the_library(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    texts = odd_texts()
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "one two", 0)]
    got = token_count.token_counts(table(spark, rows, "doc_id long, text string, n_tokens int"), vocabulary("byte_bpe_50k.json"), limit=20).collect()
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((r[0] or -1, len((r[1] or "").encode()), n, n > 20) for r, n in zip(rows, want, strict=True))
    assert token_count.token_counts(table(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def test_encoding_as_the_library_and_back(spark):
    import public_tokenizers as public
    import tiktoken

    spec = vocabulary("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.rank_table(spec), special_tokens={})
    texts = odd_texts()
    encoded = bpe.encode(table(spark, list(enumerate(texts))), spec)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == library.encode_ordinary(t or "")
        ends = np.cumsum([len(library.decode_single_token_bytes(x)) for x in rows[i]["ids"]]).tolist()
        assert rows[i]["ends"] == ends
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(encoded, spec).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    df = table(spark, [(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    digest = {r["doc_id"]: r for r in bpe.round_trip(df, spec, digests=True).collect()}
    packed = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert {i: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for i, r in digest.items()} == {i: (len(rows[i]["ids"]), packed(rows[i]["ids"]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)}
    both = {r["doc_id"]: (r["n_tokens"], r["ids"], r["text"]) for r in bpe.round_trip(df, spec).collect()}
    assert both == {i: (len(rows[i]["ids"]), rows[i]["ids"], t or "") for i, t in enumerate(texts)}
    with pytest.raises(Exception, match="lack"):
        bpe.decode(spark.createDataFrame([(1, [10**7])], "doc_id long, ids array<int>"), spec).collect()
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe.decode(nothing, spec).first()["bytes"]) == b""
    assert bpe.encode(table(spark, []), spec).count() == 0


def test_very_long_words(spark):
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = ["a" * 1_000_000, "".join(rng.choice("abcdefgh") for _ in range(300_000)), "é" * 20_000, "".join(rng.choice("etaoin") for _ in range(5000)) + " end", "x" * 4096, "x" * 4097]
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = token_count.token_counts(table(spark, list(enumerate(texts))), vocabulary("byte_bpe_50k.json")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    spec = vocabulary("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.rank_table(spec), special_tokens={})
    back = {r["doc_id"]: r for r in bpe.round_trip(table(spark, list(enumerate(texts[1:]))), spec).collect()}
    assert all(back[i]["text"] == t and back[i]["ids"] == own.encode_ordinary(t) for i, t in enumerate(texts[1:]))


def test_merging_needs_leftmost_first():
    # "ab" once left of "abb" etc.: one merge at a time, as a plain loop does it
    rng = random.Random(0)
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
    for token in (b"ab", b"bc", b"abc", b"aa", b"aab", b"ca", b"bca"):
        ranks[token] = len(ranks)
    enc = bpe.Encoder(ranks)

    def plain(t):
        parts = [t[i : i + 1] for i in range(len(t))]
        while True:
            pairs = [(ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            if not pairs or min(pairs)[0] == 10**9:
                return [ranks[p] for p in parts]
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in (*range(1, 40), 60, 200):
        t = bytes(rng.choice(b"abc") for _ in range(n))
        assert enc.merge(t) == (plain(t) if t not in ranks else [ranks[t]])


# mixing


def water(sizes, cycle=(1, 2, 3), cap=3):
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(sizes)}
    free, left, target = dict(weight), sum(sizes.values()), {}
    while free:
        share = left / sum(free.values())
        full = [s for s in free if cap * sizes[s] <= share * weight[s]]
        if not full:
            return target | {s: share * w for s, w in free.items()}
        for s in full:
            target[s] = float(cap * sizes[s])
            left -= cap * sizes[s]
            del free[s]
    return target


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 5, 30, 300]))) or None, rng.choice(["a", "a", "a", "a", "a", "Ä", "b", "c", "dd", "é", None])) for i in range(400)]
    rows += [(1000, "", "zero"), (1000, "", "zero"), (None, "one two", "b")]
    df = table(spark, rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(df).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, t, s in sorted(rows, key=lambda r: (r[2] is None, (r[2] or "").encode())):
        sizes[s] += size(t)
    want = water(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((i, s, size(t)) for i, t, s in rows)
    taken = defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["part"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    key = lambda r: (r["doc_id"] or -1, r["source"] or "", r["size"], r["taken"])
    assert sorted(map(key, mixing.mix(df.repartition(3)).collect())) == sorted(map(key, out))
    mixed = mixing.mix(df, carry=["text"])
    words = mixing.expand(mixed).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert all(r["n"] == taken[r["source"]] for r in words)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_runs_no_python(spark):
    df = table(spark, [(1, "a b", "x"), (2, "c", "y")], "doc_id long, text string, source string")
    assert not re.search("Python|Pandas|Arrow", mixing.mix(df)._jdf.queryExecution().executedPlan().toString())


# removal


def fuzz_docs(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "ab", "é", "x"]
    shared = [" ".join(rng.choice(vocab) for _ in range(rng.randint(15, 300))) for _ in range(5)]
    out = [(None, None), (5, ""), (5, " \n ")]
    for _ in range(80):
        t = ""
        for _ in range(rng.randint(0, 5)):
            t += rng.choice([*shared, " \n ", "q w e", "z" * rng.randint(1, 900), " ".join(rng.choice(vocab) for _ in range(30))]) + rng.choice(["", " ", "\n"])
        out.append((rng.randint(0, 40), t))
    return out + out[3:6]


def brute_words(docs, n=20):
    first, words = {}, [WORD.findall(t or "") for _, t in docs]
    key = lambda i, k: (i is not None, i or 0, k)
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - n + 1):
            first[tuple(w[k : k + n])] = min(first.get(tuple(w[k : k + n]), key(i, k)), key(i, k))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < key(i, k):
                gone[k : k + n] = True
        out.append((i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


def brute_bytes(docs, n=400):
    texts = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[k : k + n] for _, b in texts for k in range(len(b) - n + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return Counter(out)


@pytest.mark.parametrize(("seed", "hot"), [(0, 8.0), (1, 0.5), (2, -1.0)])
def test_passages(spark, seed, hot):
    docs = fuzz_docs(seed)
    df = table(spark, docs).withColumn("spans", F.lit(1)).repartition(3)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in passages.remove_repeats(df, hot=hot).collect())
    assert got == brute_words(docs)


@pytest.mark.parametrize(("seed", "hot"), [(0, 8.0), (1, 0.5), (2, -1.0)])
def test_suffixes(spark, seed, hot):
    docs = fuzz_docs(seed)
    df = table(spark, docs).withColumn("bytes", F.lit(1)).repartition(3)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["bytes"])) for r in suffixes.remove_repeats(df, hot=hot).collect())
    assert got == brute_bytes(docs)
    as_text = suffixes.remove_repeats(df, length=200, as_text=True, carry=["fp"]) if "fp" in df.columns else suffixes.remove_repeats(df.withColumn("fp", F.lit("own")), length=200, as_text=True, carry=["fp"])
    want = brute_bytes(docs, 200)
    got = Counter((r["doc_id"], r["text"]) for r in as_text.collect())
    assert got == Counter({k: 0 for k in ()}) + Counter([(i, b.decode(errors="ignore")) for (i, *_, b), n in want.items() for _ in range(n)])
    assert {r["fp"] for r in as_text.collect()} == {"own"}


def thue_morse(doublings):
    """A word over a and b, and its complement: they share every polynomial hash modulo a power of two, if long enough."""
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("hot", [8.0, -1.0])
def test_long_words_are_told_apart(spark, hot):
    one, two = thue_morse(12)
    body = [f"w{i}" for i in range(19)]
    docs = [(1, " ".join([*body, one])), (2, " ".join([*body, two])), (3, " ".join([*body, one, *body, two])), (4, one * 3), (5, two * 3), (6, one[:500]), (7, two[:500])]
    df = table(spark, docs)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in passages.remove_repeats(df, hot=hot).collect())
    assert got == brute_words(docs)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["bytes"])) for r in suffixes.remove_repeats(df, hot=hot).collect())
    assert got == brute_bytes(docs)
    near = neardup.near_duplicates(table(spark, docs[:5]), scheme=neardup.Scheme(words=4))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near.collect()) == brute_classes(docs[:5], 4)


def test_texts_without_ids_are_told_apart(spark):
    # texts of one 32-bit hash: found among many by the hash itself
    many = spark.range(600_000).select(F.concat_ws(" ", F.lit("x" * 470), F.col("id").cast("string"), F.lit(" y" * 30)).alias("text"))
    twins = many.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()["t"][:2]
    rng = random.Random(4)
    own = [" ".join(f"{rng.random()}" for _ in range(60)) for _ in range(3)]
    docs = [(None, twins[0][470:] * 12), (None, own[0]), (None, own[1]), (None, own[1]), (7, own[2]), (7, own[2] + " end"), (None, twins[0]), (None, twins[1])]
    df = table(spark, docs).repartition(2)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["bytes"])) for r in suffixes.remove_repeats(df).collect())
    assert got == brute_bytes(docs)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in passages.remove_repeats(df).collect())
    assert got == brute_words(docs)


def test_prints_are_polynomials_modulo_a_prime():
    from bandloom.llm.common import PRIME, Prints, mul_mod, word_keys, word_spans

    rng = np.random.default_rng(0)
    a, b = rng.integers(0, PRIME, (2, 500), dtype=np.uint64)
    assert [int(x) * int(y) % PRIME for x, y in zip(a, b, strict=True)] == mul_mod(a, b).tolist()
    p, units = Prints(5), rng.integers(0, 256, 900).astype(np.uint64)
    start = rng.integers(0, 600, 50)
    end = start + rng.integers(0, 300, 50)
    want = [(sum(x * pow(p.outer, k, PRIME) for k, x in enumerate(units[s:e].tolist())) * p.outer + int(e - s) + 1) % PRIME for s, e in zip(start, end, strict=True)]
    assert p.spans(p.runs(units), start, end).tolist() == want
    raw = b" ".join(rng.choice([b"a", b"a\0", b"ab", b"abcdefg", b"abcdefgh", b"z" * 57, b"z" * 58, b"z" * 500], 300))
    data = np.frombuffer(raw, np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(raw)]))
    for numbers in (p.words(data, s, e).tolist(), word_keys(data, s, e).tolist()):
        assert len(set(zip(raw.split(b" "), numbers, strict=True))) == len(set(raw.split(b" "))) == len(set(numbers))


def test_removal_of_nothing(spark):
    assert passages.remove_repeats(table(spark, [])).count() == 0 and suffixes.remove_repeats(table(spark, [])).count() == 0


def test_cover_and_equal_suffixes():
    assert suffixes.shifts().min() >= 0
    rng = np.random.default_rng(0)
    for letters in (1, 2, 3):
        text = rng.integers(97, 97 + letters, 900).astype(np.uint8)
        text[500:800] = text[100:400]
        at = np.arange(0, len(text) - 150)
        kind = suffixes.equal_suffixes(text, at, 150)
        raw = text.tobytes()
        count = Counter(raw[i : i + 150] for i in at)
        assert [k >= 0 for k in kind] == [count[raw[i : i + 150]] > 1 for i in at]
        groups = defaultdict(set)
        for i in at[kind >= 0]:
            groups[kind[i]].add(raw[i : i + 150])
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_segments_hold_every_window_once():
    rule = windows.Rule(20, 2, words=True, first_stays=True)
    text = " ".join(random.Random(1).choice(["u", "v", "w"]) for _ in range(500)).encode()
    row, place, n, key, raw, lo, hi, _ = rule.segments(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert np.array_equal(np.cumsum(n) - n, place) and n.sum() == 481
    words = text.split()
    assert all(raw[a:b].split() == words[p : p + k + 19] for a, b, p, k in zip(lo, hi, place, n, strict=True))


# near duplicates


def brute_classes(docs, words, percent=80):
    def sets(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(t)
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    own = [(i, sets(t)) for i, t in docs]
    root = {i: i for i, _ in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in own:
        for b, t in own:
            if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return Counter((i, len(s), find(i) if s else i, i == (find(i) if s else i)) for i, s in own)


@pytest.mark.parametrize(("words", "hot", "block"), [(4, 5000, 512), (5, 5000, 3), (4, 1, 7)])
def test_near_duplicates(spark, words, hot, block):
    rng = random.Random(words)
    vocab = [f"w{i}" for i in range(200)]
    docs, base = [], [[rng.choice(vocab) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    for i in range(160):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            own[rng.randrange(len(own))] = rng.choice(vocab).upper()
        docs.append((i + 1, " ".join(own)))
    docs += [(500, None), (501, ""), (502, " \t "), (503, "one"), (504, "ONE"), (505, "two words"), (506, " two  words ")]
    df = table(spark, docs).withColumn("kept", F.lit(0)).withColumn("label", F.lit("x")).repartition(3)
    out = neardup.near_duplicates(df, scheme=neardup.Scheme(words=words), hot_from=hot, block=block)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()) == brute_classes(docs, words)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "x"), (4, "y z")]
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert out == sorted([(None, None, True), (3, None, False), (3, None, False), (4, 4, True), (4, 4, True)], key=str)
    assert neardup.near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 3)]
    got = {r["id"]: r["label"] for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400, i) for i in range(310, 330)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["id"]: r["label"] for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def test_near_copies_in_blocks(spark):
    # copies of one text, each changed elsewhere: many are linked only through others
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(120):
        own = list(base)
        for k in range(rng.choice([1, 2, 3, 4, 5])):
            own[rng.randrange(100)] = f"x{i}y{k}"
        docs.append((1000 - i, " ".join(own)))
    want = brute_classes(docs, 5)
    assert len({r[2] for r in want}) > 3
    for block in (16, 512):
        out = neardup.near_duplicates(table(spark, docs).repartition(3), block=block).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == want


def test_scheme_misses_little():
    s = neardup.Scheme()
    half = 1 - 0.8**s.depth
    assert 1 - (1 - half**s.side) ** 2 < 5e-4 and s.least_equal() >= 0.5 * s.minima


# the classifier


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice([0, 0, 0, 0, 1, 2])
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 2:
            words[rng.randrange(len(words))] = rng.choice(["vile", "rotten"]) + rng.choice(["", ",", "."])
        text = " ".join(words)
        docs.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2"]), len(text)))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return docs, labels


def test_classifier_held_out(spark):
    docs, labels = corpus(900, 1)
    extra = [(5000, None, None, None, None), (5001, "", "en", "s1", 0)]
    df = table(spark, docs + extra, DOCS).withColumn("score", F.lit("clash"))
    seen = table(spark, labels[:600] + [(None, 1, 0), (3, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, seen)
    got = {r["doc_id"]: r["keep"] for r in quality.score(df, model).collect()}
    assert len(got) == 902
    held = labels[600:]
    bad = [i for i, q, t in held if q == 0 or t == 1]
    good = [i for i, q, t in held if q == 1 and t == 0]
    assert sum(not got[i] for i in bad) >= 0.95 * len(bad) and sum(got[i] for i in good) >= 0.98 * len(good)
    whole = quality.score(df, model, whole=True)
    assert whole.columns[:6] == [*[c.split()[0] for c in DOCS.split(", ")], "score"] and whole.count() == 902
    again = {r["doc_id"]: r["keep"] for r in quality.score(df.repartition(5), quality.train(df.repartition(5), seen)).collect()}
    assert again == got


def test_classifier_learns_from_every_unlabelled_document(spark):
    rng = random.Random(6)
    body = lambda: " ".join(f"word{rng.randrange(300)}" for _ in range(40))
    # labels tell that a source is bad; a word that no labelled document has stands in that source only, 8 times in 8000
    rows = [(i, body(), "en", "bad" if i % 8 == 0 else "fine", 200) for i in range(800)]
    labels = [(i, int(i % 8 != 0), 0) for i in range(800)]
    rows += [(i, body(), "en", "fine", 200) for i in range(800, 8792)] + [(i, body() + " zzrare", "en", "bad", 200) for i in range(8792, 8800)]
    model = quality.train(table(spark, rows, DOCS).repartition(4), table(spark, labels, "doc_id long, quality int, toxic int"))
    _, member, _ = quality.text_features(np.frombuffer(b"zzrare", np.uint8), np.array([0, 6]))
    assert model.heads[0][0].sparse[member].item() > 0


def test_views_teach_each_other(spark):
    docs, labels = corpus(1500, 8)
    rng = random.Random(3)
    # sources tell of bad pages, but not surely
    docs = [(i, t, lang, "s1" if (q == 0) != (rng.random() < 0.2) else "s2", n) for (i, t, lang, _, n), (_, q, _) in zip(docs, labels, strict=True)]
    model = quality.train(table(spark, docs, DOCS).repartition(3), table(spark, labels[:400], "doc_id long, quality int, toxic int"))
    assert len(model.taught) == 3 and model.taught[0] == []
    for turn in model.taught[1:]:
        assert sorted((h, v) for h, v, *_ in turn) == [(0, 0), (0, 1), (1, 0), (1, 1)] and all(a > 0 and b > 0 for *_, a, b in turn)
    # against a plain run of the same rules: which documents a view gives, by rank
    rows = [docs[i] for i in range(400, 1500)]
    part = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)]
    views = quality._features(part, 0, len(rows))
    known = quality._features([pa.array(c, k) for c, k in zip(zip(*docs[:400], strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], 0, 400)
    y = [np.array([int(q == 0) for _, q, _ in labels[:400]]), np.array([t for *_, t in labels[:400]])]
    held = np.arange(0, 400, 4)
    models = [[quality.Linear.fit(*known[v], own, quality.SIZES[v]) for v in (0, 1)] for own in y]
    teachers = quality.Teachers.of(models, known, y, held)
    pool = spark.createDataFrame([tuple(bytes(c) for c in r) for r in _packed(views, len(rows))], "x binary, w binary, m binary, k binary").repartition(3)
    teachers.ranked(pool, 0.15)
    for h, v, step in teachers.steps_of(views):
        p = y[h].mean()
        order = np.sort(step)
        many, few = int(np.ceil(0.15 * p * len(step))), int(np.ceil(0.15 * (1 - p) * len(step)))
        assert teachers.edges[h][v] == (min(order[few - 1], quality.STEPS // 2 - 1), max(order[::-1][many - 1], quality.STEPS // 2 + 1))
    got = quality.counted(pool, teachers)
    for h, v, chosen, own in teachers.sure(views):
        assert got[h, v][0].tolist() == np.bincount(own, minlength=2).tolist()
        _, member, first = quality._take(views[v], chosen)
        want = np.zeros((2, quality.SIZES[v]), np.int64)
        np.add.at(want, (np.repeat(own, np.diff(first)), member), 1)
        assert np.array_equal(got[h, v][1], want)


def _packed(views, n):
    (x, w, wf), (m, k, kf) = views
    for i in range(n):
        yield x[i].tobytes(), w[wf[i] : wf[i + 1]].astype(np.int32).tobytes(), m[i].tobytes(), k[kf[i] : kf[i + 1]].astype(np.int32).tobytes()


def test_classifier_takes_both_labels_of_a_document(spark):
    rng = random.Random(7)
    body = lambda: " ".join(f"word{rng.randrange(300)}" for _ in range(40))
    rows = [(i, body().upper() if i % 4 == 0 else body(), "en", "s1", 200) for i in range(400)]
    labels = [(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(300)]  # what is of low quality is toxic, too
    df = table(spark, rows, DOCS)
    got = quality.score(df, quality.train(df, table(spark, labels, "doc_id long, quality int, toxic int"))).collect()
    assert all((r["low_quality"] > 0.5) == (r["toxic"] > 0.5) == (r["doc_id"] % 4 == 0) for r in got)


def test_classifier_without_labels(spark):
    docs, _ = corpus(30, 2)
    df = table(spark, docs, DOCS)
    none = table(spark, [], "doc_id long, quality int, toxic int")
    assert quality.score(df, quality.train(df, none)).where("keep").count() == 30
    assert quality.score(df.limit(0), quality.train(df.limit(0), none)).count() == 0


def test_utf8_of_slices_and_nulls():
    from bandloom.llm.common import steps, utf8

    col = pa.array(["é", None, "", "abc"]).slice(1)
    data, off = utf8(col)
    assert data.tobytes() == b"abc" and off.tolist() == [0, 0, 0, 3]
    assert list(steps(np.array([0, 5, 5, 30, 31]), 6)) == [(0, 2), (2, 3), (3, 4)]
