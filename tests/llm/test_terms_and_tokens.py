import random
import re
from collections import Counter, defaultdict
from math import floor, log

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from cases import empty, tricky, tricky_rows
from pyspark.sql import functions as F

from siltstone.llm import bpe, divergence, lexical_search
from siltstone.llm.support import materialise

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
UPPER = re.compile("[A-Z]+")


def lower(text):
    return UPPER.sub(lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(PATH, PATTERN, {})


def test_bpe_equals_the_library_on_random_texts(codec, reference):
    rng = random.Random(3)
    parts = ["a", "th", "ing", " ", "  ", "\n", "\t", "\x85", "\x1c", "\x00", "\u3000", "'s", "'ll", "'", "é", "ñ", "1", "²", "Ⅷ", "١", "你", "好", "!", "\ufdd0", "\U0001f600", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    ids = codec.encode(pa.array(texts))
    assert ids.to_pylist() == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode(ids).to_pylist() == [t.encode() for t in texts]


def test_bpe_of_long_pieces(codec, reference):
    """Runs of one character, of two in turn, of random letters, and of letters without blanks between them."""
    rng = random.Random(4)
    texts = ["a" * 20_001, "ab" * 3000, " " * 5001 + "x", "=" * 999, "你好世界" * 300, "".join(rng.choice("abcdefgh") for _ in range(4000)), "".join(map(chr, range(0x4E00, 0x5000)))]
    assert codec.encode(pa.array(texts)).to_pylist() == [reference.encode_ordinary(t) for t in texts]


def test_bpe_classes_are_the_librarys():
    """The first characters of a class by tiktoken, beside what every release of Unicode says."""
    for pattern, inside, outside in ((r"\p{L}", "aZé你", "1 !\n"), (r"\p{N}", "1²Ⅷ", "a !"), (r"\s", " \t\n\x85\u3000", "a\x1c")):
        of = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), bpe.class_of(pattern)) + "]")
        assert all(of.match(c) for c in inside) and not any(of.match(c) for c in outside)


def test_bpe_with_ranks_that_are_not_in_order(tmp_path):
    """A token of lower rank than its halves: only the leftmost pair may be contracted at a time."""
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 256, b"ca": 310, b"cab": 257, b"aab": 258, b"bc": 320, b"abab": 259}
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    own = bpe.Codec.of(str(path), PATTERN, {})
    assert not own.by_rank
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcx") for _ in range(n)) for n in [3, 5, 8, 13, 150, 400] * 20]
    assert own.encode(pa.array(texts)).to_pylist() == [tiktoken.Encoding("small", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(t) for t in texts]


def test_bpe_forgets_and_stays_right(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    monkeypatch.setattr(bpe, "AT_ONCE", 2)
    for k in range(4):
        texts = [f"word{k}abc another{k}xyz and so on {k}"] * 2 + ["and so forth"]
        assert codec.encode(pa.array(texts)).to_pylist() == [reference.encode_ordinary(t) for t in texts]


def test_bpe_of_texts_longer_than_a_slice(codec, reference, monkeypatch):
    """A long text is cut where a piece begins, or not at all if there is no such place."""
    monkeypatch.setattr(bpe, "SLICE", 50)
    rng = random.Random(6)
    parts = ["ab", "the", " ", "  ", "\n", "\n\n", "\x1c", "'s", "1", "é", "!", "\u3000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(60)] + ["x" * 120, "a b" + "x" * 80 + " c", " " * 60 + "z"]
    assert max(len(bpe.cut_text(t)) for t in texts) > 4 and all("".join(bpe.cut_text(t)) == t for t in texts)
    ids = codec.encode(pa.array(texts))
    assert ids.to_pylist() == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode(ids).to_pylist() == [t.encode() for t in texts]


def test_bpe_of_rows(spark, reference):
    rows = tricky_rows()
    got = bpe.round_trip(tricky(spark), PATH, PATTERN).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["content"]), r["key"]) for r in got) == Counter((r[0], tuple(reference.encode_ordinary(r[1] or "")), (r[1] or "").encode(), r[9]) for r in rows)
    coded = bpe.encode(tricky(spark).withColumn("ids", F.lit("clash")), PATH, PATTERN)
    assert dict(coded.dtypes)["ids"] == "array<int>" and set(tricky(spark).columns) < set(coded.columns)
    assert Counter(bytes(r["content"]) for r in bpe.decode(coded, PATH, PATTERN).collect()) == Counter((r[1] or "").encode() for r in rows)
    assert bpe.round_trip(empty(spark), PATH, PATTERN).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert [bytes(r["content"]) for r in bpe.decode(nothing, PATH, PATTERN).collect()] == [b"", b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([999_999],)], "ids array<int>"), PATH, PATTERN).collect()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """(item, rank, doc_id, score) by plain code; docs and items: pairs of id and text."""
    found = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, n_terms = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(TERM.findall(lower(text or "")))
    out = []
    for item, terms in wanted.items():
        scored = []
        for d, c in found:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            scored += [(-score, d is None, d, score)] * (score > 0)
        out += [(item, rank, d, score) for rank, (_, _, d, score) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return Counter(out)


def found(spark, docs, items, **options):
    index = materialise(lexical_search.forward_index(docs, "doc_id"), "test-index")
    return Counter(tuple(r) for r in lexical_search.search(index, lexical_search.forward_index(items, "item_id"), **options).collect())


def test_search_of_tricky_rows(spark):
    texts = [(r[0], r[1]) for r in tricky_rows()]
    items = [(1, "One two w5x"), (2, texts[5][1]), (2, "same LINE of text"), (3, None), (4, "absent123"), (5, "日本語 é emoji"), (None, "same line"), (6, "a" * 50_000)]
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert found(spark, tricky(spark), queries) == ranked(texts, items)
    assert not found(spark, empty(spark), queries)
    assert not found(spark, tricky(spark), queries.limit(0))


@pytest.mark.parametrize("segment, first", [(40, 1), (700, 2), (10**6, 8)])
def test_search_stops_in_time_and_keeps_ties(spark, monkeypatch, segment, first):
    """Few terms and many equal documents: what is read last may tie with the k-th; small segments and rounds."""
    monkeypatch.setattr(lexical_search, "SEGMENT", segment)
    monkeypatch.setattr(lexical_search, "FIRST", first)
    monkeypatch.setattr(lexical_search, "BLOCK", 200)
    rng = random.Random(6)
    docs = [(d, " ".join(f"t{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.choice([3, 3, 8])))) for d in range(600)]
    rng.shuffle(docs)
    items = [(q, " ".join(f"t{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 6])))) for q in range(25)]
    got = found(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert got == ranked(docs, items)


def test_search_reads_no_more_than_it_has_to():
    """One term is rare and decides: lists of a hundred thousand common postings are left early."""
    import numpy as np

    n = 100_000
    doc = np.concatenate([np.arange(n), np.arange(20)])
    term = np.concatenate([np.zeros(n, dtype=np.int64), np.ones(20, dtype=np.int64)])
    impact = np.concatenate([np.full(n, 10), np.full(20, 1000)])
    impact[n - 1] = 11  # the list of the common term is not all ties
    segment = lexical_search.Segment(doc, term, impact, n, 2)
    looked, scores = [], segment.scores
    segment.scores = lambda docs: (looked.append(len(docs)), scores(docs))[1]
    docs, best = segment.best(np.array([0, 1]), 10, 0)
    assert docs.tolist() == list(range(10)) and best.tolist() == [1010] * 10 and sum(looked) < 200


WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, least, k):
    """The audit by plain code, of (text, lang, source) rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    sources, df, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = WORD.findall(lower(text))
        sources[lang].add(source)
        df[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, of in sources.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in of}
        every = sum(total.values())
        share = lambda c, n: 1 + 1_000_000_000 * (c + 2) // (n + 2 * len(kept))
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in of}
        q = {t: share(sum(counts[lang, s][t] for s in of), every) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in of:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in of if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, rank) for rank, (v, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t.decode(), -v, rank) for rank, (v, t) in enumerate(sorted(terms)[:k], 1)]
    return sorted(out)


def test_divergence_of_tricky_rows(spark):
    rows = [(r[1], r[2], r[3]) for r in tricky_rows()]
    for least, k in ((1, 10), (2, 3), (100, 10)):
        assert sorted(tuple(r) for r in divergence.audit(tricky(spark), least, k).collect()) == audited(rows, least, k)
    assert divergence.audit(empty(spark)).count() == 0


def test_divergence_with_small_tries_and_ranges(spark, monkeypatch):
    """Tries that go on early, ranges that are cut deeper and deeper, chunks of a few terms, one source of a third."""
    for name, value in (("BUFFER", 200), ("RANGE", 15), ("CELLS", 30)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(7)
    stems = ["a", "ab", "abc", "abcdefgh", "abcdefghi", "é", "éé", "你", "你好", "zz"]
    docs = [
        (" ".join(rng.choice(stems) + rng.choice(["", "x", "abc", "ñ"]) * rng.randint(0, 2) + rng.choice("abcdefgh") for _ in range(20)), rng.choice(["en", "de", None]), rng.choice(["s0"] * 3 + ["s1", "s2", "Ü", "~"]))
        for _ in range(400)
    ]
    got = sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(docs, "text string, lang string, source string").repartition(5), 3, 7).collect())
    assert got == audited(docs, 3, 7)


def test_tries_merge_and_walk_in_the_order_of_bytes():
    rng = random.Random(8)
    terms = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))).encode(): rng.randint(1, 9) for _ in range(300)}
    one, two, merger = divergence.Trie(), divergence.Trie(), divergence.Merger()
    for t, n in terms.items():
        for trie, docs, counts in ((one, 1, {"s": n}), (two, 2, {"t": 1, "s": 1})):
            leaf = trie.leaf(t)
            leaf.docs, leaf.counts = docs, counts
    for trie in (one, two):
        for batch in divergence._rows(trie.cut("en", 3), most=20):
            merger.add(batch)
    both = merger.trie(1)
    assert [(t, x.docs, x.counts) for t, x, _ in both.walk()] == [(t, 3, {"s": terms[t] + 1, "t": 1}) for t in sorted(terms)]
    assert all(shared <= divergence._shared(b, t, 0) for b, (t, _, shared) in zip([b"", *sorted(terms)], both.walk()))
    assert len(both.known) == len(terms)


def test_divergence_shares_are_exact():
    import numpy as np

    rng = random.Random(9)
    for _ in range(2000):
        total = rng.choice([3, 10**6, 10**13, 2 * 10**14]) + rng.randrange(1000)
        count = rng.randrange(total - 2)
        assert divergence.shares(np.array([count], dtype=np.int64), total)[0] == 1 + 10**9 * (count + 2) // total


def test_search_terms_split_as_the_pattern_says():
    every = "".join(map(chr, range(0x250))) + "x日Y"
    assert [t.decode() for t in lexical_search.terms_of(every)] == TERM.findall(lower(every))
    assert [t.decode() for t in every.encode().translate(divergence.TERM_TABLE).split()] == WORD.findall(lower(every))
