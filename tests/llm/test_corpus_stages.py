import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
from cases import empty, frame, tricky, tricky_rows, words

import corpus_pipeline
from siltstone.llm import importance, near_dedup, registry, substring_dedup, warc
from siltstone.llm.components import components
from siltstone.llm.support import scratch_path

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    """Over (id, text) rows; null ids are left out."""
    ids, sets = [i for i, _ in rows], [shingle_set(t) for _, t in rows]
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = top(ids[a]), top(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = words(rng, rng.randrange(3, 120))
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [None, "", "a b", "A  b", "a b c d e f"]
    rng.shuffle(texts)
    got = near_dedup.near_components(frame(spark, texts), block=3).collect()
    want = brute_components(list(enumerate(texts)))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingle_set(t)) for i, t in enumerate(texts)}


def test_near_dedup_edges(spark):
    got = near_dedup.near_components(tricky(spark)).collect()
    assert len(got) == len(tricky_rows())
    want = brute_components([r[:2] for r in tricky_rows() if r[0] is not None])
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert near_dedup.near_components(empty(spark)).count() == 0


def test_near_dedup_of_long_texts_in_small_blocks(spark):
    """Blocks are bounded by shingles too, and links across them are all found: near copies of near copies in a chain."""
    rng = random.Random(21)
    texts = []
    for _ in range(4):
        text = words(rng, 400, 10**6)
        for _ in range(8):
            texts.append(" ".join(text))
            for _ in range(9):
                text[rng.randrange(400)] = f"n{rng.randrange(10**7)}"
    want = brute_components(list(enumerate(texts)))
    for block_shingles in (500, 5000):
        got = near_dedup.near_components(frame(spark, texts), block=4, block_shingles=block_shingles).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_dedup_stage_judges_rows(spark):
    base = " ".join(words(random.Random(2), 60))
    rows = [(5, base), (5, base), (3, base + " more"), (5, "a text of its own under an id that is taken"), (None, base), (None, "no id here but text"), (None, None), (7, None), (7, "")]
    kept = near_dedup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([rows[2], *rows[3:4], *rows[5:]])


def test_chance_to_miss_a_pair_near_the_threshold():
    """Thousands of pairs of sets at 0.75 to 0.76: all share a band and agree enough to be verified."""
    rng = np.random.default_rng(17)
    pairs = missed = 0
    for n in (40, 150, 400):
        for _ in range(1000):
            other = n // 7  # 6/7 in common: 0.75
            x = rng.integers(0, 2**63, n + other).astype(np.uint64)
            a, b = near_dedup.sketch(np.sort(x[:n])), near_dedup.sketch(np.sort(x[other:]))
            same = (a == b).reshape(-1, near_dedup.ROWS)
            pairs += 1
            missed += not same.all(axis=1).any() or same.sum() < near_dedup.LEAST_AGREEING
    assert pairs == 3000 and missed <= 1


def test_sketches_fill_every_coordinate_and_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40, 3000):
        off = []
        for _ in range(60):
            x = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = x[:n], x[n // 4 : n // 4 + n]
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            off.append((near_dedup.sketch(a) == near_dedup.sketch(b)).mean() - j)
        assert abs(np.mean(off)) < 0.02


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 201)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_substring_dedup_finds_planted_passages(spark):
    rng = random.Random(3)
    passage = " ".join(words(rng, 55))
    own = [" ".join(words(rng, 200, 10**7)) for _ in range(8)]
    texts = [own[0] + " " + passage + " " + own[1], own[2], passage + "\n" + own[3], own[4] + "\n" + passage, own[5]]
    got = substring_dedup.repeated_spans(frame(spark, texts)).collect()
    assert {r["doc_id"] for r in got} == {2, 3} and {r["first_doc_id"] for r in got} == {0}
    for r in got:
        inside = texts[r["doc_id"]].split()[r["start"] : r["end"]]
        assert " ".join(inside) in passage and len(inside) >= 16
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(frame(spark, texts)).collect()}
    assert [kept[k] == texts[k] for k in range(5)] == [True, True, False, False, True]
    assert own[3] in kept[2] and own[4] in kept[3]


def test_substring_spans_against_brute_force(spark):
    """With any run counting, the spans are the chunks that an earlier document holds."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    first, want = {}, Counter()
    for d, t in rows:
        for digest in substring_dedup.chunks_of(t)[0]:
            first.setdefault(digest, d)
    for d, t in rows:
        for digest, at, n in zip(*substring_dedup.chunks_of(t)):
            if first[digest] < d:
                want[d] += int(n)
    got = Counter()
    for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).collect():
        got[r["doc_id"]] += r["end"] - r["start"]
    assert got == want


def plain_spans(rows, within):
    """(doc, start, end) over (id, text) rows by plain code: byte by byte hashes, window by window minima, chunks as text."""
    mix = (1 << 64) - 1
    gear = []
    for k in range(1, 257):
        x = k * 0x9E3779B97F4A7C15 & mix
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mix
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mix
        gear.append((x ^ (x >> 31)) >> 32)
    chunked = []
    for d, text in rows:
        raw, values, h, at = (text or "").encode(), [], 0, []
        for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", raw):
            at.append(m.span())
        ends = {e for _, e in at}
        for k, byte in enumerate(raw):
            h = ((h << 1) + gear[byte]) & 0xFFFFFFFF
            if k + 1 in ends:
                values.append(h)
        n = len(values)
        cut = {n} if n else set()
        for i in range(n - 12):
            cut.add(min(range(i, i + 13), key=lambda j: (values[j], j)) + 1)
        edges = [0, *sorted(cut)]
        chunked.append((d, [(a, b, raw[at[a][0] : at[b - 1][1]]) for a, b in zip(edges, edges[1:]) if n]))
    first = {}
    for d, chunks in chunked:
        for *_, c in chunks:
            first[c] = min(first.get(c, d), d)
    out = set()
    for d, chunks in chunked:
        seen, spans = set(), []
        for a, b, c in chunks:
            if first[c] < d or (within and c in seen):
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            seen.add(c)
        out |= {(d, a, b) for a, b in spans if b - a >= 16}
    return out


def test_substring_query_against_plain_code(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = substring_dedup.op9_substring_dedup(spark, SF).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == plain_spans(rows, False) and len(got) > 20
    inside = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), within=True).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in inside} == plain_spans(rows, True)


def test_substring_dedup_within_a_text_and_among_rows_of_an_id(spark):
    rng = random.Random(12)
    passage, own = " ".join(words(rng, 200, 10**7)), [" ".join(words(rng, 100, 10**7)) for _ in range(6)]
    rows = [(1, f"{own[0]} {passage} {own[1]} {passage} {own[2]}"), (2, f"{own[3]} {passage}"), (2, f"{passage} {own[4]}"), (2, f"{passage} {own[4]}"), (2, own[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.repeated_spans(docs, within=True).collect()
    assert Counter((r["doc_id"], r["first_doc_id"]) for r in spans) == {(1, 1): 1, (2, 1): 2}
    kept = [r["text"] for r in substring_dedup.dedup(docs).orderBy("doc_id").collect()]
    assert sum(len(t.split()) for t in kept) < 1 * 200 + 100 * 7 + 4 * 30
    assert sum(passage in t for t in kept) == 1 and all(sum(o in t for t in kept) >= 1 for o in own)
    assert [t for t in kept if t == own[5]] == [own[5]]


def test_substring_dedup_edges(spark):
    substring_dedup.repeated_spans(tricky(spark)).collect()
    assert substring_dedup.dedup(tricky(spark)).count() == len(tricky_rows())
    assert substring_dedup.repeated_spans(empty(spark)).count() == 0


def test_chunks_resist_insertions():
    rng = random.Random(9)
    w = words(rng, 2000)
    a = set(substring_dedup.chunks_of(" ".join(w))[0])
    b = set(substring_dedup.chunks_of(" ".join([*w[:700], "inserted", "words", *w[700:]]))[0])
    assert len(a - b) <= 5 and len(b - a) <= 6


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first long")


def test_warc_round_trip(spark):
    body = "<p>" + "é" * 80 + "</p>"
    rows = [(3, "http://a/\r\nx", body), (1, None, body), (2, "http://b", "short"), (4, "http://c", "short"), (5, "u", None), (None, "n", body), (7, "u", ""), (8, "u", "x" * 200_000), (1, "again", body), (3, "again", "other " * 40)]
    rows = [(*r, "clash", 0) for r in rows]
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages_frame(spark, rows), path, archive_bytes=100_000)
    got = Counter(tuple(r) for r in warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = Counter()
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        equal = [p for p, _, h, *_ in rows if p is not None and (h or "") == (html or "")]
        revisit = page is not None and len(raw) >= 100 and min(equal) != page
        want[(page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(equal) if revisit else None)] += 1
    assert got == want
    none = scratch_path(spark, "warc-none")
    warc.write_archives(pages_frame(spark, []), none)
    assert warc.read_archives(spark, none).count() == 0


def test_warc_writes_as_many_archives_as_are_wanted(spark):
    """With and without a broadcast join; record ids are unique, and each revisit's target is a response."""
    rng = random.Random(4)
    rows = [(k, f"http://x/{k}", " ".join(words(rng, 200)), "", 0) for k in range(300)]
    rows += [(1000 + k, "u", rows[k][2], "", 0) for k in range(40)] + [(7, "u", "one page", "", 0)] * 3 + [(None, "u", rows[0][2], "", 0)] * 5
    size = sum(len(r[2]) + warc.HEAD_BYTES for r in rows)
    for threshold in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            path = scratch_path(spark, "warc-archives")
            warc.write_archives(pages_frame(spark, rows), path, archive_bytes=-(-size // 9))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        files = [bytes(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
        assert len(files) == 9
        heads = [f for content in files for f, _ in warc.parse_archive(content)]
        ids = {f["warc-record-id"]: f["warc-type"] for f in heads}
        assert len(heads) == len(ids) == len(rows)
        assert [ids[f["warc-refers-to"]] for f in heads if f["warc-type"] == "revisit"] == ["response"] * 40
        assert max(map(len, files)) < 3 * size / 9


def test_warc_task_holds_no_more_than_it_learns_from(spark):
    """An archive of more than that is written whole, with one dictionary."""
    rng = random.Random(8)
    rows = [(k, f"http://x/{k}", " ".join(words(rng, 300)), "", 0) for k in range(500)]
    path = scratch_path(spark, "warc-long")
    warc.write_archives(pages_frame(spark, rows), path, archive_bytes=1 << 30, train_bytes=50_000)
    content = [bytes(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert len(content) == 1 and len(list(warc.parse_archive(content[0]))) == 500
    assert warc.read_archives(spark, path).where("payload_ok").count() == 500


def test_warc_spreads_rows_alike(spark):
    """A hundred thousand rows alike, most without an id: archives of like size, record ids that differ, revisits that lead to one."""
    rows = [(None, "u", None)] * 60_000 + [(7, "u", "x" * 120)] * 2_000 + [(9, "u", "x" * 120)] * 38_000 + [(k, "u", f"page {k}") for k in range(100, 200)]
    path = scratch_path(spark, "warc-alike")
    size = sum(len(r[2] or "") + warc.HEAD_BYTES for r in rows)
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, archive_bytes=-(-size // 10))
    files = [bytes(r[0]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()]
    heads = [[f for f, _ in warc.parse_archive(content)] for content in files if content]
    sizes = [len(h) for h in heads]
    ids = Counter(f["warc-record-id"] for h in heads for f in h)
    assert len(sizes) == 10 and max(sizes) < 2 * sum(sizes) / 10 and sum(sizes) == len(rows) == len(ids)
    assert {f["warc-refers-to"] for h in heads for f in h if f["warc-type"] == "revisit"} <= set(ids)
    got = Counter(tuple(r) for r in warc.read_archives(spark, path).select("page_id", "record_type", "refers_to").collect())
    assert {k: v for k, v in got.items() if v > 1} == {(None, "response", None): 60_000, (7, "response", None): 2_000, (9, "revisit", 7): 38_000}


def test_warc_files_are_frames_with_a_dictionary(spark):
    rows = [(k, f"http://x/{k}", f"<html>{'common words of every page ' * 9}{k}</html>", "", 0) for k in range(300)]
    path = scratch_path(spark, "warc-frames")
    warc.write_archives(pages_frame(spark, rows), path)
    content = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).first()["content"])
    magic, size = struct.unpack_from("<II", content)
    assert magic == warc.DICTIONARY_MAGIC and 0 < size <= warc.DICTIONARY_BYTES
    assert content.count(warc.EMPTY_FRAME) >= 300 and len(list(warc.parse_archive(content))) == 300


def test_importance_separates_held_out_quality(spark):
    scored = importance.op1_importance_resampling(spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").df()
    both = scored.merge(labels, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.97 and both[both.quality == 0].kept.mean() < 0.1
    assert len(scored) == 1000


def test_quality_stage_rejects_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf).select("doc_id").collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{sf}/labels.parquet'").fetchall()
    share = lambda q, x: np.mean([d in kept for d, quality, toxic in labels if (quality, toxic) == (q, x)])
    assert share(1, 0) > 0.95 and share(1, 1) < 0.3 and share(0, 0) < 0.15 and share(0, 1) < 0.15


def plain_sample(rows, good):
    """Ids that are kept of (id, text) rows, where good says which labelled ids are good: by plain code, n-gram by n-gram."""
    from math import log

    whole = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & whole
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & whole
        return x ^ (x >> 31)

    odd = [mix(k * 0x9E3779B97F4A7C15 & whole) | 1 for k in range(1, 9)]

    def kind(t):
        if t[0] >= 128 or t[:1].isalpha():
            return b"A" if len(t) > 1 and t.isupper() else b"X" if t[:1].isupper() else b"x"
        return b"9" if t[:1].isdigit() else t[:4]

    def grams(text):
        tokens = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+", (text or "").encode())
        w, s = [zlib.crc32(t.lower()) for t in tokens], [zlib.crc32(kind(t)) for t in tokens]
        for i in range(len(w)):
            yield w[i] * odd[2]
            if i:
                pair = 1 if w[i] == w[i - 1] else (w[i] * odd[0] + w[i - 1] * odd[1]) & whole
                yield pair * odd[3] + 1
                yield s[i] * odd[4] + s[i - 1] * odd[5]
            if i > 1:
                yield s[i] * odd[4] + s[i - 1] * odd[6] + s[i - 2] * odd[7]

    counted = [(d, Counter(mix(g & whole) >> 47 for g in grams(t))) for d, t in rows]
    raw, target = Counter(), Counter()
    for d, c in counted:
        raw.update(c)
        target.update(c if good.get(d) else {})
    share = sum(target.values()) / sum(raw.values())
    keys = {}
    for d, c in counted:
        u = ((mix(d ^ 0x51ED270B4D2F1E35) >> 11) + 0.5) / 2.0**53
        keys[d] = sum(n * log((target[b] + 20) / (raw[b] * share + 20)) for b, n in c.items()) - log(-log(u))
    k = round(len(rows) * sum(good.values()) / len(good))
    return set(sorted(keys, key=keys.get)[len(keys) - k :])


def test_importance_query_against_plain_code(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    good = {d: q == 1 for d, q in duckdb.sql(f"SELECT doc_id, min(quality) FROM '{SF}/labels.parquet' GROUP BY doc_id").fetchall()}
    got = importance.op1_importance_resampling(spark, SF).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == plain_sample(rows, good)
    assert all(r["accepted"] == (r["kept"] and not r["toxic"]) for r in got)


def test_importance_query_tells_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in importance.op1_importance_resampling(spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{sf}/labels.parquet'").fetchall()
    accepted = lambda q, x: np.mean([got[d]["accepted"] for d, quality, toxic in labels if (quality, toxic) == (q, x)])
    assert accepted(1, 0) > 0.95 and accepted(1, 1) < 0.3 and accepted(0, 0) < 0.15


def test_telling_words(spark):
    """Learned from some documents, they tell others; a word that others hold as well is none."""
    texts = [f"plain text of {k} words awful" if k % 5 == 0 else f"plain text of {k} words" for k in range(100)] + ["AWFUL!", "lawful", None]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(100)], "doc_id long, quality long, toxic long")
    words = importance.telling_words(docs, labels)
    assert words == {b"awful"}
    assert {r["doc_id"] for r in importance.without_toxic(docs, words).collect()} == {*range(103)} - {*range(0, 101, 5)}
    assert not importance.telling_words(docs, labels.where("toxic = 0")) and not importance.telling_words(docs, labels.where("toxic = 1"))


def test_importance_weights_against_plain_counts(spark):
    texts = ["good plain words here"] * 5 + ["BAD!! BAD!! words"] * 5
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 5), 0) for i in range(10)], "doc_id long, quality long, toxic long")
    ratios, share = importance.fit(docs, labels, prior=1.0)
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(importance.features(t).tolist())
        target.update(importance.features(t).tolist() if i < 5 else ())
    for b, n in raw.items():
        expected = n * sum(target.values()) / sum(raw.values())
        assert np.isclose(ratios[b], np.log((target[b] + 1) / (expected + 1)))
    assert share == 0.5 and np.count_nonzero(ratios) <= len(raw)


def test_importance_edges(spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, 1, None), (None, 1, 0), (7, None, 0), (12, 1, 1)], "doc_id long, quality long, toxic long")
    assert importance.keep_good(tricky(spark), labels).columns == tricky(spark).columns
    none = labels.where("false")
    assert importance.keep_good(tricky(spark), none).count() == len(tricky_rows())
    assert importance.keep_good(empty(spark), labels).count() == 0


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(0).normal(size=5000)] + [2.5] * 700
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 50, 700, 5699, 5700):
        assert importance.kth_largest(keys, "key", k, bins=7, few=20) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(keys, "key", 5701) is None and importance.kth_largest(keys, "key", 0) is None


def test_gumbel_top_k_samples_in_proportion():
    """The chance to come first is the weight's share."""
    logs = np.log(np.array([0.5, 0.3, 0.2]))
    noise = importance.gumbel(np.arange(60_000, dtype=np.uint64)).reshape(-1, 3)
    share = np.bincount(np.argmax(logs + noise, axis=1), minlength=3) / 20_000
    assert np.allclose(share, [0.5, 0.3, 0.2], atol=0.02)


def test_queries_against_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.SQL.items():
        got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        order = sorted(got.columns)
        text = lambda f: sorted(map(tuple, f[order].astype(object).where(f[order].notna(), None).astype(str).values.tolist()))  # noqa: E731, B023
        assert [str(x).replace(".0", "") for x in text(got)] == [str(x).replace(".0", "") for x in text(want)], name


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.toPandas()
        if k < 4:
            assert list(after.columns) == list(before.columns)
        if name == "line dedup":
            assert set(after.doc_id) == set(before.doc_id)
        if name == "near dedup":
            comp = brute_components(list(zip(before.doc_id, before.text)))
            assert set(after.doc_id) == {i for i, c in comp.items() if i == c}
        if k == 4:
            assert set(after.doc_id) == set(before.doc_id)


def test_pipeline_stands_tricky_rows(spark):
    docs = tricky(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or set(out.columns) == set(docs.columns)
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_pipeline_on_an_empty_table(spark):
    docs = empty(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.isEmpty() and (k == 4 or out.columns == docs.columns)
        docs = spark.createDataFrame([], out.schema)


def test_pipeline_stages_on_tricky_rows(spark):
    """What each stage makes of rows without id, with repeated ids, of equal rows and clashing columns."""
    rows = tricky_rows()
    docs = tricky(spark)
    by = lambda frame: Counter(tuple(r) for r in frame.collect())
    assert by(corpus_pipeline.quality(spark, docs, SF)) <= Counter(rows)
    cut = corpus_pipeline.lines(spark, docs, SF).select(*docs.columns).collect()
    assert Counter((r["doc_id"], r["doc"], r["first"], r["text"] is None) for r in cut) == Counter((r[0], r[5], r[6], r[1] is None) for r in rows)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut)
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    alone = Counter(r for r in rows if not shingle_set(r[1]))
    assert near.columns == docs.columns and alone <= by(near) <= Counter(rows)
    comp = brute_components([(k, r[1]) for k, r in enumerate(rows)])
    assert near.count() == len(set(comp.values()))
    assert by(corpus_pipeline.decontamination_stage(spark, docs, SF)) == Counter(rows)
    pieces = corpus_pipeline.sequences(spark, docs, SF).where("piece = 0")
    assert Counter(r[0] for r in pieces.select("doc_id").collect()) == Counter(r[0] for r in rows)


def test_pipeline_run_leaves_nothing_but_its_result(spark):
    from siltstone.llm.support import scratch_dir

    folder = scratch_dir(spark).removeprefix("file://") + "/llm"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert [n.rsplit("-", 1)[0] for n in sorted(set(os.listdir(folder)) - before)] == ["pipeline-best-fit-packing"]


def test_components_of_many_links(spark, monkeypatch):
    monkeypatch.setattr("siltstone.llm.components.LARGE", 10)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)]
    assert dict(components(spark.createDataFrame(links, "a long, b long")).collect()) == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
