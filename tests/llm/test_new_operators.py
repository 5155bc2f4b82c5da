"""Token alignment, collocations and sharding: against brute force, SQL and the laws that they keep."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import difference
from pyspark.sql import functions as F

from edgeloom.llm import alignment, phrases, queries, sharding

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "same text", None), (4, "same text", None), (None, "no id", "de"), (5, "é ß 日本 😀 ² Ⅷ ﬁ", "fr"), (6, "<|endoftext|> a </s> <0x0A>", "en"), (7, "word " * 30_000, "en"), (8, "x" * 60_000, "en"), (9, "tile ▁ piece", "en"), (10, "\r\na;\r\n\r\nb  c\x1cd\x85e　f\0", "es")]


def odd(spark):
    """Rows of odd texts and ids, with columns whose names clash with what operators add."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.withColumns({"size": F.lit("clash"), "pair": F.lit(1), "n": F.lit("clash"), "shard": F.lit("s"), "block": F.lit(0), "rank": F.lit(1)})


# --- alignment ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(*alignment._paths(None, None))


def brute_alignment(t, text):
    """Ids, groups, and links by walking both token sequences with their byte ranges; None if the text has no tokens."""
    if not text:
        return None
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(t.a_tokens[i] for i in a) != raw or b"".join(t.b_tokens[i] for i in b) != raw:
        return None
    i = j = x = y = 0  # places and ends of the last tokens taken
    links, groups, own = [], [], ([], [])
    i_end, j_end = len(t.a_tokens[a[0]]), len(t.b_tokens[b[0]])
    while True:
        links.append((i, j, min(i_end, j_end) - max(x, y)))
        step_a, step_b = i_end <= j_end, j_end <= i_end
        if step_a:
            own[0].append(a[i])
        if step_b:
            own[1].append(b[j])
        if step_a and step_b:
            groups.append(own)
            own = ([], [])
        if step_a:
            i, x = i + 1, i_end
        if step_b:
            j, y = j + 1, j_end
        if i == len(a):
            break
        if step_a:
            i_end += len(t.a_tokens[a[i]])
        if step_b:
            j_end += len(t.b_tokens[b[j]])
    return a, b, links, groups


def brute_report(t, texts):
    made = [brute_alignment(t, x) for x in texts]
    held = Counter(p for m in made if m for p in {(m[0][i], m[1][j]) for i, j, _ in m[2]})
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, "", 0, 0))
            continue
        a, b, links, groups = m
        ids = [(a[i], b[j]) for i, j, _ in links]
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
        out.append((len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), digest, sum(held[p] == top[p[0]] for p in ids), sum(held[p] for p in ids)))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "n_best", "count_sum"]


def test_alignment_report(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(docs, brute_report(tokenizers, [r["text"] for r in docs])))
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in queries.op11_token_alignment(spark, SF).collect()) == want


def test_alignment_of_odd_rows_in_small_blocks(spark, tokenizers):
    want = Counter((r[0], *x) for r, x in zip(ODD, brute_report(tokenizers, [r[1] for r in ODD])))
    for size in (1, 100, 8 << 20):
        assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in alignment.report(odd(spark), block_bytes=size).collect()) == want
    assert want[(9, 0, 0, 0, 0, 0, "", 0, 0)] == 1  # the piece for a blank in a text: B does not give it back
    assert alignment.report(odd(spark).limit(0)).count() == 0


def test_whole_alignments(spark, tokenizers):
    got = alignment.align(odd(spark), shared=True).where("_row.doc_id <> 8 or _row.doc_id is null").collect()
    assert len(got) == len(ODD) - 1 and got[0]["_row"]["size"] == "clash"
    for r in got:
        m, x = brute_alignment(tokenizers, r["_row"]["text"]), r["alignment"]
        if m is None:
            assert not x["a_ids"] and not x["links"] and not x["groups"]
            continue
        a, b, links, groups = m
        assert (x["a_ids"], x["b_ids"]) == (a, b) and [tuple(p) for p in x["links"]] == links
        ends = np.cumsum([[len(p), len(q)] for p, q in groups], 0).tolist()
        assert [[g["a_end"], g["b_end"]] for g in x["groups"]] == ends
        pairs = [(i, j) for (p, q), (p0, q0) in zip(ends, [[0, 0], *ends]) for i in range(p0, p) for j in range(q0, q)]
        assert [tuple(p) for p in x["shared"]] == pairs


def test_chunks_change_no_token(tokenizers):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r", "\r\n", "\x1c", "\x85", "　", "\xa0", "a", "the", "The", ".", ";", ");", "{", "'s", "é", "日本", "ﬁ", "▁", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "\0", "123", "🙂", "​", "\x0b", "\x0c", " of", "ing"]
    known = alignment.Chunks(tokenizers, most=500)
    for _ in range(4000):
        x = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 15)))
        want, at = brute_alignment(tokenizers, x), known.find(tokenizers.chunks(x))
        assert (want is not None) == bool(known.sound[at].all()), repr(x)
        if want:
            a, b, links, groups = want
            assert known.numbers[at, :4].sum(0).tolist() == [len(a), len(b), len(groups), len(links)], repr(x)
            width = len(tokenizers.b_tokens)
            assert Counter(known.links(at).tolist()) == Counter(a[i] * width + b[j] for i, j, _ in links)


def test_row_products():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x, y = rng.random((7, 9)) < 0.3, rng.random((9, 5)) < 0.3
        csr = lambda m: alignment.Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])
        made, value = alignment.row_products(csr(x), csr(y))
        dense = np.zeros((7, 5), int)
        dense[np.repeat(np.arange(7), np.diff(made.start)), made.column] = value
        assert (dense == x.astype(int) @ y.astype(int)).all()
        assert alignment.product_sizes(csr(x), csr(y)).tolist() == (x.astype(int) @ y.astype(int)).sum(1).tolist()
        back = alignment.transposed(csr(x))
        assert (back.start == csr(x.T).start).all() and (back.column == csr(x.T).column).all()


def test_pair_counts(spark, tokenizers):
    got = {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(odd(spark)).collect()}
    made = [brute_alignment(tokenizers, r[1]) for r in ODD]
    assert got == Counter(p for m in made if m for p in {(m[0][i], m[1][j]) for i, j, _ in m[2]})


# --- collocations -------------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, longest=4, most=2000, share=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    inside = defaultdict(int)
    for (lang, *w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, *w[i : i + m]] = max(inside[lang, *w[i : i + m]], a)
    out = defaultdict(list)
    for (lang, *w), a in found.items():
        if not inside[lang, *w] or 100 * inside[lang, *w] < share * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return Counter((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(x)[:most], 1))


def found_phrases(df):
    return Counter((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def test_collocations_same_as_sql(spark):
    assert difference(spark, queries.op12_collocations, queries.oracle_sql()["op12_collocations"], "/root/testdata/sf0.01") == ""


@pytest.mark.parametrize("tile, block", [(2, 7), (1024, 1_300_000)])
def test_collocations_by_brute_force(spark, tile, block):
    """Both kinds of tiles, blocks of a few words, ties, all borders of pieces, words of any characters."""
    rng = random.Random(9)
    words = ["a", "b", "A", "c", "d'e", "é", "日本", "\x00", "x-y", "\x1c", "\x85"]
    gaps = [" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "! ", "\r", "\x0b"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(w for _ in range(rng.randrange(0, 40)) for w in (rng.choice(words), rng.choice(gaps)))) for _ in range(60)]
    rows += [("en", None), ("en", ""), ("fr", "..."), ("es", "once only")] + [("de", "of the people by the people")] * 8
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "word": F.lit("w"), "block": F.lit(0)})
    for least, longest in ((4, 4), (2, 3), (7, 2)):
        want = brute_phrases(rows, least, longest)
        assert want and found_phrases(phrases.collocations(docs, least, longest, block_words=block, tile=tile)) == want
    assert found_phrases(phrases.collocations(docs, 4, 4, most=3, block_words=block, tile=tile)) == brute_phrases(rows, 4, 4, 3)


def test_collocations_of_odd_rows(spark):
    assert found_phrases(phrases.collocations(odd(spark), least=1, most=50)) == brute_phrases([(r[2], r[1]) for r in ODD], 1, most=50)
    assert phrases.collocations(odd(spark).limit(0)).count() == 0


def test_pair_tiles_agree():
    rng = np.random.default_rng(3)
    left, right = (rng.zipf(1.3, 20_000) % 5000 for _ in range(2))
    want = Counter(zip(left.tolist(), right.tolist()))
    for tile, fill in ((16, 1), (64, 16), (8192, 1_000_000), (1024, 16)):
        codes, n = phrases.count_pairs(left, right, tile, fill)
        assert {(c >> 32, c & 0xFFFFFFFF): k for c, k in zip(codes.tolist(), n.tolist())} == want and len(codes) == len(want)


# --- sharding -----------------------------------------------------------------------------------------------------------


def check_shards(rows, shards, texts):
    """The laws: sizes and digests, one shard a text, gapless slots, and the loads of the schedule over the groups."""
    slots, loads = defaultdict(list), [0] * shards
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = Counter()
    for t in texts:
        raw = (t or "").encode()
        sizes[raw] += len(raw) + 16
    heap = [(0, k) for k in range(shards)]
    for n in sorted(sizes.values(), reverse=True):
        heapq.heapreplace(heap, (heap[0][0] + n, heap[0][1]))
    assert sorted(loads) == sorted(x for x, _ in heap)



def test_sharding_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_sharding(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    check_shards(rows, 40, docs.values())
    of = defaultdict(set)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        of[raw].add(r["shard"])
    assert all(len(x) == 1 for x in of.values())


def test_sharding_of_odd_rows_and_files(spark, tmp_path):
    hot = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a hot text").alias("text"), F.lit("en").alias("lang"))
    docs = odd(spark).unionByName(hot, allowMissingColumns=True)
    texts = [r[1] for r in ODD] + ["a hot text"] * 5000
    check_shards(sharding.report(docs, 3).collect(), 3, texts)
    sharding.write_shards(docs, str(tmp_path / "out"), 3, part_rows=700)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r["_row"]["text"] for r in back.collect()) == Counter(texts) and back.where("_row.size = 'clash'").count() == len(ODD)
    counts = back.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in counts)
    assert sharding.report(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(docs, 0)


def test_many_groups_of_one_size_go_as_one_by_one():
    rng = random.Random(5)
    for _ in range(200):
        shards = rng.randrange(1, 9)
        a, b = sharding.Schedule(shards), sharding.Schedule(shards)
        for _ in range(rng.randrange(1, 6)):
            size, n = rng.randrange(1, 50), rng.randrange(1, 300)
            one = Counter()
            for _ in range(n):
                load, k = a.heap[0]
                heapq.heapreplace(a.heap, (load + size, k))
                one[k] += 1
            assert b._many(size, n) == one and sorted(a.heap) == sorted(b.heap)
