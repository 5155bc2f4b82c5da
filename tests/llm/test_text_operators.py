"""Toxicity, decontamination, BPE, token files, licences, language ID: against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edgeloom.llm import bpe, common, decontaminate, langid, licenses, queries, token_files, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "same text"), (4, "same text"), (None, "no id"), (5, "é ß 日本 😀 ² Ⅷ"), (6, "<|endoftext|> a <|endoftext|>"), (7, "word " * 30_000)]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- toxicity -----------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.count_if(F.col("predicted") == F.col("toxic")).alias("ok"), F.count("*").alias("n"), F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)).alias("hit"), F.sum("toxic").alias("pos")).first()
    assert r["ok"] / r["n"] > 0.95 and r["hit"] / r["pos"] > 0.7


def test_toxicity_scores_every_row(spark):
    docs = odd(spark).withColumn("n_terms", F.lit("clash"))
    labels = spark.createDataFrame([(10, 1), (11, 0), (None, 1), (12, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs.unionByName(spark.createDataFrame([(10, "bad", ""), (11, "fine", ""), (12, "x", "")], docs.schema)), labels).collect()
    assert len(rows) == len(ODD) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(odd(spark), labels.limit(0)).count() == len(ODD)


def test_pairwise_interactions_matter(spark):
    """Neither word alone tells the classes apart, only both together."""
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(["aaaa"] * a + ["bbbb"] * b + [f"w{rng.randrange(50)}"]), int(a == b)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["toxicity_score"] >= 0.5 for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i] == bool(y) for i, _, y in rows]) > 0.9


def test_machine_brute_force():
    """Bias, weights and the products of the vectors of all pairs of terms."""
    rng = np.random.default_rng(1)
    m = toxicity.FMModel(np.arange(30), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    rows = [np.sort(rng.choice(30, n, replace=False)) for n in (0, 1, 2, 9, 30)]
    want = [0.3 + sum(m.w[i] for i in r) + sum(m.v[i] @ m.v[j] for k, i in enumerate(r) for j in r[k + 1 :]) for r in rows]
    assert np.allclose(m.raw(rows), want) and np.allclose(m.score(rows), 1 / (1 + np.exp(-np.array(want))))


def test_pair_screen_brute_force():
    rng = np.random.default_rng(5)
    x = rng.random((800, 40)) < 0.3
    y = np.where(x[:, 3] & x[:, 17], rng.random(800) < 0.9, rng.random(800) < 0.1)
    rows = [np.flatnonzero(r) for r in x]

    def g(seen):
        t = np.array([[np.sum(seen & y), np.sum(seen & ~y)], [np.sum(~seen & y), np.sum(~seen & ~y)]], float)
        e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
        return 2 * np.sum(t[t > 0] * np.log(t[t > 0] / e[t > 0]))

    p = toxicity.FMParams(min_pair_g=4.0)
    want = np.zeros(40, bool)
    for i in range(40):
        for j in range(i):
            if g(x[:, i] & x[:, j]) - max(g(x[:, i]), g(x[:, j])) >= p.min_pair_g:
                want[[i, j]] = True
    got = toxicity.interacting(rows, y, 40, p, block=16)
    assert (got == want).all() and got[3] and got[17] and not got.all()
    assert not toxicity.interacting(rows, y, 40, toxicity.FMParams(min_pair_g=1e9)).any() and len(toxicity.interacting([], y[:0], 0, p)) == 0


def kinds_of_rows(spark, kinds, n=8000):
    """Labels that are 1 for an insult with a group, or neither: words alone say nothing, and each of them is rare."""
    rng, rows = random.Random(8), []
    for i in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"insult{rng.randrange(kinds)}"] * a + [f"group{rng.randrange(kinds)}"] * b + [f"w{rng.randrange(400)}" for _ in range(6)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


@pytest.mark.parametrize("kinds", [2, 60])
def test_rare_words_of_two_kinds_interact(spark, kinds):
    rows = kinds_of_rows(spark, kinds)
    got = toxicity.toxicity(rows.select("doc_id", "text"), rows.select("doc_id", "toxic")).join(rows, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0] > 0.9


def test_many_rows_of_one_labelled_id(spark):
    """A hot id teaches by each text once, and no more rows than max_rows or so are fitted."""
    docs = spark.range(4000).selectExpr("1L as doc_id", "concat('text ', id % 3000) as text").union(spark.range(2, 60).selectExpr("id", "concat('other ', id)"))
    labels = spark.range(1, 60).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    staged = toxicity._labelled(docs, labels, F.lit(True), toxicity.FMParams(max_rows=500))
    assert staged.count() == 3058 and 300 < toxicity._learned_from(staged).count() < 700
    assert toxicity.toxicity(docs, labels, toxicity.FMParams(max_rows=500, steps=5)).count() == 4058


# --- decontamination ----------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, window=10):
    windows: dict = {}
    for i, t in items:
        w = tuple(WORD.findall(lower(t)))
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(w[a : a + k], set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, its = tuple(WORD.findall(lower(t))), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if w[a : a + k] in windows:
                    hit.update(range(a, a + k))
                    its |= windows[w[a : a + k]]
        out.append((d, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [400_000, 60])
def test_decontamination_brute_force(spark, block):
    rng = random.Random(5)
    text = lambda n, extra="": " ".join(rng.choice(("a", "b", "C", "d", "É") + tuple(extra)) for _ in range(rng.randrange(n)))
    items = [(i, text(16)) for i in range(60)] + [(3, None), (None, "a b b a"), (70, ""), (71, "a"), (71, "a")]
    docs = [(i, text(90, "z")) for i in range(200)] + ODD + [(None, "1"), (1, None), (900, "a b c d " * 2000)]
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), decontaminate.DecontaminationParams(block_words=block))
    assert sorted(map(tuple, got.collect()), key=str) == brute_hits(docs, items)


def test_decontamination_of_the_table_and_removal(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op2_decontamination(spark, SF).collect()), key=str) == brute_hits(rows, [tuple(r) for r in bench.select("item_id", "text").collect()])
    clean = decontaminate.decontaminate(docs.withColumn("spans", F.lit(1)), bench)
    assert clean.columns == [*docs.columns, "spans"] and decontaminate.report(clean, bench).where("contaminated").count() == 0


def thue_morse(n):
    s = "a"
    for _ in range(n):
        s += s.translate({97: 98, 98: 97})
    return s


def test_words_that_weak_hashes_confuse(spark):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2 ** 64; they are different words here."""
    a, b = thue_morse(10), thue_morse(10).translate({97: 98, 98: 97})
    ws = [a, b, thue_morse(5), thue_morse(5).translate({97: 98, 98: 97}), "x" * 300, "x" * 299 + "y", "abcdefgh", "abcdefgi", "abcdefghi"]
    places = [np.cumsum([0, *map(len, ws[:-1])]), np.cumsum(list(map(len, ws)))]
    assert len(set(common.word_hashes(np.frombuffer("".join(ws).encode(), np.uint8), *places).tolist())) == len(ws)
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} long, text string")
    got = decontaminate.report(frame([(1, f"p {a} q {b}"), (2, b)], "doc_id"), frame([(7, a)], "item_id")).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["n_items"]) for r in got] == [(1, 1), (0, 0)]


def test_colliding_hashes_do_not_count_as_hits(spark, monkeypatch):
    """With hashes of three bits, the words themselves still decide."""
    monkeypatch.setattr(decontaminate, "word_hashes", lambda *x: common.word_hashes(*x) & np.uint64(7))
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    items = [(i, text(rng.randrange(1, 30))) for i in range(40)]
    docs = [(i, text(60) + " " + items[i % 40][1]) for i in range(80)]
    automaton = decontaminate.Automaton.build([(str(i), decontaminate.item_words(t)) for i, t in items], 10)
    want = {r[0]: r[2] for r in brute_hits(docs, items)}
    for i, t in docs:
        found = [automaton.scan(*x) for x in decontaminate.placed_words(pa.array([t]))]
        assert sum(e - s for f in found for own, _ in f.values() for s, e in decontaminate.merged(own)) == want[i]


def test_decontamination_without_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(odd(spark), none).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.report(odd(spark).limit(0), none).count() == 0


# --- BPE and token files ------------------------------------------------------------------------------------------------


def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_random_texts():
    rng = random.Random(1)
    letter = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 127), rng.randrange(0xA0, 0x17F), rng.randrange(0x400, 0x450), rng.randrange(0x4E00, 0x4F00), 10, 32]))
    texts = [t or "" for _, t in ODD] + ["".join(letter() for _ in range(rng.randrange(1, 200))) for _ in range(500)]
    texts += ["".join(rng.choice("a =-_*#") * rng.randrange(1, 40) for _ in range(rng.randrange(1, 10))) for _ in range(500)]
    c, t = bpe.Coder(public_tokenizers.path("byte_bpe_50k.json")), reference()
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = c.encode_batch(texts)
    assert got == want and [c.decode(i) for i in got] == [t.decode(i, skip_special_tokens=False) for i in want]


def test_bpe_every_token_of_the_vocabulary_is_apart_from_itself():
    """What the encoding of prefixes rests on: the tokens, as words, encode to themselves."""
    c = bpe.Coder(public_tokenizers.path("byte_bpe_50k.json"))
    words = {t.decode(): i for i, t in enumerate(c.v.tokens) if t and i not in c.v.specials.values() and not _broken(t)}
    got = dict(c.trie._traverse(list(words)))
    assert all(got[w] == (i,) for w, i in words.items())


def _broken(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return True
    return False


def test_bpe_digests_keep_words_between_batches():
    """Words kept from earlier batches are not worked out again; however few are kept, the digests are the same."""
    coder = bpe.Coder(public_tokenizers.path(bpe.DEFAULT_VOCABULARY))
    batches = [["one two three", "", None], ["two three four<|endoftext|> \u00e9\u00e9"], ["five two"]]
    made = []
    traverse = coder.trie._traverse
    coder.trie._traverse = lambda ws: made.extend(ws) or traverse(ws)
    few, many = {}, {}
    some = [bpe._digested(coder, few, b, 2, True) for b in batches]
    made.clear()
    all_ = [bpe._digested(coder, many, b, 100, True) for b in batches]
    assert sorted(made) == sorted(set(made))
    assert [[(*r[:3], r[3].tolist()) for r in b] for b in some] == [[(*r[:3], r[3].tolist()) for r in b] for b in all_]


def test_bpe_query(spark):
    t = reference()
    for docs in (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), odd(spark), odd(spark).limit(0)):
        want = []
        for d, text in docs.collect():
            ids = t.encode(text or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
        assert sorted(map(tuple, bpe.digests(docs).drop("text").collect()), key=str) == sorted(want, key=str)
    both = bpe.decode(bpe.encode(odd(spark)))
    assert all(r["decoded_text"] == (r["text"] or "") for r in both.collect())


@pytest.mark.parametrize("n, most", [(0, 5), (1, 300), (7, 70_000), (100, 1 << 25), (1000, 200)])
def test_code_round_trip(n, most):
    x = np.random.default_rng(1).integers(0, most, n).astype(np.uint32)
    bits, control, data = token_files.pack(x)
    assert (token_files.unpack(n, bits, np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)) == x).all()


def test_token_encoder_equals_the_library():
    rng = random.Random(2)
    letter = lambda: rng.choice(["a", "B", "é", "日", "'s", " ", " ", "  ", "\n", "\t", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "1", "²", ".", "!?", "<|endoftext|>", "😀", "\0"])
    texts = ["".join(letter() for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, "", " ", "\n\n x"]
    want = [e.ids for e in reference().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for most in (400_000, 20):
        encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), most)
        assert [x.tolist() for k in range(0, len(texts), 100) for x in encoder.batch(texts[k : k + 100])] == want
    assert encoder.batch([]) == []


def test_token_encoder_keeps_the_words_in_use():
    """When its tables are full, words that keep coming are not encoded anew; ids stay those of the library."""
    encoder = token_files.Encoder(public_tokenizers.path(token_files.DEFAULT_VOCABULARY), most=40)
    learned, learn = [], encoder._learn
    encoder._learn = lambda new: learned.extend(new) or learn(new)
    for k in range(20):
        text = "often often always always" + "".join(f" word{k}x{i}" for i in range(15))
        assert encoder.batch([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert learned.count(" always") == 1 and learned.count(" often") == 1


def test_token_encoder_cuts_only_where_a_word_begins():
    """All kinds of white space, letters and marks beside each other, also over row borders; special tokens; Arrow columns and slices."""
    rng = random.Random(3)
    signs = [*map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))]
    signs += [*" \n\t'.*_-aZs1éßÿ×÷ĉɿжз҃җ٣λ日、—“", "'s", "'ll", "n't", "\u0301", "😀", "<|endoftext|>", "<|endof"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(12))) for _ in range(20_000)] + [a + b + c for a in signs for b in signs for c in (" ", " x", ".", "  y")]
    want = [e.ids for e in reference().encode_batch(texts, add_special_tokens=False)]
    encoder = token_files.Encoder(public_tokenizers.path(token_files.DEFAULT_VOCABULARY), 5_000)
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        assert [x.tolist() for k in range(0, len(texts), 1000) for x in encoder.batch(column.slice(k, 1000))] == want


def test_token_encoder_gives_the_library_a_word_once_whatever_mark_follows():
    encoder = token_files.Encoder(public_tokenizers.path(token_files.DEFAULT_VOCABULARY))
    learned, learn = [], encoder._learn
    encoder._learn = lambda new: learned.extend(new) or learn(new)
    for text in ("a word, a word. a été*** \nword|", "a word; an été... and word!", None):
        want = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert encoder.batch([text])[0].tolist() == want
    assert learned.count(" word") == 1 and learned.count(" été") == 1 and not any(w.startswith(" word") and w != " word" for w in learned)


def test_token_files(spark):
    t = reference()
    runs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, " " * 3_000_000), (3, "<|endoftext|>" * 3), (4, "x" * 300_000)], "doc_id long, text string")
    for docs in (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), odd(spark), runs, odd(spark).limit(0)):
        want, at = [], 0
        for d, text in sorted(docs.collect(), key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
            want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted(map(tuple, token_files.round_trip(docs).collect()), key=str) == sorted(want, key=str)


def test_token_files_of_a_repeated_id(spark):
    """Most rows have one id, which is dealt over several files: every row is there once, starts follow each other by id."""
    rows = [(7, f"row {k}") for k in range(300)] + [(k, "other") for k in range(20)] + [(None, "none")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash"))
    got = token_files.round_trip(docs).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in rows], key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    t = reference()
    crc = lambda x: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted((str(d), crc(x)) for d, x in rows)
    cuts = np.array([3, 7, 7, 7, 9])
    at = token_files._parts(np.array([1, 3, 5, 7, 7, 7, 7, 8, 9, 10]), np.arange(10), cuts)
    assert set(at[3:7]) == {1, 2, 3, 4} and at[0] == 0 and at[2] == 1 and at[7] == 4 and at[9] == 5


def test_token_files_decode(spark, tmp_path):
    folder = "file://" + str(tmp_path)
    token_files.write_tokens(odd(spark), folder)
    assert sorted(map(tuple, token_files.texts(spark, folder).collect()), key=str) == sorted(((d, t or "") for d, t in ODD), key=str)


# --- language and licences ----------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    got = queries.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok")).first()
    assert r["ok"] > 0.95


def test_language_odd_rows(spark):
    docs = odd(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("score", F.lit(1))
    assert {r["lang_pred"] for r in langid.language_id(docs).collect()} == {"und"}
    two = docs.unionByName(spark.createDataFrame([(k, f"the cat and the dog {k}", "en", 1) for k in range(20, 60)] + [(k, f"der Hund und die Katze {k}", "de", 1) for k in range(60, 99)], docs.schema))
    rows = {r["doc_id"]: r for r in langid.language_id(two).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[4]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[25]["lang_pred"] == "en" and rows[70]["lang_pred"] == "de"


def test_language_of_long_texts(spark):
    """Long texts teach their language: alone, and beside short texts of another; and they are judged as short ones are."""
    rng = random.Random(3)
    german = lambda n: " ".join(rng.choice("der die das und ist nicht ein eine Haus Straße gehen über schön wird auch nur noch".split()) for _ in range(n))
    english = lambda n: " ".join(rng.choice("the a and is not house street go over nice will also only still of to with".split()) for _ in range(n))
    long = [(i, german(6000), "de") for i in range(40)]
    short = [(100 + i, english(12), "en") for i in range(60)]
    asked = [(300, german(12), None), (301, english(12), None), (302, english(9000), None), (303, german(9000), None)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(frame(long + short + asked)).collect()}
    assert {got[i] for i, _, _ in long} == {"de"} and {got[i] for i, _, _ in short} == {"en"} and [got[i] for i in range(300, 304)] == ["de", "en", "en", "de"]
    assert {r["lang_pred"] for r in langid.language_id(frame(long)).collect()} == {"de"} and langid.language_id(frame(long).limit(0)).count() == 0


def test_language_learns_from_rows_of_equal_ids_and_lengths(spark):
    """Neither null ids nor equal lengths nor copies make a language's rows all or none, and what is drawn is bounded."""
    rng = random.Random(4)
    words = lambda letters: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(200)]
    german, english = words("abcdefghijklmnopqrstä"), words("nopqrstuvwxyzé")  # of six letters or so, single letters cost less bits than whole words
    rows = [(None, " ".join(rng.choice(german) for _ in range(40)), "de") for _ in range(3000)]
    rows += [(None, " ".join(rng.choice(english) for _ in range(40)), "en") for _ in range(300)] + [(None, "una sola frase que se repite siempre", "es")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    size = dict(zip(model.languages, map(len, model.contents)))
    most = langid.LangParams().sample_pieces * langid.LangParams().piece_chars * 4
    assert 5_000 < size["de"] < most and size["en"] > 5_000 and size["es"] > 30
    got = langid.identify(docs.dropDuplicates(["text"]), model).agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert got > 0.95


def test_language_sizes_brute_force(spark):
    """The prediction is the language of the smallest total of compressed blocks, whatever the length."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = langid.LangParams()
    model = langid.train(docs, None, p)
    rows = [r["text"] for r in docs.select("text").limit(60).collect()] + ["x", "word " * 40_000]
    for t in rows:
        data = (" " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " ").encode()
        total = {}
        for lang, content in zip(model.languages, model.contents):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=p.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            total[lang] = sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024))
        got = langid.Compressors(model, p).predict(t)
        assert got[0] == min(model.languages, key=lambda k: (total[k], model.languages.index(k)))
        best, second = sorted(total.values())[:2]
        assert abs(got[2] - (second - best) / second) < 1e-12


def test_licenses(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cues = {"mit": "MIT License", "apache": "Apache License", "gpl": "GNU General Public", "cc": "CC BY", "reserved": "All rights reserved"}
    wrong = [r for r in licenses.licenses(docs).join(docs, "doc_id").collect() if r["families"] != ",".join(sorted(f for f, c in cues.items() if c in r["text"]))]
    assert not wrong
    assert licenses.licenses(odd(spark).limit(0)).count() == 0


GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
MIT = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files, to deal\n# in the Software without restriction."


def test_license_paragraphs(spark):
    """Wrapped notices are one paragraph; each row counts its own paragraphs, repeated or not; talk of licences is none."""
    one = "x.\nReleased under the MIT License.\ny"
    rows = [(50, one), (50, one), (50, "another text of this id"), (51, "Title.\n\n" + GPL), (52, MIT), (53, "The general asked for a license to use the software program. All of it was released."), (54, f"{one}.\n\n{GPL}\n"), (None, one)]
    docs = odd(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumns({"families": F.lit("clash"), "words": F.lit(1)})
    got = [(r["doc_id"], r["families"], r["n_paragraphs"], r["first_paragraph"]) for r in licenses.licenses(docs).collect()]
    assert len(got) == len(ODD) + len(rows)
    assert sorted((g for g in got if g[2]), key=str) == sorted([(50, "mit", 1, 1), (50, "mit", 1, 1), (51, "gpl", 1, 2), (52, "mit", 1, 0), (54, "gpl,mit", 2, 1), (None, "mit", 1, 1)], key=str)


HEADERS = {
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License.",
    "gpl": GPL,
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "epl": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at the web site.",
    "zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "boost": "Distributed under the Boost Software License, Version 1.0. (See\naccompanying file LICENSE_1_0.txt or copy at the web site)",
    "cc0": "To the extent possible under law, the author has waived all copyright\nand related or neighboring rights to this work.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.',
    "reserved": "Copyright (c) 2020 Some Company. All rights reserved.",
}


def test_license_headers_and_sentences_like_them(spark):
    """The usual headers of many licences, wrapped and in comments; sentences that share words with them are none of them."""
    rows = [(k, f"Some words first.\n\n{text}\n\nMore words.") for k, (_, text) in enumerate(HEADERS.items())]
    rows += [(100 + k, "/*\n" + "\n".join(" * " + x for x in text.split("\n")) + "\n */") for k, text in enumerate(HEADERS.values())]
    none = ["All rights reserved seats were sold.", "The public library is free and open.", "He was granted permission to use the software for any purpose.", "The eclipse of the sun was made available to the public.", "A boost of the software version 1.0 was distributed.", "The author waived all rights."]
    rows += [(200 + k, t) for k, t in enumerate(none)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    got = {r["doc_id"]: r["families"] for r in licenses.licenses(docs).where("doc_id < 1000").collect()}
    assert {f: got[k] for k, f in enumerate(HEADERS)} == {f: f for f in HEADERS}
    assert {f: got[100 + k] for k, f in enumerate(HEADERS)} == {f: f for f in HEADERS}
    assert {t: got[200 + k] for k, t in enumerate(none)} == dict.fromkeys(none, "")


def test_license_cues_lose_nothing():
    """Without its cue words no template keeps enough of its pairs."""
    p = licenses.LicenseParams()
    cues = set(licenses.cue_words(p.least_overlap))
    for _, t in licenses.TEMPLATES:
        pairs = licenses._pairs(t)
        assert sum(not cues & set(x.split()) for x in pairs) < p.least_overlap * len(pairs)


def test_licenses_learn_from_every_candidate(spark):
    """However many candidates there are, each is learned from or calibrated on, and together they weigh as much as is set."""
    far = [(k, f"The library had permission number {k % 6000} to be free.") for k in range(7000)]
    docs = spark.createDataFrame([*far, (8000, "Released under the MIT License.")], "doc_id long, text string")
    rows, _ = licenses.lessons(licenses.candidates(docs))
    rows = [r for r in rows.collect() if r["family"] == licenses.UNKNOWN and len(r["words"]) > 1]
    assert {r["words"][5] for r in rows} == {str(k) for k in range(6000)}
    assert abs(sum(r["weight"] for r in rows) - licenses.LicenseParams().candidate_weight) < 1e-6
    assert 0.4 < sum(r["teach"] for r in rows) / len(rows) < 0.6


def test_licenses_run_no_python(spark):
    plan = licenses.licenses(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
