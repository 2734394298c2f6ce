import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvstrata.llm.langid import UND, gram_counts, identify, identify_held_out, learn
from kvstrata.llm.minhash import REGISTERS, estimate, near_duplicates, registers
from kvstrata.llm.packing import byte_bpe, pack_documents
from kvstrata.llm.queries import tokenizer_file
from kvstrata.llm.sharding import TOLERANCE, below, halves, shard, splitters
from kvstrata.llm.substring_dedup import remove_repeats
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, size string"


def corpus(seed: int, families: int = 12) -> list[tuple[int, str | None]]:
    """Families of copies from equal to hardly alike, truncated copies, shared passages, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts: list[str | None] = [None, "", "  \n\t ", "one", "One", "ONE two three", "one two three", "a b c d e", "a b c d e f"]
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randrange(20, 200))
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[: rng.randrange(len(copy) // 2, len(copy)) + 1]
            text = " ".join(copy)
            texts.append(text.upper() if rng.random() < 0.2 else f"{text}\n{passage}" if rng.random() < 0.2 else text)
    rng.shuffle(texts)
    return list(enumerate(texts, 3))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", None, None, "x", "y", "z") for i, t in docs], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.near_documents(docs)


def test_near_duplicates_of_odd_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B c d e f"), (3, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame(spark, docs)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 1, False), (3, 3, True)], key=str)
    assert near_duplicates(frame(spark, docs).limit(0)).count() == 0


def test_near_duplicates_in_large_families(spark, monkeypatch):
    """Groups of one centre that only other members link, in several blocks, with a main group and without."""
    import kvstrata.llm.minhash as module

    monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(module, "PARTNERS", 8)
    rng = random.Random(18)
    vocabulary = [f"w{k}" for k in range(4000)]
    docs = []
    for copies, changes in ((60, (0, 1, 2, 3, 4)), (40, (3, 4, 5))):
        base = rng.choices(vocabulary, k=150)
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.choice(changes)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    docs = list(enumerate(docs, 3))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.near_documents(docs) and len({c for _, c in got.values()}) > 4


def test_near_duplicates_shuffle_no_text(spark, monkeypatch):
    """Texts are read where they lie, also when a full bitmap leaves the choice of documents to the join."""
    import kvstrata.llm.minhash as module

    docs, plans = corpus(4), []
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    real = type(table).mapInArrow
    monkeypatch.setattr(module, "MAP_BITS", 6, raising=False)

    def noted(self, work, schema):
        if "text" in self.columns:
            plans.append(self._jdf.queryExecution().executedPlan().toString())
        return real(self, work, schema)

    monkeypatch.setattr(type(table), "mapInArrow", noted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table).collect()}
    assert got == brute.near_documents(docs) and len(plans) == 2 and not any("Exchange" in p for p in plans)


def test_near_duplicates_of_ids_with_several_texts(spark):
    rng = random.Random(19)
    one, two, three = (" ".join(f"{x}{rng.randrange(999)}" for _ in range(40)) for x in "abc")
    docs = [(5, one), (9, one), (9, two), (7, two), (8, three), (7, three), (6, "alone and by itself"), (4, None), (4, "x y")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_duplicates(frame(spark, docs)).collect()}
    assert {c for (i, _), c in got.items() if i in (5, 7, 8, 9)} == {5} and got[6, 1] == 6 and got[4, 0] == got[4, 1] == 4


def test_estimates_follow_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for n, m in ((1000, 500), (1000, 900), (800, 0)):
        a, b = np.sort(x[:1000]), np.sort(x[1000 - m : 1000 - m + n])
        sketch = registers(np.concatenate([a, b]), np.array([len(a), len(b)]))
        true = m / (len(a) + len(b) - m)
        assert sketch.shape == (2, REGISTERS) and abs(estimate(sketch[:1], sketch[1:], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.12


def test_packing_of_odd_rows(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    rows = [(None, "no id"), (7, "one text, twice"), (7, "one text, twice"), (8, None), (9, "")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, start int, ids string").coalesce(1)
    got = pack_documents(df, path).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows) and {r.doc_id: r.length for r in got}[8] == 1
    assert sorted(r.offset for r in got) == sorted(np.cumsum([0, *(r.length for r in sorted(got, key=lambda r: r.offset))])[:-1].tolist()) and len({r.sequence_id for r in got}) == 1


@pytest.mark.parametrize("seed", [3, 4])
def test_remove_repeats(spark, seed):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text.encode()) for r in remove_repeats(frame(spark, docs)).collect()}
    assert got == brute.without_repeats(docs)


def test_remove_repeats_of_odd_rows(spark):
    text = " ".join(f"x{k}" for k in range(20))
    docs = [(1, text), (1, text), (None, text), (2, text), (3, "y " + text + " z"), (4, None)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(frame(spark, docs)).collect()), key=str)
    assert got == sorted([(1, 20, 0), (1, 20, 0), (None, 20, 0), (2, 20, 20), (3, 22, 20), (4, 0, 0)], key=str)
    assert remove_repeats(frame(spark, docs).limit(0)).count() == 0


def test_remove_repeats_in_many_batches_with_other_columns(spark, monkeypatch):
    import kvstrata.llm.substring_dedup as module

    monkeypatch.setattr(module, "BATCH_BYTES", 3000)
    monkeypatch.setattr(module, "GROUP_BYTES", 2000)
    docs = corpus(5) + [(None, "no id " * 30)] * 20 + [(7000, "one id " * 30)] * 20
    df = frame(spark, docs).withColumns({"__batch": F.lit("b"), "__id": F.lit("i"), "batch": F.lit(1), "id": F.lit(2), "repeats": F.lit(3)})
    rows = remove_repeats(df).collect()
    expected = brute.without_repeats([d for d in docs if d[0] is not None and d[0] != 7000])
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text.encode()) for r in rows if r.doc_id in expected} == expected
    assert len(rows) == len(docs) and all(r.n_removed == 0 for r in rows if r.doc_id not in expected) and {(r["__batch"], r["__id"], r.batch, r.id) for r in rows} == {("b", "i", 1, 2)}
    for r in rows:
        words = (r.text or "").split()
        gone = {k for a, b in r.repeats for k in range(a, b)}
        assert len(gone) == r.n_removed and " ".join(w for k, w in enumerate(words) if k not in gone) == r.kept_text
        assert all(b - a >= module.WINDOW for a, b in r.repeats) and all(x.end < y.begin for x, y in zip(r.repeats, r.repeats[1:], strict=False)), "maximal"


def test_text_is_moved_once(spark):
    plan = remove_repeats(frame(spark, corpus(5)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_tasks_drop_what_other_operators_keep(spark, monkeypatch):
    """A worker that has packed drops its tokeniser and memo when it serves a task of another operator of the pipeline."""
    docs, path, taken = frame(spark, corpus(6)), tokenizer_file("byte_bpe_50k.json"), []
    for kind, name in ((type(docs), "mapInArrow"), (type(docs.groupBy("doc_id")), "applyInArrow")):
        real = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, work, schema, real=real: taken.append(work) or real(self, work, schema))
    gram_counts(docs)
    near_duplicates(docs)
    n = len(taken)
    remove_repeats(docs)
    rows = pa.table({"id": pa.array([3]), "text": ["one two three four five six"], "lang": ["en"]})
    for work in (lambda: list(taken[0](iter(rows.to_batches()))), lambda: list(taken[1](iter(rows.to_batches()))), lambda: taken[n]((pa.scalar(0),), rows)):
        byte_bpe(path).encode("one two three")
        work()
        assert byte_bpe.cache_info().currsize == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    rng = random.Random(6)
    docs = [(i, t) for i, t in corpus(6)] + [(900, "<|endoftext|> a  b <|endoftext|>"), (901, "日本 語 \u0000 é  \n x"), (902, " ".join(rng.choices(["lorem", "ipsum,", "Dolor.\nSit"], k=6000)))]
    tokenizer = Tokenizer.from_file(path)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in docs}
    rows = pack_documents(frame(spark, docs), path).withColumn("ids_crc32", F.crc32("ids")).collect()
    padding = brute.check_pieces(rows, ids)
    assert padding <= 3 * 2048, "at most one padded window a task"
    assert pack_documents(frame(spark, docs).limit(0), path).count() == 0


def check_shards(rows, docs, shards):
    """The law: every row once, equal texts in one shard but where one group alone holds up a splitter, slots gapless."""
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(docs, key=str)
    sizes, slots, groups = [0] * shards, [[] for _ in range(shards)], {}
    for r in rows:
        assert r["size"] == len((r.text or "").encode()) + 16
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r.slot)
        groups.setdefault(r.text, Counter())[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    longest = max(r["size"] for r in rows)
    assert max(abs(n - sum(sizes) / shards) for n in sizes) <= longest + 2 * sum(sizes) / shards * TOLERANCE
    for held in groups.values():
        assert len(held) == 1 or sum(held.values()) > sum(sizes) / shards * TOLERANCE
        whole = sorted(held)
        assert whole == list(range(whole[0], whole[-1] + 1)), "a group is in adjoining shards"


def test_sharding(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i, rng.choice([None, "", "same text", "x" * rng.randrange(2000)])) for i in range(3000)] + [(None, "a"), (7, "twice"), (7, "twice")]
    check_shards(shard(frame(spark, docs), 10).collect(), docs, 10)
    check_shards(shard(frame(spark, docs[:3]), 10).collect(), docs[:3], 10)
    assert shard(frame(spark, docs).limit(0), 10).count() == 0
    monkeypatch.setattr("kvstrata.llm.sharding.RANGE_BYTES", 4096)
    df = frame(spark, docs).withColumns({"__h": F.lit(1), "bin": F.lit("b"), "__Part": F.lit(2), "slot": F.lit("s")})
    rows = shard(df, 10).collect()
    check_shards(rows, docs, 10)
    assert {(r["__h"], r["bin"], r["__Part"], r["n_words"]) for r in rows} == {(1, "b", 2, "x")}


def test_splitters_of_many_shards():
    rng = np.random.default_rng(16)
    h, g = rng.integers(-(1 << 63), (1 << 63) - 1, (2, 100_000))
    h[:30_000] = h[0]
    size = rng.integers(16, 3000, 100_000)
    rounds = []

    def count_below(probes):
        rounds.append(len(probes))
        place = below(halves(probes), h, g)
        return tuple(np.cumsum(np.bincount(place, weights=w, minlength=len(probes) + 1)).astype(int)[:-1] for w in (size, np.ones(len(h))))

    began = time.perf_counter()
    found = splitters(count_below, 2000, int(size.sum()), len(h))
    assert time.perf_counter() - began < 5 and len(rounds) < 20 and found == sorted(found) and len(found) == 1999
    each = np.bincount(below(halves(found), h, g), weights=size, minlength=2000)
    assert np.abs(each - size.sum() / 2000).max() <= 3000 + 2 * size.sum() / 2000 * TOLERANCE
    place = below(halves(found[:3]), h, g)
    assert (place == sum((h > a) | (h == a) & (g >= b) for a, b in zip(*halves(found[:3]), strict=True))).all()


def test_language(spark):
    rng = random.Random(9)
    syllables = {"en": "the and ing tion er".split(), "fr": "é eau que ment è".split(), "de": "sch ein ung ü keit".split()}
    docs = []
    for i in range(300):
        lang = rng.choice(sorted(syllables))
        docs.append((i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randrange(4, 60))), lang))
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "fr"), (1003, "日本語", None), (None, "the anding", "en")]
    df = spark.createDataFrame([(i, t, la, "s") for i, t, la in docs + odd], "doc_id bigint, text string, lang string, score string")
    got = {r.doc_id: r for r in identify_held_out(df).collect()}
    assert len(got) == len(docs) + len(odd)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 for i, *_ in docs)
    held = [(i, la) for i, _, la in docs if got[i].held_out]
    assert sum(got[i].lang_pred == la for i, la in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == [UND] * 3 and got[1003].lang_pred in syllables and not got[None].held_out
    assert {r.lang_pred for r in identify_held_out(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {UND}
    assert identify_held_out(df.limit(0)).count() == 0


def test_language_against_plain_em(spark):
    """Predictions and scores of a mixture written down from its definition, a word and a trigram at a time."""
    rng = random.Random(20)
    syllables = {"en": "the and ing tion er".split(), "fr": "é eau que ment è".split(), "de": "sch ein ung ü keit".split()}
    text = lambda langs, n: " ".join("".join(rng.choices(syllables[rng.choice(langs)], k=3)) for _ in range(n))
    labelled = [(text([lang], 30), lang) for lang in sorted(syllables) for _ in range(30)]
    asked = [text(rng.choices(sorted(syllables), k=rng.randrange(1, 4)), rng.randrange(1, 40)) for _ in range(60)] + ["Éa THE x1y", "a", "日本 the"]
    model = learn(spark.createDataFrame(labelled, "text string, lang string"))
    found = identify(spark.createDataFrame(list(enumerate(asked)), "i int, text string"), model).orderBy("i").collect()
    plain = brute.PlainMixture(labelled)
    for r in found:
        shares = plain.shares(asked[r.i])
        main = max(shares, key=lambda lang: shares[lang])
        assert r.lang_fits and r.lang_pred == main and abs(r.score - shares[main]) < 1e-3 and set(r.lang_set) == {k for k, x in shares.items() if x > 0}


def test_language_sets_of_any_size(spark):
    rng = random.Random(10)
    syllables = {"en": "the and ing tion er".split(), "fr": "é eau que ment è".split(), "de": "sch ein ung ü keit".split(), "es": "ción ñ os ll ado".split(), "pl": "szcz rzy ł wie ów".split()}
    words = lambda lang, n: ["".join(rng.choices(syllables[lang], k=3)) for _ in range(n)]
    model = learn(spark.createDataFrame([(" ".join(words(lang, 40)), lang) for lang in syllables for _ in range(20)], "text string, lang string"))
    sets = [("en", "fr", "de", "es", "pl"), ("en", "fr", "de", "es"), ("fr", "de"), ("pl",), ()]
    mixed = []
    for i, langs in enumerate(sets):
        text = [w for lang in langs for w in words(lang, 60)]
        rng.shuffle(text)
        mixed.append((i, " ".join(text)))
    for r in identify(spark.createDataFrame(mixed, "doc_id bigint, text string"), model).collect():
        langs = sets[r.doc_id]
        assert set(r.lang_set) == set(langs) and len(r.lang_set) == len(langs) == len(r.lang_shares)
        assert all(abs(x - 1 / len(langs)) < 0.05 for x in r.lang_shares) and r.lang_shares == sorted(r.lang_shares, reverse=True)
        assert (r.lang_pred, r.score) == ((r.lang_set[0], r.lang_shares[0]) if langs else (UND, 0))


def test_pipeline_drops_texts_of_no_learned_language(spark, out):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    syllables = {"en": "the and ing tion er".split(), "fr": "é eau que ment è".split(), "de": "sch ein ung ü keit".split()}
    docs = []
    for i in range(300):
        lang = rng.choice(sorted(syllables))
        docs.append((i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randrange(2, 60))), lang))
    odd = ["これは日本語の文章です。" * 3, "Это русский текст, его здесь никто не учил", "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)), " ".join("".join(rng.choices("bcdfgjkmpqvwxyz", k=7)) for _ in range(40))]
    rows = [(i, t, la, "s", len(t)) for i, t, la in docs + [(1000 + k, t, None) for k, t in enumerate(odd)]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in corpus_pipeline.language(spark, df, out).collect()} == {i for i, *_ in docs}


def test_pipeline_stages(spark, out):
    from pathlib import Path

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = [(i, t) for i, t in corpus(11)]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(Path(out) / "documents.parquet"))
    df = spark.read.parquet(str(Path(out) / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    named = {r.doc_id: r.text for r in stages["language"](spark, df, out).collect()}
    assert named == {i: t for i, t in docs if t and any(map(str.isalpha, t))}
    one = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in named.items()], df.schema)
    alone = {r.doc_id: r.text for r in stages["near_dedup"](spark, one, out).collect()}
    assert alone == {i: named[i] for i, (_, c) in brute.near_documents(list(named.items())).items() if i == c}
    two = one.where(F.col("doc_id").isin(list(alone)))
    cut = {r.doc_id: (r.text, r.n_chars) for r in stages["substring_dedup"](spark, two, out).collect()}
    expected = {i: (k.decode() if n else alone[i]) for i, (w, n, k) in brute.without_repeats(list(alone.items())).items() if n < w or not n}
    assert {i: t for i, (t, _) in cut.items()} == expected and all(len(t) == n for t, n in cut.values())
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    ids = {i: np.array([*bpe.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in expected.items()}
    last = corpus_pipeline.run(spark, out).collect()
    brute.check_pieces(last, ids)


def test_kept_digest_matches(spark):
    text = " ".join(f"x{k}" for k in range(20))
    row = remove_repeats(frame(spark, [(1, text)])).select(F.sha2("kept_text", 256).alias("d")).first()
    assert row.d == hashlib.sha256(text.encode()).hexdigest()
