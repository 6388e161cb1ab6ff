"""NULLs, empty and long texts, repeated rows, empty tables, extra and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.llm import bpe, chat, copies, fim, language, lexical, mixing, mtree, multiset, pii, quality, sharding, simhash, substrings, suffixes
from pointlake.llm.queries import VOCABULARY
from tests_llm_brute import brute_components, brute_dedup, brute_masked, brute_print, brute_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_words int, shard string, spans int, ids int, fp string, take int, t int, row int, rest int"


def words(r, n, size=40):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    passage = words(r, 80)
    texts = [None, "", " \n\t ", "a", "one two", "é中😀\u0085x", words(r, 400), words(r, 400) + " " + passage, passage + " " + words(r, 60),
             "x " + passage, passage, passage, "z" * 300_000, "k l m " * 3000, "<|endoftext|> tail", "\x00 nul", "mail a@b.co now"]
    rows = [(i, t, "xx" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", 1, "q", 2, 3, "f", 4, 5, 6, 7) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, passage, None, None, *rows[0][4:]), (None, None, *rows[0][2:]), (3, "other text", *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).cache()


def same_rows(out, odd, text=True):
    assert out.count() == odd.count()


def test_odd_rows(spark, odd):
    quality.judge(quality.quality_measures(odd)).collect()
    same_rows(quality.quality_measures(odd), odd)
    protos = language.learn(odd)
    got = language.predict(odd, protos)
    assert {r["lang_pred"] for r in got.filter("text IS NULL OR text = ''").collect()} == {"und"}
    assert language.predict(odd, {}).filter("lang_pred <> 'und'").count() == 0
    found = pii.find_spans(odd)
    assert found.filter("text LIKE '%a@b.co%'").select(pii.listed(F.col("spans"))).first()[0] == "email:5:11"
    assert found.select(pii.masked(F.col("text"), F.col("spans")).alias("m")).filter("m LIKE '%[EMAIL]%'").count() == 1
    coded = bpe.decode(bpe.encode(odd, VOCABULARY), VOCABULARY)
    assert coded.filter("decoded <> coalesce(text, '')").count() == 0 and coded.count() == odd.count()
    parted = sharding.shards(odd, 1000)
    assert parted.count() == odd.count()
    assert parted.groupBy("shard").agg(F.sum("bytes").alias("b"), F.max("shard_bytes").alias("s"), F.count("*").alias("n")).filter("b <> s OR (b > 1000 AND n > 1)").count() == 0


def test_odd_near_duplicates(spark, odd):
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count()
    plain = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).filter("doc_id <> 3")
    want = brute_components({r["doc_id"]: brute_print(r["text"]) for r in plain.collect()})
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(plain, keep=False).collect()} == want


@pytest.mark.parametrize("crowd", [1, 2, 2000])
def test_odd_substrings(spark, odd, crowd):
    got = substrings.deduplicate(odd, crowd=crowd, group=3)
    assert got.count() == odd.count()
    rows = [(r["doc_id"], r["text"]) for r in odd.filter("doc_id IS NOT NULL").collect()]
    short = [(i, n, g) for i, n, g, _ in brute_dedup(rows)]
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got.filter("doc_id IS NOT NULL").collect()) == sorted(short)


def test_crowded_anchors(spark):
    r = random.Random(1)
    prints = set()
    for _ in range(3):
        centre = r.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for _ in range(60)}
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(signed, "fp long, doc_id long")
    want = brute_components({i: p for i, p in enumerate(sorted(prints))})
    for crowd in (3, 50_000):
        got = simhash.components(df, crowd=crowd).join(df, "fp").collect()
        assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_odd_mix(spark, odd):
    out = mixing.attach_plan(odd, mixing.plan(odd))
    assert out.count() == odd.count()
    assert out.filter("size(takes) > 3").count() == 0
    assert "shard" in mixing.draw_mix(odd.drop("shard")).columns
    goal = mixing.targets([100, 0, 300], [1.0, 1.0, 1.0])
    assert goal == [pytest.approx(200.0), 0.0, pytest.approx(200.0)]
    assert mixing.targets([10, 990], [10.0, 1.0]) == [30.0, pytest.approx(970.0)]
    assert sorted(mixing.best_subset([5, 8, 3], 12)) == [1, 2]
    quotas = np.array([5, 0, 9])
    leaves = list(mixing.split_tree(quotas, 7, 0, 7, 1))
    assert (sum(c for _, _, c in leaves) == quotas).all() and [c.sum() for _, _, c in leaves] == [2] * 7
    assert all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(leaves[3:5], mixing.split_tree(quotas, 7, 3, 5, 1), strict=True))


def test_top_k_ties_and_odd_vectors(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 6)).round(1)
    rows = [(i, base[i % 40].tolist()) for i in range(900)] + [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, []), (None, base[0].tolist())]
    rows += [(1000 + i, base[i % 7, :3].tolist()) for i in range(60)] + [(1100, [2.0])]  # other lengths meet their own
    vectors = mtree.integer_vectors(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, tree string, cell int, dim int"))
    assert vectors.count() == 961
    queries = vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted(tuple(x) for x in mtree.top_k(vectors, queries, 5, tree=100).collect())
    v = np.floor(base * 256).astype(int)
    want = []
    for q in range(0, 900, 50):
        best = sorted((-int(v[q % 40] @ v[i % 40]), i) for i in range(900) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for q in (1000, 1050):
        best = sorted((-int(v[(q - 1000) % 7, :3] @ v[i % 7, :3]), 1000 + i) for i in range(60) if 1000 + i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_dialogues(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 70, "cy", "late"), (None, None, None, "x"), (2, 0, "system", "alone")]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "conv_id long, turn long, role string, text string, place int, part string")
    got = {(r["conv_id"], r["assistant"], r["part"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "cy", 0), (None, "unknown", 0)}
    r = got[1, "ann", 0]
    assert r["text"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user:bob|>\n<|end|>\n<|user:cy|>\nlate<|end|>\n"
    a, b = map(int, r["mask"].split(":"))
    assert r["text"][a:b] == "hi" and r["n_turns"] == 4


def test_dialogue_without_numbers(spark):
    """One conversation without id and turn numbers: parts of bounded length, spans at the assistant's words."""
    df = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS conv_id", "CAST(NULL AS BIGINT) AS turn", "concat('p', id % 3) AS role", "concat('w', id, repeat('é', CAST(id % 5 AS INT))) AS text")
    out = chat.rotate(df).cache()
    assert out.groupBy("assistant").agg(F.sum("n_turns").alias("n"), F.max("n_turns").alias("m")).select("n", "m").distinct().collect() == [(20_000, 64)]
    assert out.count() == 3 * -(-20_000 // 64)
    said = sorted(r["text"][int(a):int(b)] for r in out.filter("assistant = 'p1'").collect() for a, b in (m.split(":") for m in r["mask"].split(",") if m))
    assert said == sorted(r["text"] for r in df.filter("role = 'p1'").collect())


@pytest.mark.parametrize("crowd", [1, 2, 2000])
def test_crowded_windows_compare_words(spark, crowd):
    """Words whose polynomial hashes are equal modulo 2**64 stay different words."""
    odd = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = odd.translate(str.maketrans("ab", "ba"))
    shared = [f"w{k}" for k in range(49)]
    texts = [" ".join([*shared, odd]), " ".join([*shared, other]), " ".join([*shared, other, "tail"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.deduplicate(df, crowd=crowd).collect()) == [(0, 0), (1, 0), (2, 50)]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    for out in (quality.quality_measures(none), language.predict(none, language.learn(none)), pii.find_spans(none), bpe.encode(none, VOCABULARY), sharding.shards(none, 10),
                simhash.near_duplicates(none), substrings.deduplicate(none), mixing.attach_plan(none, mixing.plan(none))):
        assert out.count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    vectors = mtree.integer_vectors(empty)
    assert mtree.top_k(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 5).count() == 0
    assert lexical.search(none, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert lexical.search(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert multiset.compare_with_next(none).count() == 0 and multiset.fingerprints(none).count() == 0 and fim.transform(none).count() == 0
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("crowd", [3, 256])
def test_near_copies(spark, crowd):
    r = random.Random(8)
    base = words(r, 120, 5000).split()
    texts = [None, "", "one two", "one two", "ONE two", "one three"]
    for k in range(60):  # from copies with one changed word to texts below the bound
        new = list(base)
        for _ in range(k % 9):
            new[r.randrange(120)] = f"new{r.randrange(5000)}"
        texts.append(" ".join(new))
    texts += [words(r, 30, 5000) for _ in range(10)]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if k == y else k for k in root]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, text string, n long")
    prints = copies.with_bands(df.select("id", "text"))
    labels = {x["id"]: x["label"] for x in copies.components(copies.meetings(prints), copies.with_set(df.select("id", "text")), crowd).collect()}
    assert [labels.get(i, i) for i in range(len(texts))] == root
    assert len(set(root)) < len(texts) - 20


def test_dedup_stage_uses_simhash_groups(spark, monkeypatch):
    """Texts that meet in no band are linked through their fingerprints, and only if their sets agree."""
    import corpus_pipeline as cp
    from pyspark.sql import functions as F
    monkeypatch.setattr(copies, "with_bands", lambda df, text="text": df.withColumn("bands", F.array().cast("array<bigint>")).drop(text))
    words = " ".join(f"w{i * 7919 % 1000}" for i in range(200))
    rows = [(1, words, "en", "a", 0), (2, words.upper(), "en", "a", 0), (3, "another text of a few words only", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(x["doc_id"] for x in cp.dedup_stage(spark, df, "").collect()) == [1, 3]


def test_dedup_stage_links_edited_copies(spark):
    import corpus_pipeline as cp
    r = random.Random(2)
    texts = []
    for _ in range(8):
        new = words(r, 150, 5000).split()
        texts.append(" ".join(new))
        for k in (20, 80, 130):  # three changed words: similarity 0.81
            new[k] = "edited"
        texts.append(" ".join(new))
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x["doc_id"] for x in cp.dedup_stage(spark, df, "").collect()) == list(range(0, 16, 2))
    assert cp.dedup_stage(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize(("sizes", "room"), [([100] * 1000 + [100_000], 60_000), ([100] * 63 + [100_000], 15_000), ([7] * 500 + [5] * 500, 3001)])
def test_block_is_filled_past_long_documents(sizes, room):
    for k in range(12):
        random.Random(k).shuffle(sizes)
        times = mixing.fill_block(sizes, room, 3)
        assert times.max() <= 3 and int(times @ np.array(sizes)) == room
    assert mixing.fill_block([100_000, *[100] * 1000], 60_000, 3).max() == 1


def test_mix_goes_on_to_later_blocks(spark):
    rows = [(i, "w " * 100, "a") for i in range(60)] + [(100 + i, "w " * 20, "b") for i in range(100)] + [(200, "w " * 5000, "b")] + [(300 + i, "w " * 100, "c") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    old = mixing.BLOCK_ROWS
    mixing.BLOCK_ROWS = 10
    try:
        for seed in range(3):
            got = mixing.attach_plan(df, mixing.plan(df, seed=seed)).select("row.source", "size", "target", F.size("takes").alias("n")).collect()
            assert max(r["n"] for r in got) <= 3
            for s in "abc":
                goal = next(r["target"] for r in got if r["source"] == s)
                assert 0 <= goal - sum(r["size"] * r["n"] for r in got if r["source"] == s) < 100
    finally:
        mixing.BLOCK_ROWS = old


def test_odd_fim(spark, odd):
    marked = odd.unionByName(odd.filter("doc_id = 4").withColumn("text", F.lit("has <S> inside"))).withColumn("output", F.lit(1)).withColumn("n", F.lit("x"))
    out = fim.transform(marked, rate=100).cache()
    assert out.count() == marked.count() and set(out.columns) == {*marked.columns, "form", "prefix_chars", "middle_chars"}
    assert {r["form"] for r in out.filter("coalesce(text, '') = '' OR text LIKE '%<S>%'").collect()} == {"plain"}
    assert out.filter("coalesce(text, '') <> '' AND text NOT LIKE '%<S>%' AND form = 'plain'").count() == 0
    back = out.filter(~fim.restored(F.col("output"), F.col("form")).eqNullSafe(F.coalesce("text", F.lit(""))))
    assert back.count() == 0
    assert out.filter("doc_id = 4 AND n <> 2 AND text = 'one two'").count() == 0
    long = spark.range(2).select("id", F.repeat(F.lit("ab \n"), 3_000_000).alias("text"))  # 12 MB, 3 million units
    got = fim.transform(long, key="id", rate=100)
    assert {(r["n"], r["ok"]) for r in got.select("n", (fim.restored(F.col("output"), F.col("form")) == F.col("text")).alias("ok")).collect()} == {(3_000_001, True)}


def test_odd_fingerprints(spark, odd):
    """Neighbours, order, insertion and deletion against plain Python."""
    none_last = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["h"], r["text"] or "") for r in odd.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    want = []
    for (key, _, text), (_, _, after) in zip(none_last, [*none_last[1:], none_last[0]], strict=True):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        want.append((None if key[0] else key[1], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in multiset.compare_with_next(odd).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert multiset.fingerprints(odd.withColumn("fingerprint", F.lit(1))).count() == odd.count()


def test_heavy_ids_are_cut(spark):
    """A third of the rows without an id and a third with one id: ranges stay even and the order whole."""
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "concat('t', id) AS text").cache()
    rows = multiset.ranges(df, "doc_id", "text").collect()
    real = [r for r in rows if not r["extra"]]
    assert len(real) == 3000 and max(Counter(r["slot"] for r in real).values()) < 1000
    order = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["h"], r["text"]) for r in df.withColumn("h", F.xxhash64("text")).collect())
    after = {a[2]: b[2] for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    for slot in {r["slot"] for r in rows}:
        run = [r["text"] for r in rows if r["slot"] == slot]
        assert all(after[a] == b for a, b in zip(run, run[1:]))


def test_fingerprints_add_up(spark):
    a, b = multiset.packed(multiset.vector(["one two", "three"])), multiset.packed(multiset.vector(["three", "one two"]))
    assert a == b != multiset.packed(multiset.vector(["one two three"]))
    assert multiset.deleted(multiset.inserted(a, ["four", "four"]), ["four"]) == multiset.packed(multiset.vector(["four", "one two", "three"]))
    docs = spark.createDataFrame([(1, "one two\nthree"), (2, "x"), (None, None)], "doc_id long, text string")
    edits = spark.createDataFrame([(1, "three", -1), (1, "new", 1), (3, "fresh", 1), (2, "x", 1)], "doc_id long, paragraph string, sign int")
    got = {r["doc_id"]: bytes(r["fingerprint"]) for r in multiset.updated(multiset.fingerprints(docs), edits).collect()}
    assert got == {1: multiset.packed(multiset.vector(["one two", "new"])), 2: multiset.packed(multiset.vector(["x", "x"])), 3: multiset.packed(multiset.vector(["fresh"])), None: multiset.packed(multiset.vector([""]))}
    assert multiset.likeness(multiset.unpacked(a), multiset.unpacked(a)) == 1.0


def brute_search(docs, items, k):
    term = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = [(i, Counter(x.translate(str.maketrans(lexical.UPPER, lexical.LOWER)) for x in term.findall(t or ""))) for i, t in docs]
    low = [(i, c) for i, c in low if c]
    n, total = len(low), sum(sum(c.values()) for _, c in low)
    df = Counter(x for _, c in low for x in c)
    out = []
    for item, text in items:
        asked = Counter(x.translate(str.maketrans(lexical.UPPER, lexical.LOWER)) for x in term.findall(text or ""))
        found = []
        for i, c in low:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10 ** 9 * c[x] // (1000 * c[x] + 8 * m)) for x, r in asked.items() if c[x])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_odd_search(spark, odd, block_bytes):
    items = [(1, "w1 W2 w3 w3"), (1, "w1 W2 w3 w3"), (2, None), (3, "!!"), (None, "é中😀 passage"), (4, "w5 unknownterm ONE"), (5, "z" * 300_000), (6, "K")]
    df = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, rank int, score int")
    got = [tuple(r) for r in lexical.search(odd.withColumn("score", F.lit("x")), df, 4, block_bytes=block_bytes).collect()]
    want = brute_search([(r["doc_id"], r["text"]) for r in odd.collect()], list(dict.fromkeys(items)), 4)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({r[0] for r in got}) >= 4
    same = spark.createDataFrame([(9, "w1"), (9, "w2 w1")], "item_id long, text string")  # texts of one item are read together
    one = spark.createDataFrame([(9, "w1 w2 w1")], "item_id long, text string")
    assert lexical.search(odd, same).collect() == lexical.search(odd, one).collect()


def test_stages_on_odd_rows(spark, odd):
    """NULLs, empty, repeated and very long rows and clashing columns through every stage, then empty tables."""
    import corpus_pipeline as cp
    long = odd.filter("doc_id = 6").withColumn("doc_id", F.lit(77).cast("long")).withColumn("lang", F.lit("en")).withColumn("text", F.repeat(F.lit("another word again.\n"), 300_000))  # 5 MB
    docs = odd.unionByName(long).withColumn("n_chars", F.length("text").cast("long")).withColumn("digest", F.lit("d")).withColumn("id", F.lit(1)).withColumn("k64", F.lit(2))
    kept = docs
    for name, stage in cp.STAGES:
        out = cp.store(stage(spark, kept, ""), "odd-stage")
        assert cp.store(stage(spark, kept.limit(0), ""), "odd-stage").count() == 0
        if name != "bpe":
            assert out.columns == list(cp.COLUMNS)
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "language_id":
            assert {77, 3, 4} <= ids and not {0, 1, 2} & ids
        if name == "near_dedup":
            assert out.count() == out.select('doc_id', 'text').distinct().count() and {77, 3, 4, 6} <= ids and not {11} & ids
        if name == "pii":
            assert out.filter("text LIKE '%[EMAIL]%'").count() == 1 and out.filter("n_chars <> length(text)").count() == 0
        kept = out
    assert kept.filter("NOT round_trip").count() == 0


def test_texts_of_one_number(spark):
    """Different texts whose 64-bit numbers are equal get different ones."""
    rows = spark.createDataFrame([(b"a", 5), (b"b", 5), (b"c", 6)], "digest binary, k64 long")
    got = {bytes(r["digest"]): r["id"] for r in copies.numbered(rows).collect()}
    assert got[b"a"] == 5 and got[b"c"] == 6 and len(set(got.values())) == 3


def test_long_repeats_beyond_the_kept_ranks():
    """Common prefixes of more than 127 words, which the kept ranks cannot tell apart, against word by word comparison."""
    r = np.random.default_rng(6)
    for _ in range(20):
        block = r.integers(0, 30, int(r.integers(120, 300)))
        docs = [np.concatenate([block, r.integers(0, 3, 50), block, block[:200]]), np.zeros(int(r.integers(1, 500)), np.int64), r.integers(0, 2, 40)]
        counts = np.array([len(d) for d in docs])
        codes = np.concatenate([d + 100 * i for i, d in enumerate(docs)])
        ends = np.repeat(np.cumsum(counts), counts)
        order, levels = suffixes.suffix_array(codes, ends, keep=quality.KEEP)
        assert max(k for k, _ in levels) <= quality.KEEP
        at, lcp = suffixes.neighbour_lcp(order, ends, levels, 5)
        lcp = suffixes.lengthen(lcp, order[at], order[at + 1], codes, ends, sum(k for k, _ in levels))
        got = dict(zip(at.tolist(), lcp.tolist()))
        for p, (i, j) in enumerate(zip(order[:-1].tolist(), order[1:].tolist())):
            n = 0
            while i + n < ends[i] and j + n < ends[j] and codes[i + n] == codes[j + n]:
                n += 1
            assert got.get(p, 0) == (n if n >= 5 else 0)


def test_subsets_and_blocks_leave_nothing_that_fits():
    r = random.Random(5)
    for _ in range(60):
        sizes = [r.choice([1, 3, 40, 7000, 100_000]) * r.randint(1, 9) for _ in range(r.randint(1, 12))]
        room = r.randint(0, sum(sizes) * 3)
        best = max((sum(c) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= room), default=0)
        got = sum(sizes[k] for k in mixing.best_subset(sizes, room))
        assert got <= room and best - got <= (room // mixing.CELLS) * len(sizes)
        times = mixing.fill_block(sizes, room, 2)
        left = room - int(times @ np.array(sizes))
        assert left >= 0 and times.max() <= 2 and all(w > left for w, t in zip(sizes, times, strict=True) if t < 2)


def test_targets_against_halving():
    r = random.Random(6)
    for _ in range(100):
        sizes = [r.choice([0, r.randint(1, 50), r.randint(1, 10**6)]) for _ in range(r.randint(1, 9))]
        weights = [1.0 + k % 3 for k in range(len(sizes))]
        assert mixing.targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights), rel=1e-6, abs=1e-3)


@pytest.mark.parametrize("block_rows", [1, 4, 1000])
def test_mix_misses_by_less_than_a_document_left(spark, block_rows, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block_rows)
    r = random.Random(block_rows)
    rows = [(i if i % 17 else None, "w " * r.choice([3, 10, 90, 400, 5000]), r.choice(["a", "a", "b", "c", None])) for i in range(150)] + [(7, "w " * 30, "a")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.attach_plan(df, mixing.plan(df, seed=block_rows)).select("row.doc_id", "row.text", "row.source", "size", "source_size", "target", F.size("takes").alias("n")).collect()
    assert len(got) == len(rows) and max(x["n"] for x in got) <= 3
    names = ["a", "b", "c", None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == name) for name in names]
    for name, size, goal in zip(names, sizes, brute_targets(sizes, [1.0, 2.0, 3.0, 1.0]), strict=True):
        mine = [x for x in got if x["source"] == name]
        assert all(x["source_size"] == size and x["target"] == pytest.approx(goal) for x in mine)
        units = defaultdict(int)  # equal rows are decided together
        for x in mine:
            units[x["doc_id"], x["text"], x["n"]] += x["size"]
        left = goal - sum(x["size"] * x["n"] for x in mine)
        assert -0.5 <= left
        assert all(w > left - 0.5 for (_, _, n), w in units.items() if n < 3)


def test_masked_against_brute_force(spark):
    r = random.Random(8)
    names = [k.name for k in pii.KINDS]
    signs = {k.name: k.sign for k in pii.KINDS}
    rows = []
    for n in [0, 1, 2, 255, 256, 257, 700, *[r.randint(1, 40) for _ in range(60)]]:
        text = "".join(r.choice("ab é\U0001f600") for _ in range(4 * n + r.randint(1, 30)))
        spans = []
        for _ in range(n):
            at = r.randrange(len(text))
            spans.append((r.choice(names), at, min(len(text), at + r.randint(1, 9))))
        rows.append((text, sorted(spans, key=lambda s: (s[1], s[0]))))
    df = spark.createDataFrame(rows, "text string, spans array<struct<kind: string, start: int, end: int>>")
    for x in df.withColumn("m", pii.masked(F.col("text"), F.col("spans"))).collect():
        assert x["m"] == brute_masked(x["text"], x["spans"], signs)


def test_masked_many_spans_in_a_long_text(spark):
    text = "write to a@b.cd or +1 555 123 4567, " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.find_spans(df).select(pii.masked(F.col("text"), F.col("spans")).alias("m"))
    assert found.first()["m"] == "write to [EMAIL] or [PHONE], " * 20_000


def test_a_task_holds_one_batch_of_texts():
    """The batch before is gone when the next one is read."""
    import weakref

    import pyarrow as pa

    from pointlake.llm.common import text_slices
    alive = []

    def batches():
        for k in range(4):
            assert all(ref() is None for ref in alive)
            batch = pa.RecordBatch.from_pydict({"text": [f"{k} words here"] * 30})
            alive.append(weakref.ref(batch))
            yield batch
            del batch

    n = 0
    for piece, texts in text_slices(batches(), limit=1000):
        n += len(texts)
        del piece, texts
    assert n == 120


def test_common_pieces_stay_in_a_full_cache():
    """Pieces that keep coming are merged once, however many rare ones pass between them."""
    vocabulary = bpe.Vocabulary(open(VOCABULARY, "rb").read())
    asked, merge = Counter(), vocabulary.merge
    vocabulary.merge = lambda piece: asked.update([piece]) or merge(piece)
    cache = bpe.PieceCache(vocabulary, 8)
    common = [" the", " of"]
    for k in range(100):
        for piece in [*common, f" rare{k}"]:
            assert cache[piece] == np.array(merge(piece.encode()), "<u4").tobytes()
    assert [asked[p.encode()] for p in common] == [1, 1]
    assert len(cache) + len(cache.old) <= 8


def test_merges_follow_rank_then_position():
    """Ids against a plain search for the best pair, for pieces of any length."""
    vocabulary = bpe.Vocabulary(open(VOCABULARY, "rb").read())
    pairs, ids = vocabulary.pairs, vocabulary.ids
    ranks = {(ids[a], ids[b]): (k, ids[a + b]) for k, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in pairs)}
    r = random.Random(5)
    for n in [0, 1, 2, 3, 7, 15, 16, 17, 40, 130, *[r.randint(1, 30) for _ in range(200)]]:
        piece = "".join(r.choice("etaoinshr é") for _ in range(n)).encode()
        want = [vocabulary.symbol[b] for b in piece]
        while best := min(((*ranks[p], i) for i, p in enumerate(zip(want, want[1:])) if p in ranks), key=lambda x: (x[0], x[2]), default=None):
            want[best[2]:best[2] + 2] = [best[1]]
        assert vocabulary.merge(piece) == want


def test_dedup_runs_one_python_worker_at_a_time(spark, monkeypatch):
    """Two passes of Python in one stage would hold two workers per task."""
    from pyspark.sql import functions as F
    plans, store = {}, copies.store
    monkeypatch.setattr(copies, "store", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and store(df, name))
    df = spark.createDataFrame([(k, f"one two three four five {k % 3}") for k in range(9)], "doc_id bigint, text string").withColumn("n", F.lit(1))
    assert copies.one_of_each(df).count() == 3
    assert "copy-prints" in plans and all(plan.split("Exchange")[k].count("MapInArrow") <= 1 for plan in plans.values() for k in range(plan.count("Exchange") + 1))
