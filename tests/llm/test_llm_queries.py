"""The registered queries against SQL or a brute-force version, over the whole small tables."""

import functools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import check
from pointlake.llm import fim, language, mixing, multiset, queries
from tests_llm_brute import WORDS, brute_components, brute_copies, brute_dedup, brute_languages, brute_print, sha

@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def by_id(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    res = check.connect(sf).execute(queries.ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(names, res.fetchall())


def test_substring_dedup(spark, sf, docs):
    got = by_id(spark, sf, "op2_substring_dedup")
    want = brute_dedup([(r["doc_id"], r["text"]) for r in docs])
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.values()) == sorted(want)
    assert sum(w[2] > 0 for w in want) > 5


def test_language_against_brute_force(spark, sf, docs):
    got = by_id(spark, sf, "op3_language_id")
    vector = functools.cache(lambda cp: language.letter_vectors(np.array([cp]), language.DIM)[0].astype(float))
    train = [(r["text"], r["lang"]) for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    for r, (lang, score, lead) in zip(docs, brute_languages(train, [r["text"] for r in docs], vector), strict=True):
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(score, abs=1e-5)
        assert g["lang_pred"] == lang or lead < 1e-5


def test_language_id(spark, sf, docs):
    got = by_id(spark, sf, "op3_language_id")
    right = []
    for r in docs:
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= g["score"] <= 1
        if g["held_out"] and len(r["text"] or "") > 100:
            right.append(g["lang_pred"] == r["lang"])
    assert np.mean(right) > 0.95


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in twice) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute_spans(text):
    return [(m.start(), k, m.end(), kind) for k, (kind, rx) in enumerate(BASE.items()) for m in re.finditer(rx, text or "") if holds(kind, m.group())]


def test_pii_spans(spark, sf, docs):
    got = by_id(spark, sf, "op5_pii_spans")
    for r in docs:
        want, g = sorted(brute_spans(r["text"])), got[r["doc_id"]]
        text = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert g["base_sha256"] == sha(text)
        counts = Counter(w[3] for w in want)
        assert [g[f"n_{k}"] for k in BASE] == [counts[k] for k in BASE]
        assert set(text.split(",")) - {""} <= set(g["spans"].split(","))


def test_simhash_groups(spark, sf, docs):
    got = by_id(spark, sf, "op6_simhash_groups")
    prints = {r["doc_id"]: brute_print(r["text"]) for r in docs}
    assert {i: g["fingerprint"] for i, g in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: g["component_id"] for i, g in got.items()} == brute_components(prints)


def test_bpe_round_trip(spark, sf, docs):
    got = by_id(spark, sf, "op8_bpe_round_trip")
    tokenizer = Tokenizer.from_file(str(queries.VOCABULARY))
    for r in docs:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert g["decoded_sha256"] == sha(tokenizer.decode(ids, skip_special_tokens=False))


def brute_quality(text):
    words, lines = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    marked = {i + j for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for j in range(5)}
    longest, cover = 0, set()
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            n = 0
            while j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            longest = max(longest, n if n >= 5 else 0)
            if n >= 10:
                cover |= set(range(i, i + n)) | set(range(j, j + n))
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked), len(cover), longest)


def test_suffix_quality(spark, sf, docs):
    got = by_id(spark, sf, "op9_suffix_quality")
    for r in docs:
        if len(r["text"] or "") < 6000:
            g = got[r["doc_id"]]
            want = brute_quality(r["text"])
            assert tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")) == want
            assert g["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (g["kept"] and g["base_failed"])


def test_source_mix(spark, sf, docs):
    got = by_id(spark, sf, "op10_source_mix")
    again = by_id(spark, sf, "op10_source_mix")
    assert got == again
    sizes = defaultdict(int)
    for r in docs:
        assert got[r["doc_id"]]["size"] == len(WORDS.findall(r["text"] or ""))
        sizes[r["source"]] += got[r["doc_id"]]["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[n] for n in names], [1.0 + k % 3 for k in range(len(names))]), strict=True))
    taken = defaultdict(int)
    for r in docs:
        g = got[r["doc_id"]]
        assert g["source_size"] == sizes[r["source"]] and g["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= g["taken"] <= 3 * g["size"] and g["taken"] % max(g["size"], 1) == 0
        taken[r["source"]] += g["taken"]
    for n in names:
        assert abs(taken[n] - goal[n]) <= 0.05 * goal[n]


def test_multiset_fingerprint(spark, sf, docs):
    got = by_id(spark, sf, "op11_multiset_fingerprint")
    texts = [r["text"] or "" for r in sorted(docs, key=lambda r: r["doc_id"])]
    near, other = [], []
    for i, text, after in zip(sorted(got), texts, [*texts[1:], texts[0]], strict=True):
        g, half = got[i], len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), sha(edited))
        for t, name in ((text, "fingerprint"), (edited, "edited_fingerprint")):
            assert g[name] == multiset.packed(multiset.vector(t.split("\n"))).hex()
        if len(text) >= 300:
            near.append(g["near_edited"])
            other.append(g["near_next"])
    assert np.quantile(near, 0.02) > 0.2 and np.mean(near) > 0.4 and np.mean(other) < 0.1
    assert len({g["fingerprint"] for g in got.values()}) == len({tuple(sorted(t.split("\n"))) for t in texts})


def test_fim_units(spark, sf, docs):
    """Cuts fall between units, and the parts make up the text."""
    rows = fim.transform(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert Counter(r["form"] for r in rows).keys() == {"plain", "spm", "psm"}
    for r in rows:
        units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", r["text"] or "")
        assert r["n"] == len(units)
        if r["form"] != "plain":
            ends = {0, *np.cumsum([len(u) for u in units]).tolist()}
            assert r["prefix_chars"] in ends and r["prefix_chars"] + r["middle_chars"] in ends


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline as cp
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.language_stage(spark, table, sf)
    assert kept.columns == table.columns
    assert kept.count() >= 0.99 * len(docs)
    single = cp.store(cp.dedup_stage(spark, kept, sf), "t")
    assert {r["doc_id"] for r in single.collect()} == set(brute_copies({r["doc_id"]: r["text"] for r in kept.collect()}).values())
    clean = cp.store(cp.pii_stage(spark, single, sf), "t")
    assert clean.columns == table.columns
    for r in clean.collect():
        assert not brute_spans(r["text"])
        assert r["n_chars"] == len(r["text"])
    mixed = cp.store(cp.mix_stage(spark, clean, sf), "t")
    assert mixed.columns == table.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 3
    tokens = cp.tokens_stage(spark, mixed, sf).collect()
    assert len(tokens) == sum(copies.values()) and all(t["round_trip"] for t in tokens)
