"""Source divergence, spelling variants and decontamination against plain loops."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontam, divergence, registry, variants
from tests.conftest import SF
from tests.llm.test_llm import DOCS, ODD


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeats, and columns with clashing names."""
    clash = ("n_words", "n_hit", "items", "row", "word", "n", "form", "root", "key", "side", "digest", "split", "term", "place", "p", "q", "rank", "value", "part", "item")
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(7) for c in clash})


# Source divergence


def audited(df, **how):
    return sorted(tuple(r) for r in divergence.audit(df, **how).collect())


def test_divergence_splits_terms_that_share_a_digest_and_blocks_of_sources(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = audited(docs, least=2)
    assert {r[2] for r in plain} == {"pair", "term"}
    assert audited(docs, least=2, bits=3, buckets=3) == plain  # at most eight digests for thousands of terms
    assert audited(docs, least=2, wide=3, buckets=5) == plain


def test_divergence_by_loops(spark):
    random.seed(5)
    rows = [(k, " ".join(random.choice(["Über", "a1b", "the", "of-x", "ÄÖ", "zz"]) for _ in range(random.randint(0, 9))), random.choice(["en", None]), random.choice(["s", "t", None, "u"]), 1) for k in range(60)]
    got = audited(spark.createDataFrame(rows, DOCS).repartition(3), least=3, top=4)
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) for _, text, lang, source, _ in rows]
    want = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = {t for d in mine for t in d[2] if sum(t in x[2] for x in mine) >= 3}
        count = {s: Counter(t for d in mine if s in (d[1], None) or s == "all" for t in d[2] if t in kept) for s in {d[1] for d in mine} | {"all"}}
        prob = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in count.items()}
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s in set(count) - {"all"}:
            pair = sorted((-sum(apart(prob[s][t], prob[o][t]) for t in kept), o) for o in set(count) - {"all", s})
            term = sorted((-apart(prob[s][t], prob["all"][t]), t.encode()) for t in kept if count[s][t] and prob[s][t] > prob["all"][t])[:4]
            want += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(pair)] + [(lang, s, "term", o.decode(), -v, k + 1) for k, (v, o) in enumerate(term)]
    assert got == sorted(want)


def test_divergence_edges(spark, odd):
    rows = audited(odd)
    assert ("", "", "pair") not in {r[:3] for r in rows}  # the only group of its language
    assert [r for r in rows if r[:2] == ("en", "")] == [("en", "", "pair", "s", 0, 1)]
    assert audited(odd.limit(0)) == []


# Spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(rows):
    """All of the contract by plain loops; words meet through patterns with one gap."""
    seen = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            seen[w] += len(w) >= 7
    seen = {w: n for w, n in seen.items() if n >= 2}
    gaps = defaultdict(set)
    shapes = {w: {w[:k] + "*" + w[k + 1 :] for k in range(len(w))} | {w[:k] + "*" + w[k:] for k in range(len(w) + 1)} for w in seen}
    for w, own in shapes.items():
        for g in own:
            gaps[g].add(w)
    near = {w: {x for g in own for x in gaps[g] if one_edit(w, x)} for w, own in shapes.items()}
    best = {w: min(o, key=lambda x: (-seen[x], x)) for w, o in near.items() if o}
    form = {w: b for w, b in best.items() if seen[b] >= 10 * seen[w]}
    out = set()
    for w in seen:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, seen[w], len(near[w]), seen.get(form.get(w))))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("most", [variants.CELL, 7])
def test_variants_by_loops(spark, most):
    random.seed(most)
    base = ["".join(random.choice("abcßÀé") for _ in range(random.randint(6, 9))) for _ in range(40)]
    rows = [(d, " ".join(random.choice(base[:3] if random.random() < 0.5 else base) for _ in range(80)) + random.choice(["", " " + "x" * 3000, " × ÷ aÿāb"])) for d in range(60)]
    rows += [(None, None), (None, "aaaaaaaaa bbbbbbbb"), (5, ""), rows[0]]
    got = variants.group(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), most=most).select(*COLUMNS)
    assert {tuple(r) for r in got.collect()} == grouped(rows)


def test_variants_query_by_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = registry.op12_spelling_variants(spark, SF)
    assert got.columns == COLUMNS
    want = grouped([tuple(r) for r in docs])
    assert {tuple(r) for r in got.collect()} == want and any(r[1] for r in want)


def test_variants_edges(spark, odd):
    assert variants.group(odd).collect() == [] == variants.group(odd.limit(0)).collect()
    long = spark.createDataFrame([(1, "q" * 70000), (1, "q" * 70000), (2, "q" * 69999), (2, "q" * 69999), (3, "q" * 69998 + "p"), (3, "q" * 69998 + "p")], "doc_id long, text string")
    assert sorted(r["n_near"] for r in variants.group(long).collect()) == [1, 1, 2]


def test_chains_of_forms_end_at_the_last_word(spark):
    counted = spark.createDataFrame([("aaaaaaaa", 10**6), ("aaaaaaab", 10**5), ("aaaaaabb", 10**4), ("aaaaabbb", 1000), ("aaaabbbb", 100), ("aaabbbbb", 10)], "word string, n long")
    letters = variants.Letters(variants.letter_groups(counted))
    rows = {r["word"]: r for r in variants.forms(counted, variants.links(counted, letters)).collect()}
    assert [rows[w]["form"] for w in ("aaabbbbb", "aaaabbbb", "aaaaaaaa")] == ["aaaabbbb", "aaaaabbb", None]
    assert rows["aaaaabbb"]["n_near"] == 2 and rows["aaaaabbb"]["form_n"] == 10**4


# Decontamination


def hits(docs, items, window):
    """Hit words and items of every text, by comparing windows as tuples."""
    out = []
    for doc in docs:
        dw, hit, found = decontam.words(doc), set(), set()
        for item, text in items:
            tw = decontam.words(text)
            w = min(window, len(tw))
            wins = {tuple(tw[k : k + w]) for k in range(len(tw) - w + 1)} if tw else set()
            for k in range(len(dw) - w + 1):
                if tuple(dw[k : k + w]) in wins:
                    hit |= set(range(k, k + w))
                    found.add(item)
        out.append((len(dw), len(hit), sorted(found)))
    return out


def test_suffix_arrays_by_loops():
    random.seed(1)
    for _ in range(150):
        window, letters = random.choice([2, 3, 10]), random.choice(["ab", "abc", "abcdefXYZ09"])
        mk = lambda n: " ".join(random.choice(letters) for _ in range(n))  # noqa: B023, E731
        items = [(str(i), mk(random.choice([0, 1, 2, 5, 12, 30]))) for i in range(random.randint(0, 6))]
        docs = [mk(random.choice([0, 1, 3, 20, 60])) + (" ? " + random.choice(items)[1] + " u " + mk(3) if items else "") for _ in range(random.randint(1, 8))]
        block = decontam.Benchmark(items, window)
        shard = decontam._Shard([decontam.words(d) for d in docs])
        n, found = decontam._judged(shard, [block])
        assert [(s, h, sorted(x)) for s, h, x in zip(shard.size.tolist(), n.tolist(), found)] == hits(docs, items, window)
        if not block.top:
            continue
        order, _, _, length, low, high = block.find(shard.ids(block))
        flat, name = [w for d in docs for w in (*decontam.words(d), None)], {v: k for k, v in block.number.items()}
        for j in range(len(block.place)):
            want = [name[x] for x in block.ids[block.place[j] : block.place[j] + block.length[j]].tolist()]
            met = [next((k for k, w in enumerate(want) if p + k >= len(flat) or flat[p + k] != w), len(want)) for p in range(len(flat))]
            most = max(met) if max(met) >= block.width[j] else 0
            assert length[j] == most
            if most:
                assert sorted(order[low[j] : high[j]].tolist()) == [p for p, m in enumerate(met) if m == most]


def test_decontamination_removes_and_tells_places(spark, monkeypatch):
    passage = [f"w{k}" for k in range(30)]
    items = [("7", " ".join(passage)), ("8", "Short one."), ("9", None), (None, " ".join(passage[5:25])), ("7", "zeta eta")]
    docs = [(1, "x y " + " ".join(passage[3:20]) + " end"), (2, "a SHORT, one"), (3, None), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (1, "clean"), (5, "so " + " ".join(passage).upper()), (6, "zeta  eta"), (None, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("kept")).repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string")
    want = sorted((i if i is not None else -1, *h) for (i, _), h in zip(docs, hits([t for _, t in docs], [(i or "", t) for i, t in items], 10)))
    for chars in (decontam.BLOCK, 40):  # one block of the benchmark, or many
        monkeypatch.setattr(decontam, "BLOCK", chars)
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], r["items"]) for r in decontam.scan(d, b).collect())
        assert got == want
    left = decontam.remove(d, b)
    assert left.columns == d.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3", "4", "None"]
    places = {(r["item_id"], r["n_words"], r["item_start"], r["doc_id"], r["doc_start"]) for r in decontam.longest(d, b).collect()}
    assert places == {("7", 30, 0, 5, 1), ("8", 2, 0, 2, 1), ("", 20, 0, 5, 6)}


def test_decontamination_edges(spark, odd):
    b = spark.createDataFrame([("1", "a b c"), ("2", "")], "item_id string, text string")
    got = decontam.scan(odd, b).collect()
    assert len(got) == len(ODD) and sum(r["n_hit"] for r in got) == 3
    assert decontam.remove(odd, b).columns == odd.columns and decontam.remove(odd, b).count() == len(ODD) - 1
    assert decontam.scan(odd, b.limit(0)).where("n_hit > 0").count() == decontam.scan(odd.limit(0), b).count() == decontam.longest(odd, b.limit(0)).count() == 0
    assert not np.any(decontam.Benchmark([], 10).find(np.zeros(3, dtype=np.int32))[1])
