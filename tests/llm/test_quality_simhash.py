import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_fixtures import SF001, messy, nothing, random_words  # noqa: F401
from pyspark.sql import functions as F

from prefmine.llm import queries, quality, simhash
from prefmine.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The base columns, word by word."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_base_columns_equal_brute_force(messy):
    for r in quality.line_first_quality(messy).collect():
        want = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and (not r.kept or not failed)


def test_op5_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = queries.op5_line_quality(spark, SF001).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(docs[r.doc_id])


def test_labelled_quality_is_recovered(spark):
    labels = spark.read.parquet(f"{SF001.replace('0.001', '0.01')}/labels.parquet")
    kept = queries.op5_line_quality(spark, SF001.replace("0.001", "0.01")).join(labels, "doc_id").where("NOT base_failed")
    right = kept.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.97


@pytest.mark.parametrize("line, rule", [
    ("A plain sentence ends here.", None), ("She said “stop!”", None), ("Is it 漢字。", None), ("no end at all", "punctuation"),
    ("One ends here. The next breaks off", None), ("word*** other### more&&&.", "punctuation"), ("GO!! NOW!! BUY!!", "punctuation"),
    ("Home | About | Contact | Login", "navigation"), ("« Previous", "navigation"), ("Please enable JavaScript to go on.", "boilerplate"),
    ("Released under the MIT License.", "boilerplate"), ("Licensed under CC BY-NC 4.0.", "boilerplate"), ("Alle Rechte vorbehalten.", "boilerplate"),
    ("Tous droits réservés.", "boilerplate"), ("Wir verwenden Cookies.", "boilerplate"), ("The film was released under another name.", None),
    ("A good line." + " " * 70, None), ("A good line.”)" + "\t" * 300, None), ("word. " * 80 + "All rights reserved.", None),
    ("All rights reserved by us and " + "so on and " * 30 + "so forth.", "boilerplate"), ("An end? " + "not " * 90, None), ("'”", "punctuation"),
    ("We tell. " * 30 + "See our privacy policy.", None),
    ("All rights reserved.", "boilerplate"), ("Lorem ipsum dolor sit amet.", "boilerplate")])
def test_line_rules(line, rule):
    assert quality.line_fails(line, len(line.split()), quality.Rules()) == rule


def test_failing_lines_are_removed(spark):
    good = "This line has ten words and ends as it should."
    df = spark.createDataFrame([(1, f"{good}\nHome | Login\n\n{good[::-1]}.\nMore of it here, some words more."),
                                (2, f"{good}\nno end at all here\nnor any here in this\nor here")], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.line_first_quality(df, clean="clean").collect()}
    assert rows[1].kept and "Home" not in rows[1].clean and good in rows[1].clean
    assert not rows[2].kept and rows[2].lost_words == 12


def test_repeats_in_many_words():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 40000, 60000)  # 40000^5 does not fit a long: codes are renumbered
    ids[50000:50007] = ids[:7]
    assert quality.repeated_words(ids, 40000) == 14


def test_empty_tables(nothing):
    assert quality.line_first_quality(nothing).count() == 0
    assert simhash.one_of_each(nothing).count() == 0


def brute_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, k):
    """prints: list of (id, fingerprint); smallest id reachable, by full comparison."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    f = np.array([p for _, p in prints], np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= k):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(prints))]


def test_fingerprints_equal_brute_force(messy):
    for r in simhash.with_fingerprint(messy).collect():
        if len(r.text or "") < 10**5:
            assert r.fingerprint % (1 << 64) == brute_print(r.text), r.text


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(random_words(random.Random(1), 3000))
    cut = simhash.pieces
    monkeypatch.setattr(simhash, "pieces", lambda t: cut(t, 50))
    assert simhash.fingerprint(text) == brute_print(text)
    assert simhash.fingerprint("one two") == brute_print("one two")


def cluster_prints(seed, k):
    """Chains and balls of near fingerprints, one ball wide enough to fill variants."""
    rng = random.Random(seed)
    out = []
    for size, flips in ((1, 0), (40, 1), (12, 2), (200, 3)):
        at = rng.getrandbits(64)
        for _ in range(size):
            for _ in range(rng.randint(0, flips)):
                at ^= 1 << rng.randrange(64)
            out.append(at)
    out += [rng.getrandbits(64) for _ in range(100)] + out[:30]
    centre = rng.getrandbits(32) << 32
    out += [centre | x for x in rng.sample(range(1 << 16), 150)]
    rng.shuffle(out)
    return [(None if i % 37 == 0 else i, p) for i, p in enumerate(out)]


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("wide", [2, 64])
def test_components_equal_brute_force(spark, k, wide, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (wide,))
    prints = cluster_prints(k, k)
    signed = [(d, p - (1 << 64) if p >> 63 else p) for d, p in prints]
    df = Scratch(spark, "t").write(spark.createDataFrame(signed, "doc_id long, fingerprint long"))
    got = {r.fingerprint: r.component_id for r in simhash.near_duplicates(df, k).collect()}
    assert [got[p] for _, p in signed] == brute_components(prints, k)


def test_every_close_pair_shares_a_variant():
    rng = random.Random(2)
    for k in (1, 2, 3, 4, 5):
        cuts = simhash._segments(k)
        assert sum(w for _, w in cuts) == 64
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), k))
            assert min((diff >> s & (1 << w) - 1).bit_count() for s, w in cuts) <= 1


def test_one_of_each_keeps_one_row_of_a_component(messy):
    kept = simhash.one_of_each(messy).collect()
    rows = [(r.doc_id, brute_print(r.text)) for r in messy.collect() if len(r.text or "") < 10**5]
    want = Counter(brute_components(rows, 2))
    got = Counter(r.doc_id for r in kept if len(r.text or "") < 10**5)
    assert all(n == 1 for n in got.values()) or got[30] == 2  # id 30 names two texts
    assert set(got) == set(want) and sum(got.values()) == len({(brute_components(rows, 2)[i]) for i in range(len(rows))}) + (got[30] - 1)


def test_one_of_each_tells_rows_of_equal_hash_apart(spark, tmp_dir, monkeypatch):
    """All rows hash alike here: what is kept follows the components all the same.  Repeated rows, and rows that
    differ in a map column alone, leave one."""
    far = ["one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black pink", None, "", "a b c"]
    rows = [(i, t, {"k": str(i)}, i, "f") for i, t in enumerate(far)] * 3 + [(2, far[2], {"k": "other"}, 2, "f"), (None, "no id at all in this row", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,string>, index_ long, file_ string")
    docs.repartition(3).write.parquet(f"{tmp_dir}/docs")
    monkeypatch.setattr(simhash.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    for table in (docs, spark.read.parquet(f"{tmp_dir}/docs"), spark.read.parquet(f"{tmp_dir}/docs").where("doc_id IS NULL OR doc_id < 100")):
        kept = simhash.one_of_each(table)
        assert kept.columns == docs.columns
        kept = kept.collect()
        prints = [(-1 if r[0] is None else r[0], brute_print(r[1])) for r in rows]
        assert len(kept) == len(set(brute_components(prints, 2)))
        texts = sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None)
        assert texts == [(0, far[0]), (1, far[1]), (2, far[2]), (3, None), (5, far[5])]


def test_op9_contract(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SF001).collect()}
    prints = [(d.doc_id, brute_print(d.text)) for d in docs]
    for (i, p), c in zip(prints, brute_components(prints, 2)):
        assert got[i] == (f"{p:016x}", c)
