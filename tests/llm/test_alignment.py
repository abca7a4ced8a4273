import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import SF001, messy, nothing, texts  # noqa: F401
from pyspark.sql import functions as F

from prefmine.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["a▁b", "<0x41>", "<s>x</s>", "<|endoftext|> a", "<unk>", "\x00\x01", "é́ å", "日本語テキスト", "🙂🙃👩‍👩‍👧", "  x\u0085y\x1c z", "  two  spaces   ",
        "١٢٣ 123456789", "don't I'LL we've", "a" * 3000, "ab" * 900, "=" * 500 + "\n" * 70, " ", "\n", "x\r\n\r\n\ty", "ǅ ǈ ɏ ˀ", "½ ² ª º", "ﬁ ﷺ", "﻿x"]


def brute(values):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, by sets of offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: bytes([x]) for c, x in alignment.byte_letters().items()}
    name = {i: b"".join(letters[c] for c in w) if w != "<|endoftext|>" else w.encode() for w, i in a.get_vocab().items()}
    docs, held = [], Counter()
    for t in values:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        bx, by = [name[i] for i in x], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or b"".join(bx) != (" " + t).encode() or b"".join(by) != (" " + t).encode():
            docs.append([])
            continue
        ends = [{int(e): i for i, e in enumerate(np.cumsum([len(p) for p in q]))} for q in (bx, by)]
        groups, fa, fb = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            groups.append((x[fa : ends[0][e] + 1], y[fb : ends[1][e] + 1]))
            fa, fb = ends[0][e] + 1, ends[1][e] + 1
        docs.append(groups)
        held.update({(p, q) for g in groups for p in g[0] for q in g[1]})
    most = defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    out = []
    for groups in docs:
        links = Counter()
        for g in groups:
            for p, m in Counter(g[0]).items():
                for q, n in Counter(g[1]).items():
                    links[p, q] += m * n
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
                    sum(n for k, n in links.items() if held[k] == most[k[0]]), sum(n * held[k] for k, n in links.items()), text))
    return out, held


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def collected(df, name="doc_id"):
    return sorted(((r[name], *[r[c] for c in COLUMNS]) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(0)
    values = HARD + texts(60) + ["".join(rng.choice(HARD)[:40] for _ in range(rng.randint(1, 12))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(3)
    want, held = brute(values)
    for sizes in ({}, {"chunk_bytes": 300, "block_links": 200}):
        docs, pairs = alignment.align(df, A, B, **sizes)
        assert collected(docs) == sorted([(i, *w) for i, w in enumerate(want)], key=str)
        assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(held)
    assert sum(w[0] == 0 for w in want) >= 4  # null, empty, U+2581


def test_both_byte_level_ways_agree():
    """Plain texts are cut by ranks; the file's own library must give the same ids."""
    own = alignment.ByteLevel(A)
    assert own.fast is not None
    rng = random.Random(1)
    plain = [chr(c) for c in range(0x250) if alignment.PLAIN.fullmatch(chr(c))]
    words = ["'s", "'LL", "'ve", " ", "  ", "\n", "\t", "\r\n", "the", " of", "123", "...", "###", "<|endoftext|>"]
    values = ["".join(rng.choice(words) if rng.random() < 0.5 else rng.choice(plain[:100] if rng.random() < 0.7 else plain)
                      for _ in range(rng.randint(1, 60))) for _ in range(20000)]
    values += [a + b for a in plain for b in (" ", "a", "1", "!")] + [c * 70 for c in plain]
    assert all(alignment.PLAIN.fullmatch(v) for v in values)
    assert own.encode(values) == [e.ids for e in own.tokenizer.encode_batch(values, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(6))
def test_shared_cuts(seed):
    rng = np.random.default_rng(seed)
    ends, last, at = [[], []], [], 0
    for _ in range(rng.integers(1, 30)):
        n = int(rng.integers(1, 400))
        share = rng.choice([0.01, 0.3, 0.9])
        for own in ends:
            own += (at + 1 + np.flatnonzero(rng.random(n - 1) < share)).tolist() + [at + n]
        at += n
        last.append(len(ends[0]) - 1)
    a, b = (np.array(e, np.int64) for e in ends)
    cuts = alignment.shared_cuts(a, b, np.array(last))
    common = sorted(set(ends[0]) & set(ends[1]))
    assert a[cuts[0]].tolist() == common and b[cuts[1]].tolist() == common


def test_a_long_interval_without_a_cut():
    a, b = np.append(np.arange(2, 400_000, 4), 400_000), np.append(np.arange(3, 400_000, 4), 400_000)
    b[5000], b[5000 - 1] = a[5000], a[5000] - 1
    cuts = alignment.shared_cuts(a, b, np.array([len(a) - 1]))
    assert a[cuts[0]].tolist() == [a[5000], 400_000]


def test_messy_and_empty_tables(spark, messy, nothing):
    values = [r.text for r in messy.collect()]
    docs, _ = alignment.align(messy, A, B)
    assert docs.columns == [c for c in messy.columns if c != "text"] + COLUMNS
    want, _ = brute(values)
    assert collected(docs) == sorted([(r.doc_id, *w) for r, w in zip(messy.collect(), want)], key=str)
    docs, pairs = alignment.align(nothing, A, B)
    assert docs.count() == 0 and pairs.count() == 0
    clash = messy.select("doc_id", "text", F.lit(1).alias("block"), F.lit("p").alias("pairs"), F.lit("x").alias("rest"), F.lit(2).alias("n_a"))
    docs, _ = alignment.align(clash, A, B)
    assert docs.columns == ["doc_id", "block", "pairs", "rest"] + COLUMNS
    assert {(r.block, r.pairs, r.rest) for r in docs.collect()} == {(1, "p", "x")}


def test_query(spark):
    got = queries.QUERIES["op12_alignment"](spark, SF001)
    assert got.dtypes == [("doc_id", "bigint")] + [(c, "bigint") for c in COLUMNS[:-1]] + [("groups_sha256", "string")]
    rows = queries.read(spark, SF001, "documents").select("doc_id", "text").collect()
    want = [(r.doc_id, *w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for r, w in zip(rows, brute([r.text for r in rows])[0])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
