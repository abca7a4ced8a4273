import itertools
import random

import numpy as np
import pytest
from llm_fixtures import SF001, messy, nothing  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from prefmine.llm import chat, packing, quality, queries, simhash
from prefmine.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def model():
    return chat.Model(np.array([5, 90, 5]), np.array([[1, 90, 2], [1, 5, 90], [1, 90, 4]]), np.arange(30).reshape(3, 10) % 7 + 1)


def best_path(model, rows):
    """The best roles by trying them all."""
    steps = list(model.steps(rows, True))
    best = max(itertools.product(range(chat.N), repeat=len(steps)), key=lambda p: steps[0][0][p[0]] + sum(
        s[a][b] for s, a, b in zip(steps[1:], p, p[1:])))
    return list(best)


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_in_blocks_equals_all_paths(model, seed):
    rng = random.Random(seed)
    kinds = [chat.NONE] * 3 + list(range(5))
    rows = [[rng.choice(kinds) * 10 + rng.randrange(10) for _ in range(rng.randint(1, 2))] for _ in range(5)]
    blocks = [rows[:2], rows[2:3], rows[3:]]
    ends = chat.chain([model.matrix(b, i == 0) for i, b in enumerate(blocks)])
    flat = [r for i, (b, (a, z)) in enumerate(zip(blocks, ends)) for row in model.decode(b, i == 0, a, z) for r in row]
    assert flat == best_path(model, rows)


@pytest.mark.parametrize("line, want", [
    ("Human: hi", (1, "hi")), ("### Assistant", (2, "")), ("<|im_start|>system", (0, "")), ("<|user|> ask", (1, "ask")), ("[INST] do it [/INST]", (1, "do it")),
    ("**Bot:** sure", (2, "sure")), ("Q: why?", (1, "why?")), ("A day in May", (chat.NONE, "A day in May")), ("plain", (chat.NONE, "plain")), ("", (chat.NONE, ""))])
def test_markers(line, want):
    assert chat.read_line(line)[:2] == want


@pytest.mark.parametrize("line", ["Q > 0 holds", "a > b holds", "A > B", "Questions: none", "User 1 is here", "me > you"])
def test_no_markers(line):
    assert chat.read_line(line) == (chat.NONE, line, False)


@pytest.mark.parametrize("line", ["Answer: 42", "Model: T-800 is old, why", "Context: a war", "Response: 200 OK", "# Answer", "Q: is a letter", "Question: why?"])
def test_weak_names_in_labelled_rows_are_text(spark, line):
    assert chat.read_line(line, True) == (chat.NONE, line, False)
    rows = [(c, t, r, f"some {r} text here") for c in range(30) for t, r in enumerate(["user", "assistant"] * 2)]
    rows += [(99, 0, "user", line), (99, 1, "assistant", line), (99, 2, "user", "x\n" + line)]
    out = chat.format_chat(spark.createDataFrame(rows, SCHEMA)).where("conv_id = 99").orderBy("turn").collect()
    assert [(r.role, r.content) for r in out] == [("user", line), ("assistant", line), ("user", "x\n" + line)]


def test_no_text_is_lost():
    """Whatever the labels and decoded roles: the contents, with the markers cut where a turn opens put back, are the text."""
    rng = random.Random(0)
    lines = ["Answer: 42", "Human: hi", "a > b holds", "plain", "", "### Assistant", "<|im_start|>user go<|im_end|>", "[INST] do it [/INST]", "# Answer",
             "Bot> x", "x <|im_end|>", "System: be kind", "<<SYS>> rules <</SYS>>", "  indented ", "Model: T-800"]
    for _ in range(3000):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))
        states, before = [rng.randrange(3) for _ in text.split("\n")], rng.choice([None, 0, 1, 2])
        label = rng.choice([None, "user", "assistant", "robot"])
        parts = chat.turns_of(label, text, states, before)
        got, want, last, token = iter("\n".join(p["content"] for p in parts if p["content"] or True).split("\n")), [], before, False
        for i, (line, state) in enumerate(zip(text.split("\n"), states)):
            opens = state != last
            kind, rest, special = chat.read_line(line, label in ("user", "assistant"))
            if i == 0 or opens:
                token = opens and kind == state and special
            shown = rest if opens and kind == state else line
            want.append(chat.CLOSER.sub("", shown) if token else shown)
            last = state
        assert [x for x in got if x] == [x for x in want if x]
        assert [p["role"] for p in parts] == [chat.ROLES[k] for k, _ in itertools.groupby(states)]


def brute_chat(rows):
    """{(conv, turn, part): (role, opens, content)}: plain counts and one plain Viterbi per conversation,
    rows (conv, turn, label, text) with distinct turns."""
    convs = {}
    for c, t, label, text in sorted(rows, key=lambda r: r[:2]):
        convs.setdefault(c, []).append((t, label, text, chat.observe(label, text)))
    first, after, shown = np.zeros(3), np.zeros((3, 3)), np.zeros((3, chat.FEATURES))
    for own in convs.values():
        known = [(t, chat.speaker_class(a), o) for t, a, _, o in own if chat.speaker_class(a) < 3]
        for k, (t, a, o) in enumerate(known):
            first[a] += k == 0
            for x in o:
                shown[a, x % chat.FEATURES] += 1
            if k + 1 < len(known) and known[k + 1][0] == t + 1:
                after[a, known[k + 1][1]] += 1
    m = chat.Model(first, after, shown)
    out = {}
    for c, own in convs.items():
        codes = [(i, x) for _, _, _, o in own for i, x in enumerate(o)]
        score, back = m.first + m.emit[codes[0][1]], []
        for i, x in codes[1:]:
            reach = score[:, None] + m.step(x, i == 0)
            back.append(reach.argmax(0))
            score = reach.max(0)
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path, at, last = path[::-1], 0, None
        for t, label, text, o in own:
            states = path[at : at + len(o)]
            for p in chat.turns_of(label, text, states, last):
                out[c, t, p["part"]] = (p["role"], p["opens"], p["content"])
            at, last = at + len(o), states[-1]
    return out


def test_whole_query_equals_brute_force(spark):
    got = queries.QUERIES["op8_chat"](spark, SF001).collect()
    table = spark.read.parquet(f"{SF001}/conversations.parquet").withColumn("hidden", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0).collect()
    want = brute_chat([(r.conv_id, r.turn, None if r.hidden else r.role, r.text) for r in table])
    assert {(r.conv_id, r.turn, r.part): (r.role, r.opens, r.content) for r in got} == want and len(got) == len(want)
    given = {(r.conv_id, r.turn): (r.role, r.hidden) for r in table}
    assert all((r.given, r.hidden) == given[r.conv_id, r.turn] for r in got) and sum(r.hidden for r in got) > 10
    asked = [r for r in got if r.hidden and r.part == 0]
    assert {r.accuracy for r in got} == {round(sum(r.role == r.given for r in asked) / len(asked), 6)} and got[0].accuracy >= 0.9


def test_given_roles_are_kept(spark):
    out = chat.format_chat(spark.read.parquet(f"{SF001}/conversations.parquet")).collect()
    given = {(r.conv_id, r.turn): (r.role, r.text) for r in spark.read.parquet(f"{SF001}/conversations.parquet").collect()}
    assert {(r.conv_id, r.turn): (r.role, r.content) for r in out} == given
    assert all(r.rendered == (f"<|{r.role}|>\n" if r.opens else "") + r.content + "\n" for r in out)


def test_hidden_roles_are_recovered(spark):
    """Held-out accuracy: a quarter of the speakers is taken away."""
    true = spark.read.parquet(f"{SF001.replace('0.001', '0.01')}/conversations.parquet")
    hide = F.xxhash64("conv_id", "turn") % 4 == 0
    out = chat.format_chat(true.withColumn("role", F.when(~hide, F.col("role")))).withColumnRenamed("role", "found")
    acc = out.join(true, ["conv_id", "turn"]).where(hide).agg(F.avg((F.col("found") == F.col("role")).cast("int"))).first()[0]
    assert acc > 0.9


def test_markers_in_the_text_open_turns(spark):
    shown = [(c, t, r, f"some {r} text here") for c in range(30) for t, r in enumerate(["user", "assistant"] * 2)]
    raw = [(99, 0, None, "Human: what is it?\nplease\nAssistant: a thing.\nIt is big.\nHuman: thanks")]
    out = chat.format_chat(spark.createDataFrame(shown + raw, SCHEMA)).where("conv_id = 99").orderBy("part").collect()
    assert [(r.role, r.content) for r in out] == [("user", "what is it?\nplease"), ("assistant", "a thing.\nIt is big."), ("user", "thanks")]
    assert "".join(r.rendered for r in out) == "<|user|>\nwhat is it?\nplease\n<|assistant|>\na thing.\nIt is big.\n<|user|>\nthanks\n"


def test_small_blocks_give_the_same_roles(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", None, "robot"]), rng.choice(["why?", "a b c d e", "User: x\nBot: y", ""])) for t in range(60)]
    rows += [(2, 7, rng.choice(["user", None]), f"text {i}") for i in range(40)]  # one turn number for all
    df = spark.createDataFrame(rows + [(3, 0, "user", "hi"), (3, 1, "assistant", "ho")] * 9, SCHEMA)
    one, many = (sorted(map(str, chat.format_chat(df, block_rows=n).drop("rendered").collect())) for n in (512, 4))
    assert one == many


def test_messy_rows(spark):
    rows = [(None, None, None, None), (None, 0, "user", "x"), (1, None, None, ""), (1, 0, "user", None), (1, 0, "user", None), (1, 1, "??", "word " * 50000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash")).withColumn("conv", F.lit("clash"))
    out = chat.format_chat(df).collect()
    assert len(out) == len(rows) and {r.role for r in out} <= set(chat.ROLES)
    assert sum(r.content == "word " * 50000 for r in out) == 1
    assert chat.format_chat(df.where("turn > 99")).count() == 0


def test_pipeline_stages(spark):
    """Every stage on what its predecessor kept, against brute force."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    scratch, seen = Scratch(spark, "t"), [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(scratch.write(stage(spark, seen[-1], SF001)))
    raw, clean, one, hidden, mixed, packed = seen
    for df in seen[1:5]:
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    want = {}
    for r in raw.collect():
        n, _, _, _, rep, lost, rest = quality.judge(r.text, quality.Rules())
        if n >= 10 and rep <= 0.2 * n and lost <= 0.4 * n:
            want[r.doc_id] = rest
    assert {r.doc_id: r.text for r in clean.collect()} == want
    assert all(r.n_chars == len(r.text) for r in hidden.collect())
    prints = [(r.doc_id, simhash.fingerprint(r.text)) for r in clean.collect()]
    f = np.array([p for _, p in prints], np.uint64)
    label = {d: d for d, _ in prints}
    for _ in range(9):  # smallest id over links, again and again
        for i, (d, _) in enumerate(prints):
            label[d] = min(label[prints[j][0]] for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 2))
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(label.values()))
    assert sorted(r.doc_id for r in hidden.collect()) == sorted(r.doc_id for r in one.collect())
    words = {r.doc_id: len(r.text.split()) for r in hidden.collect()}
    sizes = [words[r.doc_id] for r in mixed.collect()]
    assert abs(sum(sizes) - sum(words.values())) <= 20 * max(words.values()) / 2
    assert sum(r.n_words for r in packed.collect()) == sum(sizes)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF001).select("doc_id", "part", "n_words").collect())) == sorted(
        map(tuple, packed.select("doc_id", "part", "n_words").collect()))


def test_pipeline_of_messy_and_empty_tables(spark, messy, nothing):
    for docs in (messy, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF001)
            assert out.columns == docs.columns
            docs = Scratch(spark, "t").write(out)
        assert packing.pack(docs).where("n_words > 2048").count() == 0
    assert docs.count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(entry.oracle_sql()) and len(queries.ORACLE_SQL) == 6


def test_repeated_rows_are_cut_into_bounded_blocks(spark):
    rows = [(1, 7, "user", "same")] * 90 + [(1, None, None, "no turn")] * 70 + [(2, t, "user", "x") for t in range(30)] + [(None, 0, "user", "y")] * 3
    df = spark.createDataFrame(rows, SCHEMA).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("conv"),
        F.coalesce("turn", F.lit(-1)).alias("turn"), F.hash("text").cast("long").alias("hash"), F.array(F.lit(1)).alias("obs"))
    sizes = {(r.conv, r.block): r["count"] for r in chat._blocks(df, Scratch(spark, "t"), 8).groupBy("conv", "block").count().collect()}
    assert max(sizes.values()) <= 8 and sum(sizes.values()) == len(rows)
    assert [sum(c == conv for c, _ in sizes) for conv in ("1", "2", "none")] == [20, 4, 1]


def test_borders_by_a_tree_equal_one_chain(spark):
    rng = np.random.default_rng(6)
    convs = {"a": 70, "b": 1, "c": 9, "d": 3}
    ms = {c: [rng.normal(size=(chat.N, chat.N)) for _ in range(n)] for c, n in convs.items()}
    df = spark.createDataFrame([(c, i, m.ravel().tolist()) for c, l in ms.items() for i, m in enumerate(l)], "conv string, block long, m array<double>")
    dealt = lambda d, *k: d.withColumn("deal", F.pmod(F.xxhash64(*k), F.lit(5)))
    got = {(r.conv, r.block): (r.enter, r.leave) for r in chat._borders(df, Scratch(spark, "t"), dealt, 3).collect()}
    assert got == {(c, i): e for c, l in ms.items() for i, e in enumerate(chat.chain(l))}
