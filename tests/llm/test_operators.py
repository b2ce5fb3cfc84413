"""The ten operators against brute force, round trips and held-out labels, and on nulls, ties, long and empty texts."""

from __future__ import annotations

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sedimenta.llm import chat, compression, decontaminate, mixing, pages, rules, simhash, substrings, toxicity, urls
from sedimenta.llm.graph import components
from sedimenta.llm.queries import QUERIES, TOKENIZER
from sedimenta.llm.tables import fold_of, n_words_of, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")

#: Nulls in every column, no words, repeated rows, repeated ids, and a long text.
ODD = [
    (1, None, None, None, None),
    (None, "no id here at all", "en", "a", 3),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", None, 7),
    (4, "tie tie tie", "en", "b", 11),
    (4, "tie tie tie", "en", "b", 11),
    (4, "another text of the same id", "en", "b", 27),
    (5, "eé\u3000x\u00a0y z\x00 \U0001f600 end.", "xx", "c", 10),
    (6, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "b", 1),
    (7, "x" * 300_000, "en", "b", 300_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("clash") for c in ("score", "rid", "_rid", "m", "node", "size", "taken", "target", "host", "u", "v")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def words(text):
    return WORD.findall(text or "")


# 1


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def expected_talk(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        said = out.setdefault(conv, [])
        said.append((role or "", text or ""))
    return {
        c: (len(s), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in s).encode()).hexdigest(), sum(len(t) for r, t in s if r == "assistant"), hashlib.sha256("".join(t for r, t in s if r == "assistant").encode()).hexdigest())
        for c, s in out.items()
    }


TALKS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", "more"),
    (4, None, None, None), (4, 0, "assistant", ""), (5, 0, "user", "</s>[INST] ok [/INST]"), (5, 1, "assistant", "</s>[INST] ok [/INST]"), (6, 0, "[ROLE]", "<\\s> [\\INST] <s <s>> [/ROLE]["),
    (None, 0, "user", "\U0001f600é\n"), (7, 0, "user", "same"), (7, 0, "user", "same"), (8, 0, "assistant", "long " * 20_000), (9, 0, "user", "hi"), (9, 1, "assistant", "yes"),
]


@pytest.mark.parametrize("vocabulary", [None, TOKENIZER])
@pytest.mark.parametrize("budget", [8, 64, 100_000])
def test_chat_round_trip(spark, budget, vocabulary):
    ranks = Path(vocabulary).read_bytes() if vocabulary else None
    odd = talk(spark, TALKS).withColumns({c: F.lit("clash") for c in ("path", "turns", "tokens", "nodes", "members")})
    back = chat.read_back(chat.packs(odd, ranks, pack_tokens=budget), ranks).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in back} == expected_talk(TALKS)


def test_chat_emits_shared_turns_once_with_positions_and_attention(spark):
    pack = chat.packs(talk(spark, TALKS[:7]).coalesce(1), pack_tokens=10_000).collect()
    total = sum(len(p.tokens) for p in pack)
    alone = sum(r.n_tokens for r in chat.read_back(chat.packs(talk(spark, TALKS[:7]), pack_tokens=1)).collect())
    assert total < alone
    for p in pack:
        assert len({(n.parent, tuple(p.tokens[n.start : n.start + n.n_tokens])) for n in p.nodes}) == len(p.nodes)
        for n in p.nodes:
            chain, at = 0, n.parent
            while at >= 0:
                chain += p.nodes[at].n_tokens
                at = p.nodes[at].parent
            assert n.first_position == chain == sum(a.end - a.start for a in n.attends)
            assert p.position_ids[n.start : n.start + n.n_tokens] == list(range(chain, chain + n.n_tokens))


def test_chat_escape_is_reversible_and_hides_marks():
    random.seed(3)
    parts = ["<", "[", "\\", "/", "s", ">", "]", "INST", "ROLE", "x"]
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randrange(12)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not re.search(r"</?s>|\[/?(ROLE|INST)\]", hidden)


def test_conversations_equal_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    marks = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", marks), (-7, 1, "assistant", marks)]
    got = QUERIES["op1_chat_prefix_tree"](spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected_talk(rows)


def test_wrong_positions_or_masks_are_told(spark):
    reader = lambda positions, loss: chat._Reader(chat.Tokens(), np.array([256, 257, 97, 258, 98, 259]), np.array(positions), np.array(loss, dtype=bool))
    assert reader(range(6), [0, 0, 0, 0, 1, 0]).conversation([(0, 6)])[:2] == ([("a", "b")], "b")
    for positions, loss in (([0, 1, 2, 3, 5, 6], [0] * 6), (range(6), [0, 0, 1, 0, 1, 0])):
        with pytest.raises(ValueError):
            reader(positions, loss).conversation([(0, 6)])


def test_chat_of_nothing(spark):
    assert chat.read_back(chat.packs(talk(spark, []))).count() == 0


# 2


def brute_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r, _ in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_parts(spark):
    given = ["HTTP://Www.Example.COM/en/x?y", "http://a.example.com/en/", "http://example.com", "http://x.net/es/1#a", "x.net/es/", None, "", "a://b://c.net/fr/", "http://u@É.net:80/fr/?://q.com/", "http:///com/", "http://notexample.com/en/1", "://net/es/", "http://com/", "http://a.com?x/"]
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judged(df, urls.fit(spark)).collect()}
    for i, url in enumerate(given):
        host, path, rule = brute_url(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (dict(urls.RULES)[rule] if rule else "block" if got[i].block_probability >= urls.THRESHOLD else "allow")


def test_url_model_learns_its_table_and_takes_long_urls(spark):
    model = urls.fit(spark)
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls.LABELLED)], "page_id long, url string")
    got = {r.page_id: r.block_probability >= urls.THRESHOLD for r in urls.judged(df, model, rules=()).collect()}
    assert sum(got[i] == bool(y) for i, (_, y) in enumerate(urls.LABELLED)) >= 0.97 * len(got)
    assert urls.judged(spark.createDataFrame([(1, "http://h.org/" + "a" * 200_000)], "page_id long, url string"), model).count() == 1
    assert urls.judged(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


def test_url_model_ranks_hosts_that_it_never_saw(spark):
    known = {u.split("/")[2] for u, _ in urls.LABELLED}
    for sf in ("sf0.001", "sf0.01"):
        there = {(r.url or "").split("://")[-1].split("/")[0].lower() for r in table(spark, f"/root/testdata/{sf}", "pages").select("url").collect()}
        assert not known & there
    bad = "casino-palace pillstore adultdating spamking bets-now trackads viagra-online xxx-movies freeslots popads payday-cash pornhost cheap-rolex".split()
    good = "gallery observatory geography castle violin university-press shipping meteorology letters river-trust planetarium chemistry sculpture".split()
    rows = [(i, f"https://{w}.example.{'org' if i % 2 else 'net'}/en/{i}") for i, w in enumerate(bad + good)]
    got = {r.page_id: r.block_probability for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string"), urls.fit(spark), rules=()).collect()}
    pairs = [got[i] > got[len(bad) + j] for i in range(len(bad)) for j in range(len(good))]
    assert sum(pairs) >= 0.95 * len(pairs)
    repeated = spark.createDataFrame(rows[:2] * 3, "page_id long, url string")
    assert urls.judged(repeated, urls.fit(spark)).count() == 6


# 3


def brute_cut(texts):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check_cut(df, columns=("doc_id",)):
    rows = df.collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0, r._n_words, r._n_removed, r._kept_sha256) for r in substrings.cut(df, columns).collect()))
    assert got == sorted((r.doc_id is None, r.doc_id or 0, *e) for r, e in zip(rows, brute_cut([r.text for r in rows]), strict=True))


def test_substrings_equal_brute_force(docs):
    check_cut(docs)


def test_substrings_of_odd_texts(odd, none):
    check_cut(odd)
    assert substrings.cut(none).count() == 0


def test_substrings_at_borders(spark):
    random.seed(1)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(40):
        a, b = sorted(random.sample(range(61), 2))
        texts.append(" ".join([f"a{k}_{i}" for i in range(random.randrange(40))] + passage[a:b] + [f"b{k}_{i}" for i in range(random.randrange(40))]))
    texts += [" ".join(["same"] * n) for n in (34, 35, 36, 80)] + [" ".join(passage[:35]), " ".join(passage[:34])]
    check_cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_substrings_by_batches_equal_all_that_was_there_so_far(spark, docs):
    index, seen = substrings.Index(spark), Counter()
    for k in range(3):
        part = docs.where(F.col("doc_id") % 3 == k)
        got = {r.doc_id: r._n_removed for r in substrings.cut(part, index=index).collect()}
        split = {r.doc_id: words(r.text) for r in part.collect()}
        seen.update(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
        for d, w in split.items():
            assert got[d] == len({j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)})
        assert len(index.runs) == 1


def test_batches_are_merge_joined_with_all_runs_and_compacted(spark, docs):
    index = substrings.Index(spark)
    got = {r.doc_id: r._n_removed for r in substrings.cut(docs, index=index, batches=4).collect()}
    assert index.joined == 1 + 2 + 3
    assert len(index.runs) == 1
    assert got == {r.doc_id: r._n_removed for r in substrings.cut(docs, batches=1).collect()}
    plan = index.runs[0].select("m").hint("merge").join(index.runs[0].select(F.col("m").alias("m")), "m", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_documents_whose_ids_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(substrings, "row_id", lambda: (F.lit(7).cast("long").alias("_r1"), F.xxhash64("doc_id", "text").alias("_r2")))
    random.seed(3)
    make = lambda n: " ".join(f"w{random.randrange(9**6)}" for _ in range(n))
    shared = make(50)
    check_cut(spark.createDataFrame([(1, make(60)), (2, f"{make(40)} {shared}"), (3, f"{shared} {make(40)}"), (4, make(200))], "doc_id long, text string"))


def test_cut_text_holds_the_kept_words(docs):
    for r in substrings.cut(docs, ("doc_id", "text")).collect():
        kept = words(r._kept)
        assert len(kept) == r._n_words - r._n_removed
        assert hashlib.sha256(" ".join(kept).encode()).hexdigest() == r._kept_sha256
        if not r._n_removed:
            assert r._kept == r.text


# 4


def check_mix(df):
    got = mixing.mixed(df).collect()
    assert len(got) == df.count()
    text = {}
    sums = {}
    for r in df.collect():
        text.setdefault(r.doc_id, []).append(r)
        sums[r.source] = sums.get(r.source, 0) + len(words(r.text))
    total = sum(sums.values())
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, budget, target = set(order), 1.5 * total, {}
    while left:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sums[s] + 1e-9]
        for s in over or list(left):
            target[s] = 2 * sums[s] if over else share[s]
            budget -= target[s] if over else 0
            left.discard(s)
    taken = Counter()
    for r in got:
        sources = {x.source for x in text[r.doc_id]}
        assert any(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == sums[s] for s in sources)
        assert 0 <= r.taken <= 2 * r.size
        taken[next(s for s in sources if abs(r.target - target[s]) < 1e-6 * max(1, target[s]))] += r.taken
    return taken, target


def test_mix_meets_its_targets_and_agrees_with_itself(docs):
    taken, target = check_mix(docs)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    assert sorted(mixing.mixed(docs).collect()) == sorted(mixing.mixed(docs.repartition(7)).collect())


def test_mix_of_odd_texts(odd, none):
    check_mix(odd)
    assert mixing.mixed(none).count() == 0


def test_mix_ends_in_ties_and_in_tiny_keys(spark):
    """Rows alike share the rest evenly; weights that crowd keys together don't change the sums."""
    same = spark.createDataFrame([(None, "one two three", "en", "s", 1)] * 500 + [(i, "four five", "en", "t", 1) for i in range(400)], DOCS)
    taken, target = check_mix(same)
    assert abs(taken["t"] - target["t"]) <= 1 and 0 <= target["s"] - taken["s"] <= 500
    rows = [(i, "a b c d e", "en", "st"[i % 2], 1) for i in range(3000)]
    for weight in (1e-9, 0.05, 1e6):
        got = mixing.mixed(spark.createDataFrame(rows, DOCS), ("doc_id", "source"), weight=F.lit(weight), budget=0.7).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
        assert all(abs(r.n - r.t) <= 5 for r in got)


def test_mix_draws_by_weight(spark):
    rows = [(i, "one two three four", "en", "s" if i < 4000 else "t", 1) for i in range(4400)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(df, weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2), weights=(1, 50), budget=0.35).where("doc_id < 4000").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n"))
    n = {r.odd: r.n for r in got.collect()}
    assert 3 * n[1] < n[0] < 6 * n[1]


def test_words_are_counted_as_the_contract_has_them(spark):
    texts = [None, "", " ", "\n\n", "a", " a", "a ", " a\tb\x0bc\x0c\r\nd ", "w ww w", "\x1c a\x1f\x85b\xa0c \u2003 d", "日本 語\n😀 😀", "$1 \\ $0", "x" * 70000, "\r\n".join(["y"] * 3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", n_words_of(F.col("text"))).collect()
    assert [n for _, n in sorted(map(tuple, got))] == [len(words(t)) for t in texts]


def test_a_long_text_is_counted_in_little_memory():
    """Eight million words in a heap that doesn't hold them one by one."""
    code = """
from pyspark.sql import SparkSession, functions as F
from sedimenta.llm.tables import n_words_of
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
text = F.concat(F.repeat(F.lit("a "), 8_000_000), F.col("id").cast("string"))
print("words", spark.range(1).select(n_words_of(text)).first()[0])
"""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), "PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "words 8000001" in out.stdout, out.stderr[-2000:]


# 5


def brute_fp(text, n=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_equals_brute_force(docs):
    rows = docs.orderBy("doc_id").collect()
    fps = [brute_fp(r.text) for r in rows]
    groups = brute_components(fps, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.grouped(docs).collect()}
    assert got == {r.doc_id: (f"{f:016x}", rows[g].doc_id) for r, f, g in zip(rows, fps, groups, strict=True)}


def test_simhash_of_odd_texts(odd, none):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in simhash.grouped(odd).collect())
    assert got == sorted((d is None, d or 0, f"{brute_fp(t):016x}") for d, t, *_ in ODD)
    zero = {r.component_id for r in simhash.grouped(odd).where(f"fingerprint = '{'0' * 16}'").collect()}
    assert zero == {1}
    assert simhash.grouped(none).count() == 0


@pytest.mark.parametrize("shard", [4, 2048])
def test_links_of_dense_clusters_equal_brute_force(spark, shard):
    random.seed(shard)
    centres = [random.getrandbits(64) for _ in range(5)]
    values = {random.getrandbits(64) for _ in range(80)}
    for c in centres:
        for _ in range(70):
            x = c
            for _ in range(random.randrange(6)):
                x ^= 1 << random.randrange(64)
            values.add(x)
    values = sorted(values)
    expected = brute_components(values, 2)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v, v) for v in signed], "fp long, node long"), 2, shard)
    roots = {r.node: r.root for r in components(found).collect()}
    of = {}
    for v, g in zip(signed, expected, strict=True):
        of.setdefault(g, set()).add(roots.get(v, v))
    assert all(len(x) == 1 for x in of.values())
    assert len({next(iter(x)) for x in of.values()}) == len(of)


def test_bk_tree_follows_only_edges_within_the_radius():
    random.seed(2)
    values = list({random.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.near(q, 2)) == sorted((d, v) for v in values if (d := (v ^ q).bit_count()) <= 2)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1100)}


def test_near_copies_are_found_and_others_stay(spark):
    random.seed(4)
    make = lambda: [f"w{random.randrange(5000)}" for _ in range(300)]
    rows, groups = [], []
    for g in range(40):
        base = make()
        for k in range(4):
            copy = list(base)
            for _ in range(k):
                copy[random.randrange(300)] = f"edit{random.random()}"
            groups.append(g)
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, " ".join(make())) for i in range(100)] + [(2000, None), (2001, None), (2002, "")]
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {1000 + i for i in range(100)} <= kept
    assert len(kept & set(range(160))) <= 41
    assert {4 * g for g in range(40)} <= kept
    assert kept & {2000, 2001, 2002} == {2000}


def test_a_large_group_of_near_copies_is_dealt_over_blocks(spark, monkeypatch):
    random.seed(5)
    base = [f"w{random.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(700):
        copy = list(base)
        for _ in range(random.randrange(4)):
            copy[random.randrange(300)] = f"edit{random.random()}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"w{random.randrange(5000)}" for _ in range(300))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "BLOCK", 50)
    monkeypatch.setattr(simhash, "PIVOTS", 8)
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == {0} | {1000 + i for i in range(20)}


def test_near_copies_in_different_blocks_of_a_loose_family_are_found(spark, monkeypatch):
    random.seed(6)
    make = lambda n: [f"w{random.randrange(5000)}" for _ in range(n)]
    template = make(100)
    rows = []
    for g in range(120):  # pairs of near copies; pairs have only the template in common
        base = template + make(200)
        copy = list(base)
        copy[200] = f"edit{g}"
        rows += [(g, " ".join(base)), (1000 + g, " ".join(copy))]
    random.shuffle(rows)
    monkeypatch.setattr(simhash, "BLOCK", 20)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    monkeypatch.setattr(simhash, "_shards", lambda bands: F.array(F.lit(0).cast("long")))  # all in one shard
    assert {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(range(120))


def test_blocks_hold_all_rows_of_a_bucket_and_share_its_pivots(spark):
    rows = [(1, i) for i in range(1000)] + [(2, i) for i in range(30)]
    got = Counter()
    of: dict[int, set] = {}
    for r in simhash._dealt(spark.createDataFrame(rows, "key long, node long"), 100, 10).collect():
        got[r.key] += 1
        of.setdefault(r.key, set()).add(r.node)
    blocks = [k for k in of if k != 2]
    assert of[2] == set(range(30)) and len(blocks) == 10
    assert set().union(*(of[k] for k in blocks)) == set(range(1000))
    assert all(got[k] == len(of[k]) < 180 for k in blocks)
    assert 1 <= len(set.intersection(*(of[k] for k in blocks))) <= 40


def test_shards_give_forests_and_never_all_pairs():
    random.seed(8)
    base = random.getrandbits(256)
    values = {base ^ (1 << i) ^ (1 << 200 + i % 50): 100 - i for i in range(100)}
    assert len(values) == 100
    assert len(simhash.nearest_links(values, 57)) == 99
    assert {r for _, r in simhash.forest(values, 57)} == {1}


def test_nearest_links_join_what_all_pairs_join_at_every_distance():
    random.seed(9)
    values = {random.getrandbits(24): i for i in range(150)}
    numbers = {i: x for x, i in values.items()}
    found = simhash.nearest_links(values, 8)
    for radius in range(1, 9):
        sets = simhash._Sets()
        for u, v in found:
            if (numbers[u] ^ numbers[v]).bit_count() <= radius:
                sets.join(u, v)
        assert [sets.find(i) for i in range(150)] == brute_components([numbers[i] for i in range(150)], radius)


def test_only_texts_of_similarity_08_are_near_copies(spark):
    """Pairs around the threshold: all of 0.8 or more are found, none below."""
    random.seed(10)
    rows, sets = [], {}
    for g in range(300):
        base = [f"w{random.randrange(9000)}" for _ in range(120)]
        copy = list(base)
        for _ in range(random.randrange(1, 9)):
            copy[random.randrange(120)] = f"e{random.random()}"
        rows += [(g, " ".join(base)), (1000 + g, " ".join(copy))]
    for d, t in rows:
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    near = {g for g in range(300) if len(sets[g] & sets[1000 + g]) >= 0.8 * len(sets[g] | sets[1000 + g])}
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {g for g in range(300) if 1000 + g not in kept}
    assert 60 < len(near) < 240
    assert found <= near
    assert len(found) >= 0.97 * len(near)


# 6


def test_alignment_equals_a_plain_one():
    random.seed(6)
    for _ in range(200):
        a = np.array([random.randrange(4) for _ in range(random.randrange(1, 9))], dtype=np.uint64)
        b = np.array([random.randrange(4) for _ in range(random.randrange(1, 15))], dtype=np.uint64)
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        assert decontaminate.align(a, b)[0] == max(map(max, h))


def test_leaks_edited_and_not(spark):
    random.seed(7)
    make = lambda n: [f"w{random.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(make(random.randrange(16, 60)))) for i in range(30)] + [(98, None), (99, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i, text in items[:30]:
        w = [("edited" if random.random() < 0.1 else x.upper() + ",") for x in text.split()]
        rows.append((i, " ".join(make(200) + w + make(200))))
    rows += [(100 + i, " ".join(make(400))) for i in range(200)] + [(i, t) for i, t, *_ in ODD if i is None or i > 5]
    rows += [(500 + k, " ".join(make(50)) + " " + items[3][1]) for k in range(300)]  # a hot item keeps its seeds
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == {(i, i) for i in range(30)} | {(500 + k, 3) for k in range(300)}


@pytest.mark.parametrize("shared", ["edited", "partial", "one seed"])
def test_an_edited_item_that_many_documents_share_is_reported_in_all(spark, shared):
    random.seed(8)
    make = lambda n: [f"w{random.randrange(3000)}" for _ in range(n)]
    item = ["same"] * 5 if shared == "one seed" else make(60)
    copy = {"edited": [f"edit{k}" if k % 10 == 4 else w for k, w in enumerate(item)], "partial": item[:38], "one seed": item}[shared]
    rows = [(k, " ".join(make(50) + copy + make(50))) for k in range(60)] + [(200 + k, " ".join(make(150))) for k in range(60)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(make(40)))], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    assert found == [(k, 1) for k in range(60)]


def test_no_alignment_exceeds_the_bound():
    random.seed(9)
    for _ in range(300):
        a = np.array([random.randrange(9) for _ in range(random.randrange(1, 12))], dtype=np.uint64)
        b = np.array([random.randrange(12) for _ in range(random.randrange(1, 30))], dtype=np.uint64)
        assert decontaminate.align(a, b)[0] <= decontaminate.bound(a, b)


def test_leaks_in_shards_are_the_same(spark, docs, monkeypatch):
    bench = table(spark, SF, "benchmark")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    assert whole
    monkeypatch.setattr(decontaminate, "SHARD_TOKENS", 200)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == whole


def test_short_items_and_items_of_any_id(spark):
    docs = spark.createDataFrame([(1, "Yes."), (2, "yes it is"), (3, None), (4, "no, no"), (4, "no, no"), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "yes"), ("b", "NO no!"), ("b", "NO no!"), (None, "yes it is"), ("c", ""), ("d", None), ("e", "?")], "item_id string, text string")
    got = sorted(((r.doc_id, r.item_id, r.score) for r in decontaminate.leaks(docs, bench).collect()), key=str)
    assert got == sorted([(1, "a", 1.0), (2, None, 1.0), *[(4, "b", 1.0)] * 4], key=str)
    assert sorted(r.doc_id for r in decontaminate.cleaned(docs, bench).collect()) == [3, 5]


def test_leaks_equal_aligning_every_item_with_every_text(spark, docs):
    """Brute force: the whole text against every item, without seeds, regions or bounds."""
    tokens = lambda t: decontaminate._tokens(np.frombuffer((t or "").encode(), dtype=np.uint8))[1]
    items = [(r.item_id, tokens(r.text)) for r in table(spark, SF, "benchmark").collect()]
    expected = {}
    for r in docs.collect():
        t = tokens(r.text)
        for item_id, i in items:
            share = decontaminate.align(i, t)[0] / (2 * len(i)) if len(t) else 0
            if share >= decontaminate.THRESHOLD:
                expected[r.doc_id, item_id] = share
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, table(spark, SF, "benchmark")).collect()}
    assert expected
    assert got == expected


def test_decontamination_of_nothing(spark, odd, none):
    bench = table(spark, SF, "benchmark")
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.cleaned(odd, bench).count() == len(ODD)
    assert decontaminate.cleaned(odd, bench).columns == odd.columns


# 7


def test_gradients_equal_differences():
    net = toxicity.Network.new(3)
    draw = np.random.Generator(np.random.PCG64(1))
    x = draw.standard_normal((toxicity.WINDOW, 3, toxicity.INPUT)).astype(np.float32)
    there = np.ones((toxicity.WINDOW, 3, 1), dtype=np.float32)
    there[20:, 1] = 0
    x *= there
    y = np.array([1, 0, 1], dtype=np.float32)

    def loss():
        z = toxicity._forward(net, x, there).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads, dx = toxicity._gradients(net, x, there, y)
    dx *= there
    for part, grad in zip([*net.parts(), x], [*grads, dx], strict=True):
        for _ in range(4):
            at = tuple(draw.integers(0, s) for s in part.shape)
            kept = part[at]
            part[at] = kept + 1e-2
            up = loss()
            part[at] = kept - 1e-2
            down = loss()
            part[at] = kept
            assert abs((up - down) / 2e-2 - grad[at]) < 2e-3 + 0.05 * abs(grad[at])


def toy(n, bad):
    random.seed(n)
    rows = []
    for i in range(n):
        w = [f"w{random.randrange(400)}" for _ in range(random.randrange(5, 120))]
        label = i % 3 == 0
        if label:
            w[random.randrange(len(w))] = random.choice(bad)
        rows.append((i, " ".join(w), int(label)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toy(900, ["grimble", "grimbly,", "GRIMBLES"])
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.classified(df.select("doc_id", "text"), df.select("doc_id", "toxic"), 3, 1).collect()}
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 200
    assert sum(r.predicted == y for r, y in held) >= 0.95 * len(held)


def words_of(*texts):
    raw = [t.encode() + b" " for t in texts]
    return toxicity._words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([*map(len, raw)]))))


def test_every_window_is_scored():
    for n in (0, 1, 23, 24, 25, 40, 41, 999):
        text, begins = toxicity._begins(np.array([0, n, n + 30]))
        mine = begins[text == 0]
        assert set(range(n)) <= {k for b in mine for k in range(b, b + toxicity.WINDOW)}
        assert len(mine) == max(1, -(-(n - toxicity.WINDOW + toxicity.STRIDE) // toxicity.STRIDE))
    net = toxicity.Network.new(1)
    assert toxicity._scores(net, words_of("", "")).shape == (2,)
    texts = [" ".join(f"w{i * j % 97}" for i in range(700)) for j in range(1, 12)]
    alone = [float(toxicity._scores(net, words_of(t))[0]) for t in texts]
    assert np.allclose(toxicity._scores(net, words_of(*texts)), alone, atol=1e-5)


def test_all_characters_of_a_word_are_inputs():
    """A stem is known wherever it stands in a word, and characters aren't bytes."""
    runs = lambda w: set(words_of(w).features[toxicity._WHOLE :].tolist())
    assert len(runs("über") & runs("donaudampfschifffahrtsüber")) == 2
    assert runs("Ünterquatsch") == runs("ünterquatsch,")
    assert len(words_of("x" * 5000).features) == toxicity._WHOLE + 4998
    assert len(words_of("日本語").features) == toxicity._WHOLE + 1


def test_toxicity_of_odd_texts(spark, odd, none):
    labels = table(spark, SF, "labels")
    model = toxicity.train([(t.encode(), y) for _, t, y in toy(60, ["grimble"])])
    scored = [r.score for r in toxicity.score(odd, model).collect()]
    assert len(scored) == len(ODD)
    assert all(0 <= s <= 1 for s in scored)
    assert toxicity.classified(none, labels, 3, 1).count() == 0
    assert {r.score for r in toxicity.classified(odd, labels.limit(0), 3, 1).collect()} == {0.0}


# 8


def test_rules_count_as_brute_force(docs, odd, none):
    for df in (docs, odd):
        expected = []
        for r in df.collect():
            text, w = r.text or "", words(r.text)
            lines = [x for x in text.split("\n") if WORD.search(x)]
            grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
            seen = Counter(grams)
            repeats = len({j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)})
            failed = len(w) < 10 or 100 * repeats > 20 * len(w)
            expected.append((r.doc_id is None, r.doc_id or 0, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, failed))
        judged = rules.judged(df).collect()
        got = [(r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged]
        assert sorted(got) == sorted(expected)
        assert not any(r.kept and r.base_failed for r in judged)
    assert rules.judged(none).count() == 0


def test_expectation_maximisation_finds_shares_and_accuracies():
    """Junk of three kinds, each known by one rule; a rule that is often wrong; no bound decides a rate."""
    random.seed(8)
    k = len(rules.RULES)
    kinds = {1: 0.1, 3: 0.05, 4: 0.08}
    counts, truth = Counter(), Counter()
    for _ in range(40_000):
        kind = random.choices([None, *kinds], [1 - sum(kinds.values()), *kinds.values()])[0]
        rate = [0.03 if j == 6 else 0.001 for j in range(k)]
        if kind is not None:
            rate = [0.9 if j == kind else 0.5 if j == 6 else 0.1 for j in range(k)]
        vote = tuple(0 if random.random() < 0.1 else -1 if random.random() < r else 1 for r in rate)
        counts[vote] += 1
        truth[vote, kind is None] += 1
    w = rules.maximise(dict(counts))
    right = sum(n for (v, good), n in truth.items() if (rules.posterior(w, v) >= 0.5) == good)
    assert right >= 0.96 * 40_000
    assert abs(w.shares[0] - (1 - sum(kinds.values()))) < 0.03
    for kind, share in kinds.items():
        assert abs(w.shares[kind + 1] - share) < 0.03
        assert w.against[kind + 1][kind] > 0.8
    assert rules.maximise({}) == rules.start()


def test_posterior_column_equals_the_fit(spark, docs):
    voted = rules.votes(rules.features(docs))
    weights = rules.fit(voted)
    names = [f"_vote_{r.name}" for r in rules.RULES]
    for r in voted.select(*names, rules.probability(weights).alias("p")).distinct().collect():
        assert abs(r.p - rules.posterior(weights, tuple(r)[:-1])) < 1e-9


def test_rules_agree_with_labels(docs, spark):
    labels = table(spark, SF, "labels")
    got = rules.judged(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept"))
    kept = {r.quality: r.kept for r in got.collect()}
    assert kept[1] > 0.9
    assert kept.get(0, 0) < 0.3


# 9


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav>
<!-- a > b --><div class="ad top">buy</div><article><h1>Title &amp; more</h1><p>One <b>bold</b>text<br>line<p>Two &#233; &lt;
 three<div class="comments"><p>a comment</p></div><form><input>field</form></article><aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_page_text(spark, none):
    rows = [(1, "http://h/a", PAGE), (2, "http://h/b", None), (3, None, ""), (4, "http://h/c", "<article>cut &am"), (5, "http://h/d", "<p>a<p"), (6, "http://h/e", "1 < 2 > 0"), (7, "http://h/e", "x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "_host": F.lit("clash")})
    got = {r.page_id: r for r in pages.extracted(df).collect()}
    assert {k: r.text for k, r in got.items() if k < 6} == {1: "Title & more One boldtext line Two é < three", 2: "", 3: "", 4: "cut &am", 5: "a"}
    assert (got[6].text, got[7].n_chars) == ("1 < 2 > 0", 200_000)
    assert pages.extracted(df.limit(0)).count() == 0


def test_what_neighbours_share_goes_where_no_article_tells(spark):
    page = lambda body: f"<div><p>Site name</p><p>{body}</p><p>All rights reserved</p></div>"
    df = spark.createDataFrame([(i, f"http://h/{i}", page(f"text {i}")) for i in range(6)] + [(9, "http://alone/", page("x"))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extracted(df.coalesce(1)).collect()}
    assert got == {i: f"text {i}" for i in range(6)} | {9: "Site name x All rights reserved"}


def test_markup_without_end_takes_time_in_proportion():
    import time

    for page in ("<x " * 200_000 + '"', "<div>" * 100_000 + "</p>" * 100_000, "<a '" * 100_001, "<!--" * 100_000, "<script>" * 100_000, "<" * 300_000, '<p class="' * 50_000):
        began = time.perf_counter()
        pages.blocks(page)
        assert time.perf_counter() - began < 5
    began = time.perf_counter()
    assert pages.unshared(["same"] * 6000 + ["x"], ["y"] + ["same"] * 6000 + ["z"]) == ["x"]
    assert len(pages.unshared(["a", "b"] * 4000, ["b", "c", "a"] * 3000)) > 0
    assert time.perf_counter() - began < 20


def test_repeated_pages_and_the_same_url_have_the_same_text(spark):
    page = lambda k: f"<div><p>Site</p><p>text {k}</p><p>Foot</p></div>"
    rows = [(1, "http://h/a", page(1))] * 3 + [(2, "http://h/a", page(2)), (3, "http://h/b", page(3)), (None, None, None), (4, None, page(4)), (4, None, page(4))]
    got = sorted(map(tuple, pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).select("page_id", "url", "text").collect()), key=str)
    assert len(got) == len(rows)
    assert {t for p, _, t in got if p == 2} == {"text 2"} and {t for p, _, t in got if p == 3} == {"text 3"}
    assert len({t for p, _, t in got if p == 4}) == 1


def test_whole_article_text_of_every_page(spark):
    """Brute force with a parser of the standard library: all text of the article element, block by block."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.parts = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag != "b":
                self.parts.append("")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag != "b":
                self.parts.append("")

        def handle_data(self, data):
            if self.inside:
                self.parts[-1] += data

    expected = {}
    for r in table(spark, SF, "pages").collect():
        parser = Article()
        parser.feed(r.html)
        parser.close()
        expected[r.page_id] = " ".join(t for t in (" ".join(p.split()) for p in parser.parts) if t)
    assert {r.page_id: r.text for r in pages.extracted(table(spark, SF, "pages")).collect()} == expected


def test_article_headers_and_formulas_stay():
    page = "<article><header><h1>Title</h1></header><p>Let <math><mi>x</mi></math> be<noscript>, said</noscript></p><div class='related'>more</div><footer>f</footer></article><header>h</header>"
    assert pages.blocks(page)[0] == ["Title", "Let", "x", "be", ", said", "more"]


def test_a_comment_marked_up_as_an_article_is_no_main_text():
    assert pages.blocks('<article class="post"><p>text</p></article><article class="comment">no</article><article id="related-1">no</article>') == (["text"], [])


def test_copies_of_an_article_keep_their_text(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", PAGE) for i in range(4)], "page_id long, url string, html string")
    assert {r.text for r in pages.extracted(df).collect()} == {"Title & more One boldtext line Two é < three"}


def test_unshared_is_what_a_longest_common_subsequence_leaves():
    random.seed(9)
    for _ in range(300):
        a = [random.choice("abcde") for _ in range(random.randrange(12))]
        b = [random.choice("abcde") for _ in range(random.randrange(12))]
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                size[i + 1][j + 1] = size[i][j] + 1 if a[i] == b[j] else max(size[i][j + 1], size[i + 1][j])
        assert len(pages.unshared(a, b)) == len(a) - size[-1][-1]


# 10


def test_compression_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = compression.classified(docs, labels, 4, 2).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.93 * len(got)


def test_compression_of_odd_texts(spark, odd, none):
    labels = table(spark, SF, "labels")
    model = compression.fit(table(spark, SF, "documents"), labels)
    scored = compression.score(odd, model).collect()
    assert len(scored) == len(ODD)
    assert all(0 <= r.score <= 1 for r in scored)
    assert compression.classified(none, labels, 4, 2).count() == 0
    assert {round(r.score, 6) for r in compression.classified(odd, labels.limit(0), 4, 2).collect()} == {0.5}


def test_no_label_of_the_held_out_fold_is_learnt(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(fold_of(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(fold_of(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for run, folds, held in ((compression.classified, 4, 2), (toxicity.classified, 3, 1)):
        assert sorted(run(docs, labels, folds, held).collect()) == sorted(run(docs, turned, folds, held).collect())
