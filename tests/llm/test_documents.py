"""Document operators against brute force on small tables that hold every odd case."""

import glob
import hashlib
import os
import random
import tempfile
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.llm import exact_dedup, jaccard, line_dedup, mixing, quality, substring_dedup
from tilewright.llm.common import shared_dir, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, key string, node long, token long"


def _make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 1, 2) for i, t, s in rows], SCHEMA)


def _texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    line = lambda n: " ".join(word() for _ in range(n))
    base = [line(rnd.randint(5, 90)) + "\n" + line(30) for _ in range(25)]
    shared = line(40)
    out = list(base)
    for t in base[:10]:  # near copies, copies in other case
        w = t.split(" ")
        w[len(w) // 2] = "ZZ"
        out += [" ".join(w), t.upper(), t]
    out += [f"{line(20)} {shared} {line(15)}" for _ in range(8)]
    out += [shared, None, "", " \n\t", "one", "a b", "a b c", "É Ünder ÉCOLE x", "é Ünder ÉCOLE x", "x\n" * 40, "same line here\nother line\nthird line\n" * 5, line(6000) + "\n" + line(6000)]
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    t = _texts()
    ids = rnd.sample(range(1000), len(t))
    out = [(i, x, rnd.choice(["src0", "src1", "b", None])) for i, x in zip(ids, t, strict=True)]
    out += [out[0], out[3]]  # repeated rows
    out += [(None, "no id at all", "src0"), (None, out[1][1], "src0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return _make(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return _make(spark, []).cache()


def lower(t):
    return (t or "").encode().lower()


def test_empty_tables(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert quality.quality_rules(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert jaccard.jaccard_components(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    want = Counter()
    for i, t, _ in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[i, keep, len(g), i == keep, hashlib.sha256(lower(t)).hexdigest()] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == want


def test_drop_copies_keeps_columns(docs, rows):
    d = exact_dedup.drop_copies(docs)
    assert d.columns == docs.columns
    assert {lower(r.text) for r in d.collect()} == {lower(t) for _, t, _ in rows}


def test_chunks_are_the_text(spark):
    rnd = random.Random(7)
    t = " ".join("".join(rnd.choice("aeiostx") for _ in range(rnd.randint(1, 7))) for _ in range(6000)) + "\n" + "x" * 10_000 + "日本" * 3000
    r = spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).first().c
    assert "".join(r) == t and max(map(len, r)) <= exact_dedup.MAX_CHUNK
    # an insertion leaves the chunks behind the next cut as they are
    moved = spark.createDataFrame([("inserted " + t,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).first().c
    assert len(set(r) & set(moved)) >= len(set(r)) - 3


def test_conflicting_keys_are_found(spark):
    s = spark.createDataFrame([(1, b"a"), (1, b"b"), (2, b"c")], "key long, check binary")
    assert [r.key for r in exact_dedup.conflicts(s).collect()] == [1]


def _base(t):
    w = (t or "").encode().split()
    grams = defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    hit = {j for g in grams.values() if len(g) > 1 for i in g for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_base_rules(spark, docs, rows):
    more = [(5001, "a b c d e f g h i j " * 9, None), (5002, "w " * 30, None), (5003, "a # b | c <x> $1 %% &\n\n a # b | c <x> $1 %% &", None), (5004, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 x", None)]
    for r in quality.base_rules(_make(spark, more).unionByName(docs)).collect():
        t = next(t for i, t, _ in [*more, *rows] if i == r.doc_id and (i is not None or len((t or "").split()) == r.n_words))
        n, chars, symbols, dup, rep = _base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), r.doc_id
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)


def test_boilerplate_lines(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, f"{body(i)}\nSubscribe  to our newsletter now", "h") for i in range(80)]
    rows += [(100, "subscribe to our newsletter now\n" + " ".join("abcdefghijklmnopqrs"), "h"), (101, f"{body(101)}", "h"), (102, f"{body(102)}\nSubscribe to our newsletter now", "other")]
    d = _make(spark, rows)
    got = {r.doc_id: r for r in quality.quality_rules(d).collect()}
    assert got[0].kept and got[0].lost_words == 5 and got[0].lost_lines == [1]
    assert not got[100].kept and got[101].lost_words == 0 and got[102].lost_words == 0
    out = {r.doc_id: r for r in quality.clean(d).collect()}
    assert quality.clean(d).columns == d.columns
    assert 100 not in out and out[0].text == body(0) and out[0].n_chars == len(body(0)) and out[102].text.endswith("now")
    # copies of one text count once
    same = _make(spark, [(i, "Subscribe to our newsletter now " + body(1), "h") for i in range(80)])
    assert quality.quality_rules(same).filter("lost_words > 0").count() == 0


def test_boilerplate_of_small_and_large_hosts(spark):
    """A line in all of 5 texts and one in 65 of 496 come off, one in 3 of 5 and one in 30 of 496 stay."""
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, f"{body(i)}\nall rights reserved" + "\nread on here" * (i < 3), "small") for i in range(5)]
    rows += [(100 + i, body(100 + i) + "\nsubscribe now please" * (i < 65) + "\nsome common phrase" * (65 <= i < 95), "large") for i in range(496)]
    got = {r.doc_id: r.lost_words for r in quality.quality_rules(_make(spark, rows)).collect()}
    assert got == {i: 3 for i in range(5)} | {100 + i: 3 * (i < 65) for i in range(496)}
    assert {r.text for r in quality.clean(_make(spark, rows)).filter("source = 'small'").collect()} == {body(i) + "\nread on here" * (i < 3) for i in range(5)}


def test_line_dedup(docs, rows):
    def windows(t):
        held = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((t or "").split("\n"))]
        held = [x for x in held if x[1]]
        return [(tuple(i for i, _ in held[j : j + 3]), tuple(s for _, s in held[j : j + 3])) for j in range(len(held) - 2)]

    keyed = {(i, t) for i, t, _ in rows}
    first = {}
    for i, t in sorted(keyed, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        for lines, s in windows(t):
            first.setdefault(s, (i, t, lines))
    want = Counter()
    for i, t, _ in rows:
        gone = {j for lines, s in windows(t) if first[s] != (i, t, lines) for j in lines}
        every = (t or "").split("\n")
        want[i, len(every) if t else 0, len(gone), "\n".join(x for j, x in enumerate(every) if j not in gone)] += 1
    assert Counter(tuple(r) for r in line_dedup.line_dedup(docs).collect()) == want


def _substring(rows, length=13):
    words = [(i, (t or "").encode().split()) for i, t, _ in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - length + 1):
            if i is not None:
                g = tuple(w[j : j + length])
                first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, w in words:
        gone = {j + x for j in range(len(w) - length + 1) for x in range(length) if i is not None and first[tuple(w[j : j + length])] < i}
        line = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, len(w), len(gone), hashlib.sha256(line).hexdigest()] += 1
    return out


def test_substring_dedup(docs, rows):
    got = substring_dedup.substring_dedup(docs)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == _substring(rows)


def test_substring_dedup_on_dense_repeats(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 80))), None) for i in range(60)]
    got = substring_dedup.substring_dedup(_make(spark, rows))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == _substring(rows)


def _components(rows, k, percent):
    sets = []
    for i, t, _ in rows:
        w = lower(t).split()
        sets.append((i, frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    out = Counter()
    for a, (i, s) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(sets)) if find(b) == find(a) and sets[b][0] is not None]
        out[i, len(s), min(ids, default=None) if s else i] += 1
    return out


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, rows, k, percent):
    got = jaccard.jaccard_components(docs, k=k, percent=percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _components(rows, k, percent)


def test_near_dedup_takes_back_its_tables(spark, docs):
    """What stays in the shared folder is what the result reads."""
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    d = jaccard.near_dedup(docs, k=5, percent=80)
    left = sorted(x.rpartition("-")[0] for x in set(os.listdir(folder)) - before)
    assert left == ["bitmap", "near-copies"] and d.count() > 0


def test_written_leaves_no_shuffle_files(spark):
    files = lambda: set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*"))
    before = files()
    d = written(spark.range(100_000).groupBy((F.col("id") % 50_000).alias("k")).count(), "sums")
    for _ in range(50):  # executors delete them in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and d.count() == 50_000


def test_jaccard_chains_and_frequent_tokens(spark, monkeypatch):
    """Groups of near copies beyond RARE, chained by small steps, so combinations and pairs across components matter."""
    rnd = random.Random(8)
    monkeypatch.setattr(jaccard, "RARE", 3)
    rows, n = [], 0
    for _ in range(3):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
        for _ in range(30):
            w = list(w)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            rows.append((n, " ".join(w), None))
            n += 1
    rnd.shuffle(rows)
    for k, percent in ((4, 85), (5, 80)):
        got = jaccard.jaccard_components(_make(spark, rows), k=k, percent=percent)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _components(rows, k, percent)


def test_jaccard_frequent_token_first(spark, monkeypatch):
    """A cut copy exactly at the threshold whose first token is frequent: the first rare one in common has it before it."""
    rnd = random.Random(3)
    monkeypatch.setattr(jaccard, "RARE", 3)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    tokens = lambda t: next(jaccard.token_sets([pa.RecordBatch.from_arrays([pa.array([0]), pa.array([" ".join(t)])], ["i", "t"])], 4))[1][0]
    shared = min((words(4) for _ in range(3000)), key=lambda w: int(tokens(w)[0]))
    long = words(8) + shared + words(11)
    rows = [(1, " ".join(long), None), (2, " ".join(long[:20]), None)] + [(10 + i, " ".join(words(8) + shared + words(8)), None) for i in range(5)]
    assert len(tokens(long)) == 20 and all(tokens(t.split())[0] == tokens(shared)[0] for _, t, _ in rows)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(_make(spark, rows), k=4, percent=85).collect()}
    assert got == {1: 1, 2: 1} | {10 + i: 10 + i for i in range(5)}


@pytest.mark.parametrize("at_once", [0, 4])
def test_jaccard_copies_under_the_threshold(spark, monkeypatch, at_once):
    """Copies of one text that mostly don't link with each other, nor with the text: refined postings find the few that do."""
    rnd = random.Random(5)
    monkeypatch.setattr(jaccard, "RARE", 3)
    monkeypatch.setattr(jaccard, "PAIRS", at_once)
    monkeypatch.setattr(jaccard, "SMALL", 3)
    base, rows = [f"w{rnd.randrange(10**6)}" for _ in range(120)], []
    places = [rnd.sample(range(120), 4) for _ in range(25)]
    for i in range(70):
        w = list(base)
        for j in places[i % 25] if i % 3 else rnd.sample(range(120), 4):
            w[j] = f"e{rnd.randrange(3 if i % 2 else 10**6)}"
        rows.append((i, " ".join(w[: 120 - i % 5]), None))
    for k, percent in ((4, 85), (5, 80)):
        want = _components(rows, k, percent)
        got = jaccard.jaccard_components(_make(spark, rows), k=k, percent=percent)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
        assert 1 < len({c for _, _, c in want}) < 70


def test_jaccard_counts_prefixes_of_differences(spark, monkeypatch):
    """Nodes far from their hub differ from it in more tokens than they have: only the prefixes are looked at one by one, and the links are found."""
    rnd = np.random.default_rng(7)
    draw = lambda n: rnd.integers(0, 2**64, n, dtype=np.uint64)
    hub, all_have, pool = draw(800), draw(20), draw(300)
    sets = {0: np.sort(np.concatenate([hub, all_have]))}
    for i in range(1, 41, 2):  # pairs of which the first ten link; all draw on one pool, which others share
        x = np.concatenate([all_have, rnd.choice(pool, 180, replace=False)])
        fresh = draw(4 if i <= 20 else 60)
        sets |= {i: np.sort(x), i + 1: np.sort(np.concatenate([x[: len(x) - len(fresh)], fresh]))}
    tables = spark.createDataFrame([(i, i, len(x), bytearray(x.tobytes())) for i, x in sets.items()], "node bigint, root bigint, n bigint, tokens binary")
    found = jaccard.gaps(tables.filter("node > 0").select(F.lit(0).cast("bigint").alias("hub"), "node", "root", "n"), tables, 85)
    frames = {}
    monkeypatch.setattr(jaccard, "written", lambda df, name: frames.setdefault(name, written(df, name)))
    postings = jaccard.refined(found, 85)
    a, b = postings.select("key", F.col("node").alias("a")), postings.select(F.col("key").alias("k"), F.col("node").alias("b"))
    met = {(r.a, r.b) for r in a.join(b, F.col("key") == F.col("k")).filter("a < b").select("a", "b").distinct().collect()}
    link = {(i, j) for i in range(1, 41) for j in range(i + 1, 41) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c)}
    assert len(link) >= 10 and link <= met
    assert frames["differences"].count() < 0.3 * len(np.unique(np.concatenate([np.setxor1d(x, sets[0]) for i, x in sets.items() if i])))


def test_jaccard_counts_out_what_a_full_bitmap_lets_through(spark, monkeypatch):
    """Where a bitmap is so full that it holds every token, only shared ones of nodes that may link are kept, and no shuffle of all tokens stays behind it."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(60)) for _ in range(30)]
    texts += [f"{texts[0]} more", " ".join([f"w{r.randrange(10**9)}" for _ in range(50)] + texts[1].split()[:6])]
    kept, shuffled, write = [], [], jaccard.written

    def full(keys, col):
        shuffled.append("Exchange" in keys._jdf.queryExecution().executedPlan().toString())
        return b"\xff" * 512

    monkeypatch.setattr(jaccard, "bitmap", full)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    monkeypatch.setattr("tilewright.llm.common.written", lambda df, name: kept.append((name, df.count())) or write(df, name))
    out = {x.doc_id: x.component_id for x in jaccard.jaccard_components(df, k=4, percent=85).collect()}
    assert out == {i: 0 if i == 30 else i for i in range(32)}
    assert shuffled and not any(shuffled)
    assert 0 < dict(kept)["entries"] <= 2 * 60


def test_windows_of_sizes(spark):
    """Sizes that may link share a window; a size is in two."""
    for percent in (50, 80, 85, 100):
        keys = defaultdict(set)
        for r in jaccard._windowed(spark.range(1, 2000).select(F.lit(5).alias("key"), F.col("id").alias("n")), percent).collect():
            keys[r.n].add(r.key)
        assert all(len(x) == 2 for x in keys.values())
        assert all(keys[a] & keys[b] for a in range(1, 2000) for b in range(a, min(1999, a * 100 // percent) + 1))
        assert not keys[10] & keys[100]


def test_jaccard_refines_sizes_apart(spark, monkeypatch):
    """Beginnings of one text that differ in size are not refined together."""
    rnd = random.Random(11)
    monkeypatch.setattr(jaccard, "RARE", 3)
    monkeypatch.setattr(jaccard, "SMALL", 4)
    text, rows = [f"p{j}" for j in range(1500)], []
    for i in range(16):
        n = int(60 * 1.22**i)
        rows += [(10 * i + j, " ".join(text[:n] + [f"w{rnd.randrange(10**6)}" for _ in range(n // 10)]), None) for j in range(2)]
    rows += [(500 + i, t + " x", None) for i, t, _ in rows[::6]]
    found, able = [], jaccard.able
    monkeypatch.setattr(jaccard, "able", lambda groups, *a: (found.append(groups.count()), able(groups, *a))[1])
    got = jaccard.jaccard_components(_make(spark, rows), k=4, percent=85)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _components(rows, 4, 85)
    assert sum(found) < 12, found


def test_clashing_nodes_are_settled(spark):
    """Sets that share a node get nodes of their own, which follow from their digests alone; the rest keep theirs."""
    rows = [(1, 7, 70), (2, 7, 71), (3, 7, 70), (4, 8, 80), (5, None, None)]
    every = spark.createDataFrame([(i, 0, 3, n, c, b"") for i, n, c in rows], "doc_id bigint, digest bigint, n bigint, node bigint, check bigint, bits binary")
    out, nodes, clashes = jaccard.settle(every, jaccard.nodes_of(every))
    got = {r.doc_id: r.node for r in out.collect()}
    assert clashes == {7} and got[1] == got[3] == jaccard.settled(7, 70, clashes) != got[2] == jaccard.settled(7, 71, clashes)
    assert got[4] == 8 and got[5] is None and nodes.count() == 3


def test_most_groups(spark):
    for percent in (80, 85):
        got = spark.range(1, 20_000).select("id", jaccard.most_groups(F.col("id"), percent).alias("m")).collect()
        assert all(r.m == jaccard.group_counts(r.id, percent)[-1] for r in got)


def test_near_dedup_keeps_columns(docs, rows):
    d = jaccard.near_dedup(docs, k=5, percent=80)
    assert d.columns == docs.columns
    kept = Counter(r.doc_id for r in d.collect())
    want = Counter()
    for (i, _, c), n in _components(rows, 5, 80).items():
        if i is None or i == c:
            want[i] += n
    assert kept == want


def test_near_dedup_of_repeated_ids(spark):
    """Of two texts under one id only the near copy of a smaller id goes."""
    text = lambda c: " ".join(f"{c}{j}" for j in range(60))
    rows = [(1, text("a"), None), (2, text("a") + " more", None), (2, text("b"), None), (3, text("c"), None)]
    kept = jaccard.near_dedup(_make(spark, rows), k=5, percent=80).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, text("a")), (2, text("b")), (3, text("c"))]


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(x for x in total if x is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, left = dict.fromkeys(names, 0.0), 1.5 * sum(total.values())
    free = set(names)
    while left > 1e-6 and free:  # share out by weight; what exceeds a cap goes round again
        w, over = sum(weight[s] for s in free), 0.0
        for s in list(free):
            want[s] += left * weight[s] / w
        for s in list(free):
            if want[s] >= 2 * total[s]:
                over += want[s] - 2 * total[s]
                want[s] = 2.0 * total[s]
                free.discard(s)
        left = over
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9) and r.source_size == total[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert taken[s] == pytest.approx(want[s], rel=0.03, abs=3)
    again = mixing.mix(docs.repartition(3))
    key = lambda x: sorted(((r.doc_id, r.size, r.taken) for r in x), key=str)
    assert key(got) == key(again.collect())


def test_sainte_lague(spark):
    rnd = random.Random(2)
    for n, seats in ((1, 7), (3, 10), (40, 1000), (40, 17)):
        votes = [(0, i, float(rnd.choice([1, 5, 100, 1000]) * rnd.random() + 0.01)) for i in range(n)]
        d = spark.createDataFrame(votes, "g int, k int, v double").withColumn("seats", F.lit(float(seats))).withColumn("most", F.lit(10**9))
        got = {r.k: r.won for r in mixing.sainte_lague(d, ["g"], ["k"], "v", "seats", "most", "won").collect()}
        want = Counter()
        for _ in range(seats):
            _, k = max(((v / (2 * want[k] + 1), -k) for _, k, v in votes))
            want[-k] += 1
        assert got == {k: want[k] for _, k, _ in votes}


def test_mixed_documents(docs, rows):
    d = mixing.mixed_documents(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    assert d.columns == docs.columns
    plan = {r.doc_id: r.taken for r in mixing.mix(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    got, texts = Counter(), {i: t for i, t, _ in rows}
    for r in d.collect():
        got[r.doc_id] += len(r.text.encode().split())
        it = iter(texts[r.doc_id].encode().split())
        assert all(w in it for w in r.text.encode().split())  # its words, in their order
    assert got == Counter({i: n for i, n in plan.items() if n})
