"""Encoding, licences, quotations and archives."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402

from tilewright.llm import bpe, license_scan, quoting, warc  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", "a" * 5000, " " * 3000 + "x", "\x1c\x1d a\x85b\xa0 c", "　 é'll DON'T don't", "日本語テスト" * 50, "😀😀 \n\n\t x", "  ab  \n cd  ", "½ ² 𝔘𝔫𝔦", "<|endoftext|> x", "\x00 \x7f", "a\r\nb"]


def test_ids_match_the_library(encoder):
    own, lib = encoder
    rnd = random.Random(3)
    texts = ODD + ["".join(chr(rnd.choice([32, 10, 97, 233, 0x4E00, 0x1F600, 39, 48, 28, 160, 8192, 115])) for _ in range(400)) for _ in range(40)]
    for t in texts:
        ids = np.frombuffer(own.ids(t), dtype=np.int32)
        assert ids.tolist() == lib.encode_ordinary(t), t[:40]
        assert own.text(ids) == t.encode()


def test_segment_tree_against_a_scan():
    rnd = random.Random(1)
    for n in (1, 2, 3, 17, 64):
        ranks = [rnd.choice([None, rnd.randrange(5)]) for _ in range(n)]
        tree = bpe.SegmentTree(ranks)
        for _ in range(100):
            known = [(r, i) for i, r in enumerate(ranks) if r is not None]
            assert tree.least() == (min(known)[1] if known else -1)
            i = rnd.randrange(n)
            ranks[i] = rnd.choice([None, rnd.randrange(5)])
            tree.put(i, ranks[i])


def test_encode_and_decode(spark, encoder):
    rows = [(i, t, b"x") for i, t in enumerate(ODD)] + [(None, "no id", b""), (3, ODD[3], b""), (99, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    got = bpe.decode(bpe.encode(d, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == Counter((i, tuple(encoder[1].encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)
    assert bpe.encode(d.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    rows = [
        (1, "MIT License\n\n" + mit), (2, "under the Apache License, or the APACHE-LICENSE. See mit license"), (3, "plain words only"), (4, None), (5, ""), (6, "General Public License general public license"),
        (7, "code here " * 50 + mit.replace("any person", "any one person") + " and more"), (8, "permission is hereby granted to nobody for copying software files documentation charge obtaining restriction"),
        (9, "mit lizenz MIT\x00LICENSE émit license"), (None, "mit license"), (1, "MIT License\n\n" + mit),
    ]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, labels string")
    got = sorted(license_scan.license_scan(d).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:  # the base rule by brute force
        w = license_scan.words_of(t)
        at = [(j, label) for p, label in license_scan.BASE.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.encode().split()]
        r = by[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by[1].labels == "mit" and by[1].score > 0.9 and by[7].labels == "mit" and by[7].n_base == 0
    assert by[8].labels == "" and by[3].score == 0
    assert license_scan.license_scan(d.limit(0)).count() == 0


def test_license_notices_against_a_search():
    """A notice's label is found just where its words stand consecutively, and its score is then 1."""
    templates = license_scan.with_notices({})
    index = license_scan.Index(templates, 10, {b"license": 5, b"the": 9, b"under": 7, b"by": 8})
    bodies = [body.split() for body, _ in templates.values()]
    draw = random.Random(5)
    words = sorted({w for b in bodies for w in b}) + ["x"]
    hits = 0
    for _ in range(400):
        text = []
        for _ in range(draw.randrange(12)):
            body = list(draw.choice(bodies))
            if draw.random() < 0.5:
                body[draw.randrange(len(body))] = draw.choice(words)
            text += body + draw.choices(words, k=draw.randrange(4))
        line = f" {' '.join(text)} "
        want = {k.split("/")[0] for k, (body, _) in templates.items() if f" {body} " in line}
        got = index.scan([w.encode() for w in text])
        assert set(got) == want and all(share == 1 for share, _ in got.values())
        hits += len(want)
    assert hits > 400


def test_short_license_notices(spark):
    rows = [(1, "Released under the MIT License."), (2, "Licensed under CC BY-NC 4.0"), (3, "// SPDX-License-Identifier: Apache-2.0"), (4, "This work is licensed under the GNU General Public License, version 3"), (5, "released under pressure, the license of mit")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["mit", "cc-by-nc", "apache", "gpl", ""]
    assert [got[i].score for i in range(1, 6)] == [1, 1, 1, 1, 0] and got[2].n_base == 0


def test_quotation_links(spark):
    rows = [
        (1, 0, "user", "First question here.\n\nSecond   paragraph of it."),
        (1, 1, "assistant", "> first QUESTION here.\n\nAn answer to that."),
        (1, 2, "user", ">> First question here.\n> An answer to that.\nI see.\n> never said\nBye"),
        (1, 3, "user", "> First question here.\n>\n> Second paragraph of it.\nok"),
        (2, 0, "user", "> An answer to that."),
        (3, 5, "user", None), (3, 7, "user", ""), (None, 1, "user", "> x"), (4, None, "user", "y"), (5, 0, "user", "a > b\n >indented"), (5, 0, "user", "a > b\n >indented"),
        (6, 0, "user", "later"), (6, 1, "user", "> not yet"), (6, 2, "user", "not yet"),
    ]
    d = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, level int, passage string")
    got = quoting.linked(d).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].reply_to == 0 and by[1, 1].n_linked == 1 and by[1, 1].text == "An answer to that."
    two = by[1, 2]
    assert (two.n_quotes, two.n_linked, two.max_level, list(two.originals), two.reply_to) == (3, 2, 2, [0, 1], 1) and two.text == "I see.\nBye"
    assert by[1, 3].reply_to == 0 and by[1, 3].n_linked == 1 and by[1, 3].text == "ok"
    assert by[2, 0].n_linked == 0 and by[2, 0].text == "" and by[2, 0].reply_to is None
    assert by[3, 7].reply_to == 5 and by[3, 5].position == 0 and by[3, 7].position == 1
    assert by[None, 1].position is None and by[4, None].position is None
    assert by[5, 0].text == "a > b" and by[5, 0].n_quotes == 1
    assert by[6, 1].n_linked == 0
    whole = {(r.conv_id, r.part): r.messages for r in quoting.conversations(quoting.linked(d), 2).collect()}
    assert [m.text for m in whole[1, 0]] == ["First question here.\n\nSecond   paragraph of it.", "An answer to that."] and [m.turn for m in whole[1, 1]] == [2, 3]
    assert quoting.linked(d.limit(0)).count() == 0


def test_quotations_of_several_lines(spark):
    """Two of a paragraph's three lines, two of three paragraphs, and an answer between two quotes, also with other line breaks."""
    rows = [
        (1, 0, "user", "One line here.\nA second one.\nAnd a third.\n\nNext paragraph.\n\nThe last one."),
        (1, 1, "assistant", "> a SECOND one.\n> And a third.\nFirst answer\nin two lines\n> Next paragraph.\n>\n> The last one.\nSecond answer"),
        (1, 2, "user", "Not\nquoted"),
        (1, 3, "user", ">> A second one.\n> First answer\n> in two lines\nyes"),
        (1, 4, "user", "> First answer in two\n> lines\nwell"),
        (1, 5, "user", "> One line here.\n> And a third.\nno run\n> A second one.\n> Wrong line"),
        (2, 3, "user", "> A second one.\n> And a third."),
    ]
    by = {(r.conv_id, r.turn): r for r in quoting.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(by) == len(rows)
    got = {k: (r.n_quotes, r.n_linked, list(r.originals), r.reply_to) for k, r in by.items() if r.n_quotes}
    assert got == {(1, 1): (2, 2, [0], 0), (1, 3): (2, 2, [0, 1], 1), (1, 4): (1, 1, [1], 1), (1, 5): (2, 0, [], 4), (2, 3): (1, 0, [], None)}


def test_quotations_against_sql(spark):
    rnd = random.Random(11)
    said = [f"sentence {i} of the talk" for i in range(12)]
    rows = []
    for c in range(12):
        for turn in range(8):
            lines = [rnd.choice(["", "> ", ">> ", "> > ", ">"]) + rnd.choice([*said, ""]) for _ in range(rnd.randint(1, 7))]
            rows.append((c, turn, rnd.choice(["user", "assistant"]), "\n".join(lines)))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from tests.oracle import same

    got = quoting.linked(d).select("conv_id", "position", "turn", "role", "reply_to", "n_quotes", "n_linked", F.sha2("text", 256).alias("text_sha256"))
    assert got.filter("n_linked > 0").count() > 20
    same(got, quoting.ORACLE, conversations=d.toPandas())


def test_quotations_beyond_a_block(spark):
    d = spark.range(1500).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.concat(F.lit("say "), F.col("id").cast("string"), F.when(F.col("id") == 1400, "\n> say 3").otherwise("")).alias("text"))
    got = {r.turn: r for r in quoting.linked(d.repartition(7)).collect()}
    assert all(got[i].position == i for i in range(1500))
    assert got[1400].reply_to == 3 and all(got[i].reply_to == i - 1 for i in range(1, 1500) if i != 1400) and got[0].reply_to is None


def _pages():
    rnd = random.Random(6)
    big = "".join(rnd.choice("abc <p>é") for _ in range(4000))
    return [(1, "http://a/1", big), (2, "http://a/2", big), (7, "http://a\r\n/7", big), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", big), (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "x" * 1000), (11, "u", "x" * 1000), (7, "again", big), (12, "u", "WARC/1.1\r\n\r\n" * 200), (None, "u", "y" * 2000), (None, "u", "y" * 2000)]


def test_archives(spark):
    pages = _pages()
    d = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, refers_to string").repartition(3)
    folder, index = warc.write_bundles(warc.roles(d))
    got = warc.read_bundles(folder, index, payloads=True).collect()
    best = {}
    for i, _, h in pages:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    want = Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        to = best.get(h or "") if len(raw) >= 1000 and i != best.get(h or "") else None
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to, raw if to is None else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    for r in index.filter("page_id = 10 or page_id = 12").collect():  # through the index, one frame each
        fields, block = warc.read_record(folder, r.bundle, r.frame, r.at)
        assert fields["WARC-Record-ID"] == f"<urn:x-page:{r.page_id}>"
    folder, index = warc.write_bundles(warc.roles(d.limit(0)))
    assert warc.read_bundles(folder, index).count() == 0


def test_frames_and_bundles(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FRAME", 500)
    b = warc.Bundle(*warc._store(str(tmp_path / "b.zst")))
    data = [warc.record(i, f"u{i}", b"p" * (i * 37 % 400), None) for i in range(40)]
    at = [b.add(x) for x in data]
    b.close()
    import zstandard

    assert max(f for f, _ in at) > 5
    with open(tmp_path / "b.zst", "rb") as f:  # any Zstandard reader skips the footer
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(data)
    for i in (0, 17, 39):
        fields, _ = warc.read_record(str(tmp_path), "b.zst", *at[i])
        assert fields["WARC-Record-ID"] == f"<urn:x-page:{i}>"
