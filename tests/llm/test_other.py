"""Toxicity, media, URLs, vectors, WARC, shards and the pipeline."""

import gzip
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from helpers import clashing, corpus, empty, frame
from pyspark.sql import functions as F

from tabulon.llm import kmtree, matroska, toxicity, urlgbt, warc
from tabulon.llm.common import new_path, ship
from tabulon.llm.queries import URL_RULES
from tabulon.llm.sharding import Conflict, Shard, ShardTable, Tiers

# --- toxicity ---


def marked(tokens):
    nxt, outs = toxicity.grammar()
    q, got = 0, []
    for c in tokens:
        o = outs[q][c]
        q = nxt[q][c]
        if o:
            got.append((toxicity.FEATURES[o[0]], o[1]))
    return got


def test_grammar_marks_clauses():
    T = toxicity
    assert marked([T.OTHER, T.STRONG]) == [("insult", 1.0)]
    assert marked([T.TARGET, T.OTHER, T.STRONG])[0][0] == "insult_targeted"
    assert [m for m, _ in marked([T.STRONG, T.TARGET])] == ["insult", "insult_targeted"]
    assert marked([T.NEGATION, T.OTHER, T.STRONG])[0][0] == "insult_negated"
    assert marked([T.NEGATION, T.OTHER, T.OTHER, T.OTHER, T.STRONG])[0][0] == "insult"
    assert marked([T.NEGATION, T.END, T.STRONG])[0][0] == "insult"
    assert marked([T.REPORT, T.OTHER, T.THREAT])[0][0] == "threat_reported"


def test_words_are_found_between_any_marks():
    model = toxicity.learn([])
    lexicon = model.lexicon()
    found = lambda t: {f: v for f, v in zip(toxicity.FEATURES, toxicity.clause_features(t, lexicon), strict=True) if v}
    plain = found("you are an idiot")
    assert plain == {"insult_targeted": 1.0}
    for gap in ("\t", "\u00a0", "\u2003", "\u3000", "\r", "\u200b", ",", "/", "-", " - ", "\u2014", "'", '"'):
        assert found(gap.join("you are an idiot".split())) == plain, repr(gap)
    for t in ("such\u00a0idiot\u00a0moron", "go,idiot,go", "(idiot)", "l'idiot", "idiot's"):
        assert found(t) == {"insult": 1.0}
    assert found("idiot.moron") == found("idiot!\"moron") == found("idiot\nmoron") == {"insult": 2.0}
    assert found("you 3.5 idiot") == found("you 12:30 idiot") == {"insult_targeted": 1.0}
    assert found("you.Idiot") == found("you.\" idiot") == {"insult": 1.0}
    assert found("isn't an idiot") == found("isn't\tan\tidiot") == {"insult_negated": 1.0}
    assert found("") == found(" \t\n") == found("...") == found("you are fine") == {}


def test_long_texts_leave_the_other_labelled_rows_in_the_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "learn", lambda rows: rows)
    rows = [(i, ("word " * 400 if i % 10 == 0 else f"text {i}"), "en", "s", 1) for i in range(50)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    got = toxicity.train(frame(spark, rows), labels, max_chars=3000)
    assert len(got) == 50 and sum(y for _, y in got) == 25 and sum(len(t) for t, _ in got) <= 3000
    assert {t for t, _ in got if t.startswith("text")} == {t for _, t, *_ in rows if t.startswith("text")}
    assert {len(t) for t, _ in got if t.startswith("word")} == {375}
    whole = toxicity.train(frame(spark, rows), labels)
    assert sorted(t for t, _ in whole) == sorted(r[1] for r in rows)


def test_model_learns_and_generalises(spark):
    ship(spark)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = [word() for _ in range(30)]
        for _ in range(3 if bad else 0):
            words[rng.randrange(30)] = rng.choice(["zorgle", "qwib" + word()])
        rows.append((i, " ".join(words) + ".", "en", "s", 1))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None, None, None, None), (2001, "", None, None, None), (None, "zorgle", None, None, None), (5, rows[5][1], "en", "s", 1)]
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3000, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(clashing(spark, rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    assert {r.predicted for r in got if r.doc_id in (2000, 2001)} == {0}
    assert toxicity.toxicity(empty(spark), marks.limit(0)).count() == 0
    plain = toxicity.toxicity(frame(spark, [(1, "you are an idiot", "", "", 1), (2, "you are not an idiot", "", "", 1)]), marks.limit(0))
    score = {r.doc_id: r.score for r in plain.collect()}
    assert score[1] > 0.5 > score[2]


# --- Matroska ---


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, 3_000_000])
def test_media_round_trip(n):
    data = os.urandom(n)
    media = matroska.mux(matroska.payload(data))
    m = matroska.parse(media)
    assert matroska.demux(media, m) == matroska.payload(data)
    assert m.doc_type == "matroska" and m.tracks[0]["codec"] == "A_PCM/INT/LIT" and len(m.cues) == m.clusters
    assert all(matroska.read_id(memoryview(media), at)[0] == matroska.CLUSTER for _, _, at in m.cues)
    assert [p.timestamp for p in m.packets] == [i * 24_000_000 for i in range(len(m.packets))]


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacing(lacing):
    rng = random.Random(lacing)
    for _ in range(100):
        n = 1 if not lacing else rng.randint(1, 9)
        parts = [os.urandom(50 if lacing == matroska.FIXED else rng.randint(0, 900)) for _ in range(n)]
        body = matroska.block(3, -5, parts, lacing)
        track, rel, _, found = matroska.frames(memoryview(body), 0, len(body))
        assert (track, rel) == (3, -5) and [body[o : o + k] for o, k in found] == parts


def test_unknown_sizes_groups_and_errors(spark):
    ship(spark)
    m = matroska
    cluster = b"\x1f\x43\xb6\x75\xff" + m.uint(m.CLUSTER_TIMESTAMP, 7) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(1, 1, [b"ab"])) + m.uint(m.BLOCK_DURATION, 1))
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm"))
    data = head + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + cluster + cluster + m.element(0xEC, b"void")
    got = m.parse(data)
    assert [(p.timestamp, data[p.offset : p.offset + p.size]) for p in got.packets] == [(8_000_000, b"ab")] * 2
    for bad in (b"", b"junk", data[:-30]):
        if bad:
            with pytest.raises(m.BadMedia):
                m.parse(bad)
    df = spark.createDataFrame([(1, data), (2, data[:-30]), (3, None), (4, m.mux(m.payload(b"x")))], "doc_id long, media binary")
    rows = m.packet_table(df).collect()
    assert [r.doc_id for r in rows if r.error] == [2] and sum(r.doc_id == 1 for r in rows) == 2 and not any(r.doc_id == 3 for r in rows)


def test_media_column(spark):
    ship(spark)
    rows = corpus(2, 10)
    got = {r.doc_id: r for r in matroska.media_column(clashing(spark, rows)).collect()}
    for r in rows:
        raw = (r[1] or "").encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        g = got[r[0]]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert g.media_bytes == len(g.media) and hashlib.sha256(g.media).hexdigest() == g.media_sha256
    assert matroska.media_column(empty(spark)).count() == 0


# --- URLs ---


def test_urls(spark):
    ship(spark)
    rng = random.Random(4)
    cases = [
        (0, "http://a.b.com/en/5", "a.b.com", "/en/5", "com/en/", "block"), (1, "https://WWW.Example.COM/en/7x?y=/de/", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"), (3, "http://example.net/de/81#z", "example.net", "/de/81", "example.net/de/8", "block"),
        (4, "http://notexample.net/de/81", "notexample.net", "/de/81", "net/de/", "allow"), (5, "http://org/es/", "org", "/es/", "org/es/", "block"), (6, "http://a.com?x=/en/", "a.com", "", None, None),
        (7, None, "", "", None, None), (8, "a.com/en/", "", "", None, None), (9, "http://a.com/EN/", "a.com", "/EN/", None, None), (10, "://a.com/en/\n1", "a.com", "/en/\n1", "com/en/", "block"),
    ]
    more = [(100 + i, f"http://h{rng.randrange(9)}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(9999)}") for i in range(400)]
    df = spark.createDataFrame([c[:2] for c in cases] + more + [more[0]], "page_id long, url string").withColumn("html", F.lit("x")).withColumn("host", F.lit("clash"))
    rows = urlgbt.judge_urls(df, URL_RULES).collect()
    assert len(rows) == len(cases) + 401 and all(r.verdict in ("allow", "block") for r in rows)
    got = {r.page_id: r for r in rows}
    for i, _, host, path, rule, verdict in cases:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict
    assert urlgbt.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_equal_rules_and_suffix_counts(spark):
    ship(spark)
    df = spark.createDataFrame([(i, f"http://h{i % 3}.x.com/a/{i}.HTML") for i in range(30)] + [(50, "http://q.org/z"), (51, None)], "page_id long, url string")
    rows = urlgbt.judge_urls(df, [("com", "/a/1", "block"), ("x.com", "/a", "allow"), ("h1.x.com", "", "block"), ("h0.x.com", "", "allow"), ("x.com", "/b", "block")]).collect()
    got = {r.page_id: (r.rule, r.verdict) for r in rows}
    assert got[10] == ("h1.x.com", "block") and got[2] == ("x.com/a", "allow") and got[0] == ("h0.x.com", "allow")
    assert urlgbt.rule_of(F.lit("a.com"), F.lit("/p"), [("com", "/p", "block"), ("a.com", "", "allow")])
    tie = df.limit(1).select(*urlgbt.rule_of(F.lit("a.com"), F.lit("/pq"), [("com", "/p", "block"), ("a.com", "", "allow")])).first()
    assert tuple(tie) == ("com/p", "block")  # as long as the other, listed first
    known = urlgbt.with_rates(urlgbt.labelled(df, [("h1.x.com", "", "block"), ("h0.x.com", "", "allow")]), smooth=2)
    want = (10 + 2 * 0.5) / 22
    rows = known.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(5))).collect()
    for r in rows:
        if r.ruled is not None:  # its own part of the URLs isn't counted
            others = [x for x in rows if x.ruled is not None and x.part != r.part]
            rate = (sum(x.ruled == "block" for x in others) + 2 * 0.5) / (len(others) + 2)
            assert r.host_suffix_rate == r.domain_rate == r.path_suffix_rate == pytest.approx(rate)
        elif r.page_id is not None and r.page_id < 30:
            assert r.host_suffix_rate == r.domain_rate == r.path_suffix_rate == pytest.approx(want)
        else:
            assert r.domain_rate == pytest.approx(0.5)


def test_lexical_features_by_hand():
    url, host, path = "https://a1.bc.org/p/q22-x?y=1&z=2#f", "a1.bc.org", "/p/q22-x"
    got = dict(zip(urlgbt.FEATURES, urlgbt.lexical(url, host, path), strict=False))
    assert (got["length"], got["host_length"], got["path_length"], got["depth"], got["labels"]) == (len(url), 9, 8, 2, 3)
    assert got["digits"] == pytest.approx(5 / len(url)) and got["host_digits"] == pytest.approx(1 / 9)
    counts = [host.count(c) / 9 for c in set(host)]
    assert got["host_entropy"] == pytest.approx(-sum(x * np.log2(x) for x in counts))
    assert (got["parameters"], got["query_length"], got["fragment"], got["punctuation"], got["longest_segment"], got["longest_number"], got["secure"]) == (2, 7, True, 6, 5, 2, True)


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = urlgbt.boost(x[:2000], y[:2000])
    assert ((model.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.95


# --- vectors ---


def test_search_recall_and_edges(spark):
    ship(spark)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16)) * 2
    x = np.float32(centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)))
    x[1000:2000] = x[1000]  # a third of all rows: one vector
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [float("nan")] * 16, 1), (5300, [None] * 16, 1), (5400, [1.0] * 3, 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("leaf", F.lit("clash"))
    p = kmtree.Search(block_rows=128)
    got = kmtree.nearest_neighbours(df, F.col("vec_id") % 100 == 0, p=p).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 100))
    hit = 0
    for q, found in by.items():
        found.sort()
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10].tolist()
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in found)
        hit += len(set(want) & {f[1] for f in found})
        if 1000 <= q < 2000:
            assert [f[1] for f in found] == want
    assert hit >= 0.9 * 10 * len(by)
    assert kmtree.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = kmtree.nearest_neighbours(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


def test_recall_is_measured_on_other_queries(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(2000, 6)))], "vec_id long, embedding array<double>")
    report = kmtree.recall_report(df, F.col("vec_id") % 20 == 0)
    assert report.queries == 40 and report.recall >= 0.9 and 0 < report.rows_read < 1 and 0 < report.visits <= report.leaves


def test_search_gives_outliers_all_their_candidates(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat(rng.normal(size=(20, 4)), 100, axis=0), 1000 + 100 * rng.normal(size=(6, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = kmtree.nearest_neighbours(df, "vec_id % 50 = 0 or vec_id = 2001", p=kmtree.Search(leaf_rows=2, recall=0.9)).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r["rank"])
    assert set(by) == {*range(0, 2001, 50), 2001} and all(sorted(v) == list(range(1, 11)) for v in by.values())
    few = kmtree.nearest_neighbours(df.where("vec_id >= 1996"), "vec_id = 2001", p=kmtree.Search(leaf_rows=2)).collect()
    assert {r.vec_id for r in few} == {*range(1996, 2006)} - {2001}


def test_search_keeps_tables_off_the_driver(spark, capsys):
    import re

    ship(spark)
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(3000, 8)))], "vec_id long, embedding array<double>").repartition(6)
    got = kmtree.nearest_neighbours(df, "vec_id % 20 = 0", p=kmtree.Search(sample_rows=500))
    capsys.readouterr()
    got.explain("formatted")
    sent = re.findall(r"\) BroadcastExchange\s+Input \[\d+\]: \[([^\]]*)\]", capsys.readouterr().out)
    assert sent and not any(re.search(r"\b(v|q)#", columns) for columns in sent), sent  # neither side's vectors are broadcast
    assert got.count() == 1500
    rows = kmtree.usable(df.unionByName(df.where("vec_id < 9")), "vec_id", "embedding")  # repeated ids share a hash
    for n in (1, 500, 3009, 5000):
        want = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()]
        assert np.array_equal(kmtree.sampled(rows, n), np.array(want))
    assert len(kmtree.sampled(rows.limit(0), 5)) == 0


# --- WARC ---

PAGE = "<!DOCTYPE html><html lang='fr'><head><title>A &amp; b</title><style>p{}</style></head><body><!-- no --><script>var t='</p>';</script><h1>Head</h1><p>one <b>two</b><br>three &lt;x&gt;<a href='/l?a=1&amp;b=2'>link</a></body></html>"


def test_warc_records():
    source = warc.response("http://e.com/é", PAGE.encode(), "2024-01-01T00:00:00Z")
    for zipped in (False, True):
        stream = warc.to_bytes(source, zipped) * 2
        back = list(warc.read_records(stream))
        assert len(back) == 2 and back[0].block == source.block and back[0].get("warc-record-id") == source.get("WARC-Record-ID")
    meta, text = warc.derive(source)
    assert text.block.decode() == "Head\none two\nthree <x>link"
    assert meta.get("WARC-Refers-To") == text.get("WARC-Refers-To") == source.get("WARC-Record-ID")
    assert meta.get("WARC-Concurrent-To") == text.get("WARC-Record-ID") and text.get("WARC-Block-Digest") == warc.digest(text.block)
    fields = meta.block.decode()
    for line in ("title: A & b", "language: fr", "outlink: /l?a=1&b=2", "source-header-content-type: text/html; charset=utf-8", f"source-payload-digest: {warc.digest(PAGE.encode())}", "source-status: HTTP/1.1 200 OK"):
        assert line in fields
    assert [r.get("WARC-Type") for r in warc.derive(warc.response("u", b"\x00\x01", "d", "image/png"))] == ["metadata"]
    with pytest.raises(ValueError):
        list(warc.read_records(warc.to_bytes(source)[:-40]))


def test_warc_text_without_end_tags():
    text = warc.visible_text
    assert text("<html><head><title>t</title><body><p>all of this page</p>") == "all of this page"
    assert text("<head><meta charset=utf-8><title>t<p></title><script>'<p>no'</script><p>one<p>two") == "one\ntwo"
    assert text("<head><title>t</title>words only") == "words only"
    assert text("<head><title>t</head><body>a<svg><title>no</title></svg>b") == "a b"
    for x in ("svg", "noscript", "template", "script", "style"):
        assert text(f"<p>a<{x}/>b</p><{x}>no</{x}><p>c</p>") == "ab\nc"
    for x in ("svg", "noscript", "template"):
        assert text(f"<p>a<{x}>b</p><p>c</p>") == "ab\nc"
        assert text(f"<p>a<{x}>b</p><{x}>no</{x}><p>c</p>") == "ab\nc"
        assert text(f"a<{x}>no<{x}>no</{x}>no</{x}>b") == "a b"
        assert text(f"a<{x}-y>b</{x}-y>c") == "abc"
    assert text("a<svg><template>no</svg>b</template>c") == "a bc"
    for x in ("<script>", "<style>", "<!--"):
        assert text(f"<p>a</p>{x}no<p>no") == "a"


def test_warc_frames(spark, tmp_path):
    ship(spark)
    df = spark.createDataFrame([(1, "http://a.com/", PAGE), (2, None, None), (3, "u", ""), (1, "http://a.com/", PAGE)], "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    rows = warc.derivatives_of_pages(df).collect()
    assert len(rows) == 8 and len({r.record_id for r in rows}) == 6
    assert {r.content_length for r in rows if r.page_id in (2, 3) and r.record_type == "conversion"} == {0}
    assert warc.derivatives_of_pages(df.limit(0)).count() == 0
    (tmp_path / "x.warc.gz").write_bytes(warc.to_bytes(warc.Record([("WARC-Type", "warcinfo")], b"i"), True) + warc.to_bytes(warc.response("u", PAGE.encode(), "d"), True))
    files = warc.derivatives_of_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [r.record_type for r in files] == ["metadata", "conversion"]
    assert gzip.decompress(files[1].record).startswith(b"WARC/1.1\r\nWARC-Type: conversion")


def test_broken_warc_files_give_a_row(spark, tmp_path):
    ship(spark)
    good = warc.to_bytes(warc.response("u", PAGE.encode(), "d"))
    (tmp_path / "a.warc").write_bytes(good + good.replace(b"Content-Length: ", b"Content-Length: x", 1))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good)[:-20])
    (tmp_path / "c.warc").write_bytes(good)
    rows = warc.derivatives_of_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    by = {n: [r.record_type for r in rows if r.path.endswith(n)] for n in ("a.warc", "b.warc.gz", "c.warc")}
    assert by == {"a.warc": ["metadata", "conversion", "error"], "b.warc.gz": ["error"], "c.warc": ["metadata", "conversion"]}
    assert b"Content-Length" in next(r.block for r in rows if r.record_type == "error" and r.path.endswith("a.warc"))


def test_coded_bodies_are_undone():
    packed = gzip.compress(b"<p>hello</p>")
    chunks = b"".join(f"{len(packed[i : i + 7]):x};n=1\r\n".encode() + packed[i : i + 7] + b"\r\n" for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks
    r = warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Target-URI", "u"), ("WARC-Date", "d")], block)
    assert warc.derive(r)[1].block == b"hello"
    assert warc.unwrapped([("Content-Encoding", "gzip")], b"plain") == b"plain"


# --- shards ---


def test_shards(spark):
    docs = clashing(spark, corpus(6, 80))
    t = ShardTable(spark, new_path(spark, "shards-test"), Tiers(target_bytes=60_000, least_bytes=1_000, fanout=3, groups_a_job=2))
    with pytest.raises(FileNotFoundError):
        t.read()
    t.append(docs.limit(0))
    assert t.read().count() == 0 and t.read().columns == docs.columns
    t.append_arrivals(docs.repartition(3).withColumn("arrival", F.pmod("doc_id", F.lit(4))).select(*docs.columns, "arrival").drop("arrival").withColumn("Doc", F.pmod("doc_id", F.lit(4)).cast("string")), "Doc")
    before = t.load()
    many = len(before.shards)
    t.append(docs.repartition(8))
    rows = lambda v=None: sorted((r.doc_id, r.text or "") for r in t.read(v).collect())
    all_rows = rows()
    after = t.compact()
    assert len(after.shards) < many + 8 and rows() == all_rows and len(all_rows) == 2 * 84
    assert not t.groups(after) and len(rows(before.version)) == 84
    assert t.vacuum() > 0 and rows() == all_rows
    newest = t.load()
    with pytest.raises(Conflict):
        t._publish(newest)
    with pytest.raises(Conflict):
        t.commit([], {"data/none"})
    assert t.commit([Shard("data/x/part-0", 5, 0, 0)]).version == newest.version + 1


def test_root_names_that_repeat_and_clashing_columns(spark):
    t = ShardTable(spark, new_path(spark, "t") + "/j/root/t")
    df = spark.createDataFrame([(i, i % 3, "kept") for i in range(9)], "doc_id long, arrival long, arrival_value string").withColumn("__arrival", F.lit("kept too"))
    t.append_arrivals(df, "arrival")
    assert {(r.arrival_value, r["__arrival"]) for r in t.read().collect()} == {("kept", "kept too")} and t.read().count() == 9


def test_arrivals_of_any_name(spark, monkeypatch):
    names = ["a b", "2024-01-01 00:00:00", "x%3Ay", "50%", "a+b", "é/ü?#", "{a,b}*[c]", "a=b", "", None, "7"]
    df = spark.createDataFrame([(i, names[i % len(names)]) for i in range(110)], "doc_id long, arrival string")
    t = ShardTable(spark, new_path(spark, "shards-names"))
    assert len(t.append_arrivals(df.repartition(2), "arrival")) == len(names) - 1  # '' and null are one
    rows = lambda: sorted((r.doc_id, r.arrival or "") for r in t.read().collect())
    want = sorted((i, names[i % len(names)] or "") for i in range(110))
    assert rows() == want and sum(s.rows for s in t.load().shards) == 110
    t.compact()
    t.vacuum()
    assert rows() == want
    t.append_arrivals(df.limit(0), "arrival")
    assert rows() == want
    version = t.load().version
    counts = ShardTable._counts_by_path
    monkeypatch.setattr(ShardTable, "_counts_by_path", lambda *a: {})
    with pytest.raises(RuntimeError):
        t.append_arrivals(df, "arrival")
    monkeypatch.setattr(ShardTable, "_counts_by_path", lambda *a: {k: n - 1 for k, n in counts(*a).items()})
    with pytest.raises(RuntimeError):
        t.append_arrivals(df, "arrival")
    assert t.load().version == version


@pytest.mark.parametrize("chain", [1, 4, 1000])
def test_manifests_of_changes_add_up(spark, chain):
    """Every version, read by a fresh reader or one that follows, holds what plain lists would; changes are small."""
    root, rng = new_path(spark, "shards-changes"), random.Random(chain)
    writer, follower, live, want = ShardTable(spark, root, Tiers(chain=chain)), ShardTable(spark, root), {}, {}
    for i in range(1, 31):
        drop = set(rng.sample(sorted(live), min(len(live), rng.choice((0, 0, 0, 2)))))
        add = [Shard(f"data/{i}/part-{k}", k, i, 0) for k in range(rng.choice((0, 1, 1, 3)))]
        assert writer.commit(add, drop, schema="s").version == i
        live = {p: x for p, x in live.items() if p not in drop} | {x.path: x for x in add}
        want[i] = tuple(live.values())
        if i % 7 == 0:
            assert follower.load().shards == want[i]
    fresh = ShardTable(spark, root)
    assert all(fresh.load(i).shards == want[i] for i in (30, *range(1, 31)))
    assert all(ShardTable(spark, root).load(i).shards == want[i] for i in (1, 2, 17, 29))
    kinds = ["shards" in fresh._read(i) for i in range(1, 31)]
    assert kinds[0] and all(any(kinds[max(0, i - chain) : i + 1]) for i in range(30)) and (chain == 1) == all(kinds)


def test_tiers():
    t = Tiers(target_bytes=64, least_bytes=1, fanout=4)
    assert [t.tier(s) for s in (0, 1, 3, 4, 15, 16, 63, 64, 1000)] == [0, 1, 1, 2, 2, 3, 3, 3, 3]


# --- pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from test_text_dedup import components

    rows = corpus(9, 80) + [(700, "you stupid idiot, you pathetic loser", "en", "s", 1)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = clashing(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{name}"))
        seen[name] = docs.collect()
    assert {r.doc_id for r in seen["toxicity"]} == {r[0] for r in rows} - {700}
    want, _ = components([tuple(r) for r in seen["toxicity"]])
    assert {r.doc_id for r in seen["minhash_near_dedup"]} == {i for i, v in want.items() if v[2]}
    assert {r.doc_id for r in seen["mixing_sources"]} == {r.doc_id for r in seen["suffix_array_dedup"]} == {r.doc_id for r in seen["minhash_near_dedup"]}
    assert {r.doc_id for r in seen["best_fit_packing"]} == {r.doc_id for r in seen["mixing_sources"]}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["best_fit_packing"])


def test_search_among_vectors_of_one_length(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 2.0, 3.0]), *((i, [float(v) for v in rng.normal(size=2)]) for i in range(1, 60)), (100, [1.0, 2.0, 4.0]), (101, [0.0, 2.0, 3.0]), (200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by = {}
    for r in kmtree.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect():
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(by) == [0, 50, 100] and by[0] == [100, 101] and by[100] == [0, 101] and len(by[50]) == 10
    assert kmtree.recall_report(df, "vec_id > 0").recall >= 0.9
    with pytest.raises(ValueError):
        kmtree.lengths(spark.createDataFrame([(i, [1.0] * (i + 1)) for i in range(5)], "vec_id long, v array<double>"), "vec_id >= 0", most=4)
