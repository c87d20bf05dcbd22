"""N-gram join, decontamination, token files, packing, chat formatting, URL filter, pipeline."""

import hashlib
import io
import random
import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tranche.llm import (chat_format as H, decontam as D, ngram_join as N, packing as P, token_files as K, tokens, url_filter as U)
from tranche.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def copies(seed, n=160):
    """Texts with exact copies, near copies of all degrees, and shared passages."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocab, k=60))
    texts = []
    for _ in range(n):
        r = rng.random()
        if texts and r < 0.6:
            words = rng.choice(texts[-12:]).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words = words[:rng.randint(1, len(words) + 5)]
            texts.append(" ".join(words))
        else:
            words = rng.choices(vocab, k=rng.choice([0, 1, 3, 5, 8, 20, 60, 150]))
            texts.append(" ".join(words) + (" " + passage if rng.random() < 0.4 else ""))
    return [(i * 3 % 997, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("settings", [{}, {"block_docs": 3, "hubs": 1, "signature_bits": 64, "fan": 2, "chunk": 50},
                                      {"block_shingles": 150, "hubs": 2, "fan": 3}])
def test_components_against_brute_force(spark, settings):
    rows = copies(len(settings))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = N.near_duplicates(docs, replace(N.Settings(), **settings)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_texts_that_share_an_id(spark):
    """Linked only by the id that is the smallest of both their classes."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (9, c), (9, c + " and more words of it"), (1, a + " x"), (9, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs).collect())
    assert got == sorted([(3, 26, 1), (5, 26, 1), (5, 26, 5), (7, 26, 5), (9, 26, 9), (9, 31, 9), (1, 27, 1), (9, 26, 5)])


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    """A path of 1,500 nodes with mixed numbers, as neighbours of a common part make it, and a few of a descending one."""
    rng, rounds, stored = random.Random(5), [], N.C.stored
    order = rng.sample(range(1_500), 1_500)
    monkeypatch.setattr(N.C, "stored", lambda df, what: rounds.append(what) or stored(df, what))
    path = list(zip(order, order[1:])) + [(x, x - 1) for x in range(2_040, 2_000, -1)] + [(3_000, 3_000), (None, 7)]
    got = {r["node"]: r["component"] for r in N.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {x: 0 for x in range(1_500)} | {x: 2_000 for x in range(2_000, 2_041)}
    assert rounds.count("labels") <= 14


def test_shingle_sets_are_those_of_the_words():
    """Words of one to 200 bytes, all white space, texts that end within a word, nulls, slices of a batch."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcÀß字Z.") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200])))
    texts = [None, "", " \t\n\r\x0b\x0c", "one", "\u00a0\x1c\x85", "a b c d e", "A  b\nC d E f"] + [
        rng.choice(["", " ", "\n"]) + "".join(w + rng.choice([" ", "\t", "\r\n  "]) for w in rng.choices([word() for _ in range(9)], k=rng.choice([1, 3, 4, 5, 6, 40])))
        + rng.choice(["", "end"]) for _ in range(200)]
    column = pa.array(["cut", *texts, "off"])[1:-1]
    x, off = N.shingle_sets(column, 5)
    known, back = {}, {}
    for text, i, j in zip(texts, off[:-1], off[1:]):
        w = (text or "").encode().lower().split()
        want = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        assert len(want) == j - i and (np.diff(x[i:j].astype(object)) > 0).all()
        assert known.setdefault(frozenset(want), tuple(x[i:j])) == tuple(x[i:j])
        assert back.setdefault(tuple(x[i:j]), frozenset(want)) == frozenset(want)


def test_parts_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    s = N.Settings()
    for _ in range(500):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        drop = rng.random(len(a)) < rng.uniform(0, 0.2)
        b = np.unique(np.concatenate([a[~drop], rng.integers(0, 1 << 62, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(N.parts(a, s), N.parts(b, s)))


def test_join_odd_rows(odd_documents, no_documents):
    rows = N.near_duplicates(odd_documents).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 11
    assert got[8]["component_id"] == got[1]["component_id"] == 1
    assert got[2]["n_shingles"] == 0 and got[2]["component_id"] == 2 and got[6]["component_id"] == 6
    assert N.near_duplicates(no_documents).count() == 0


def brute_hits(text, items):
    import re
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = split(text)
    hit, names = set(), set()
    for name, t in items:
        v = split(t)
        n = min(len(v), 10)
        for i in range(len(v) - n + 1 if v else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == v[i:i + n]:
                    hit |= set(range(j, j + n))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("settings", [D.Settings(), D.Settings(broadcast_windows=0)])
def test_decontamination_against_brute_force(spark, odd_documents, no_documents, settings):
    rng = random.Random(9)
    v = "the of Éa éa b2 c D e-f".split()
    items = [(i, " ".join(rng.choices(v, k=rng.choice([1, 2, 3, 10, 14])))) for i in range(8)] + [(8, None), (9, "cat sat on"), (9, "12"), (None, "the")]
    docs = [(i, ". ".join(rng.choices(v, k=40)) + " " + rng.choice(items[:8])[1].upper().replace("É", "é")) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, settings).collect()
    want = {i: brute_hits(t, [x for x in items if x[0] is not None]) for i, t in docs}
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want
    odd = D.contamination(odd_documents, bench, settings).collect()
    assert len(odd) == 11 and {r["n_items"] for r in odd if r["doc_id"] == 1} == {1} and [r["n_words"] for r in odd if r["doc_id"] == 2] == [0]
    assert D.contamination(no_documents, bench, settings).count() == 0
    assert D.contamination(odd_documents, bench.limit(0), settings).where("contaminated").count() == 0
    assert D.drop_contaminated(odd_documents, bench, settings).columns == odd_documents.columns


def test_encoder_equals_library():
    e = tokens.Encoder(tokens.vocabulary_path())
    assert e.cut
    rng = random.Random(4)
    letters = "ab é,.\n '\t  sS1|!ñ́\u00a0\u3000語\U0001f600"
    texts = ["", " ", "<|endoftext|> a", *("".join(rng.choices(letters, k=rng.randint(0, 16))) for _ in range(3000))]
    for t, got in zip(texts, e(texts)):
        assert got.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def ids_of(rows, end):
    e = tokens.Encoder(tokens.vocabulary_path())
    return [(i, e.tokenizer.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in rows]


def test_token_files_round_trip(spark, odd_documents, no_documents, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = sorted(QUERIES["op9_token_files"](spark, SF).collect(), key=lambda r: r["doc_id"])
    at = 0
    for r, (i, ids) in zip(got, ids_of(rows, 0), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for k, frame in enumerate((None, odd_documents, no_documents)):
        if frame is not None:
            folder = str(tmp_path / str(k))
            out = K.read_tokens(spark, folder, K.write_tokens(frame, folder)).collect()
            assert len(out) == frame.count()
            assert not out or [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])][:2] == [None, None]


def test_frames_are_read_alone_and_checked():
    out = io.BytesIO()
    w = K.Writer(out, np.dtype("<u2"), K.Settings(frame_ids=10))
    docs = [np.arange(k, dtype="<u2") for k in (3, 0, 25, 9, 40)]
    for i, d in enumerate(docs):
        w.add(i, d)
    w.close()
    raw = out.getvalue()
    r = K.Reader(io.BytesIO(raw), len(raw))
    assert r.ids(3).tolist() == list(range(9)) and r.frames_read == 2
    assert [r.ids(k).tolist() for k in range(5)] == [d.tolist() for d in docs]
    import zstandard
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(d.tobytes() for d in docs)
    broken = bytearray(raw)
    table = len(raw) - 9 - 12 * len(r.sizes)
    broken[table + 8] ^= 1                                         # first frame's checksum
    with pytest.raises(K.FrameError):
        K.Reader(io.BytesIO(bytes(broken)), len(raw)).ids(0)


def check_packing(pieces, want, capacity=2048):
    e, seqs, docs = {}, {}, {}
    for r in pieces:
        seqs.setdefault(r["sequence_id"], []).append(r)
        docs.setdefault(r["doc_id"], []).append(r)
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        e[rows[0]["sequence_id"]] = at
    for i, ids in want:
        at = 0
        for r in sorted(docs.pop(i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not docs
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in e.values()) / max(sum(e.values()), 1)


def test_packing_places_each_id_once(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check_packing(QUERIES["op10_packing"](spark, SF).collect(), ids_of(rows, 1)) < 0.01
    odd = P.pack(odd_documents, with_ids=True).collect()
    assert sum(r["length"] for r in odd) == sum(len(i) for _, i in ids_of([(r["doc_id"], r["text"]) for r in odd_documents.collect()], 1))
    assert all(len(r["ids"]) == r["length"] for r in odd)
    assert P.pack(no_documents).count() == 0


def test_cuts_fill_their_class():
    s = P.Settings()
    for n in range(1, 9000):
        c = P.cuts(n, s)
        assert sum(c) == n and all(x == 2048 // (2048 // x) or x <= 128 for x in c)


@pytest.mark.parametrize("settings", [H.Settings(), H.Settings(span=60, history_span=80), H.Settings(span=1, history=0)])
def test_chat_round_trip(spark, settings):
    rows = [r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    data = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows] + [
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "\\</s>[INST]<|im_end|><|im_start|>user<|im_sep|> \\n \\\\"),
        (-8, 0, None, None), (None, 0, "assistant", "x"), (-9, None, "assistant", "first"), (-9, 0, "system", "be kind"), (-9, 1, "assistant", "")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    made = H.windows(turns.withColumn("window", turns["turn"]), settings)
    got = {r["conv_id"]: r for r in H.digests(H.read_back(made)).collect()}
    convs = {}
    for c, t, role, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, ts in convs.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(ts), len(loss))
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert H.windows(turns.limit(0)).count() == 0


def test_context_repeats_system_and_history(spark):
    turns = spark.createDataFrame([(1, 0, "system", "rule"), *((1, k, "user" if k % 2 else "assistant", f"turn {k} " + "x" * 60) for k in range(1, 9))],
                                  "conv_id long, turn long, role string, text string")
    rows = H.windows(turns, H.Settings(span=50, history_span=45, history=2)).orderBy("window").collect()
    assert rows[0]["n_context"] == 0 and len(rows) > 2
    assert all("rule" in r["text"] for r in rows) and all(r["n_context"] == 3 for r in rows[2:])
    assert sum(len(r["loss"]) for r in rows) == 4


def brute_url(url):
    import re
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def test_urls_and_rules(spark):
    from tranche.llm.queries import RULES
    urls = ["http://A.example.NET/en/1?x", "http://example.net/en", "http://x.net", "http://x.net/", "ftp://a.org/fr/2#f", "HTTP://É.org/FR/2",
            "http://example.com/de/", "http://notexample.com/de/", None, "no scheme", "", "http://", "a://b://c/d?e://f", "http://h?q/x", "http://net/a\nb"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, bad int")
    got = {r["page_id"]: r for r in U.judge(df, RULES).collect()}
    for i, u in enumerate(urls):
        host, path = brute_url(u)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name)) if fits else None
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule.name), u
        assert got[i]["verdict"] == (rule.verdict if rule else "allow")
    assert U.judge(df.limit(0), RULES).count() == 0


def test_templates_reject_bad_branches(spark):
    rows = [(i, f"http://h.example/{'spam' if i % 3 == 0 else 'news'}/{i}/a", 1 if i % 3 == 0 else 0) for i in range(300)]
    rows += [(1000 + i, f"http://h.example/spam/x{i}/a", None) for i in range(5)] + [(2000 + i, f"http://g.example/{w}/{i}", i % 2) for w in ("a", "b") for i in range(50)]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), []).toPandas()
    assert set(got[(got.page_id >= 1000) & (got.page_id < 2000)].verdict) == {"block"}
    assert set(got[got.path.str.startswith("/news")].verdict) == {"allow"}
    assert set(got[got.page_id >= 2000].template) == {"/*/*"}      # branches alike are merged


def test_small_bad_section_of_a_large_host_is_rejected(spark):
    rows = [(i, f"http://h.example/part{chr(97 + i % 25)}/{i}", 0) for i in range(5000)]
    rows += [(6000 + i, f"http://h.example/spam/{i}", 1) for i in range(60)]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), []).toPandas()
    assert set(got[got.page_id >= 6000].verdict) == {"block"} and set(got[got.page_id < 6000].verdict) == {"allow"}
    assert set(got[got.page_id < 6000].template) == {"/*/*"}       # sections alike are still merged


def test_bad_branches_below_four_segments_are_rejected(spark):
    kind = lambda i: "spam" if i % 2 else "news"
    rows = [(i, f"http://h.example/2024/05/01/blog/{kind(i)}/x{chr(97 + i % 7)}", i % 2) for i in range(200)]
    rows += [(1000 + i, f"http://g.example/a/b/c/d/e/f/g/{kind(i)}/{i}/z", i % 2) for i in range(200)]
    rows += [(2000 + i, f"http://f.example/a/b/c/d/e{i}/f", 0) for i in range(20)]          # nothing to split
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), []).toPandas()
    want = ["block" if "/spam/" in p else "allow" for p in got.path]
    assert len(got) == 420 and got.verdict.tolist() == want
    assert set(got[got.page_id >= 2000].template) == {"/a/b/c/d/**"}


def test_native_plans_run_no_python(spark):
    for q in ("op1_url_filter", "op5_chat_format", "op8_decontamination"):
        plan = QUERIES[q](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_pipeline_stages(spark, odd_documents, no_documents):
    import corpus_pipeline as P2
    docs = odd_documents.withColumn("window_id", odd_documents["n_words"]).withColumnRenamed("score", "rep")
    for _, stage in P2.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, no_documents, SF).count() == 0
    kept = [r["doc_id"] for r in P2.one_of_each_group(spark, docs, SF).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 2, 3, 4, 5, 6, 7] and kept.count(None) == 2
    want = brute_components([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    real = P2.one_of_each_group(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert sorted(r["doc_id"] for r in real) == sorted(i for i, (_, c) in want.items() if i == c)


def test_one_of_each_group_with_null_and_shared_ids(spark):
    import corpus_pipeline as P2
    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(None, text("a"), "x"), (None, text("a").upper(), "y"), (None, text("a").replace(" ", "  "), "z"), (9, text("a"), "x"),
            (None, text("b"), "x"), (None, text("b") + " more", "x"), (None, "", "x"), (None, None, "x"), (None, "", "x"),
            (5, text("c"), "x"), (5, text("d"), "x"), (1, text("c") + " more", "x"), (7, text("e"), "x"), (7, text("e"), "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["doc_id"], (r["text"] or "")[:2]) for r in P2.one_of_each_group(spark, docs.repartition(4), SF).collect()]
    assert sorted(got, key=str) == sorted([(9, "a0"), (None, "b0"), (None, ""), (None, ""), (None, ""), (5, "d0"), (1, "c0"), (7, "e0")], key=str)


def test_decontamination_sql(spark):
    import duckdb
    from tranche.llm.queries import ORACLE_SQL
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for q, sql in ORACLE_SQL.items():
        got, want = QUERIES[q](spark, SF).toPandas(), con.sql(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        rows = lambda d: sorted(map(repr, d[cols].astype(object).values.tolist()))
        assert rows(got) == rows(want), q


def test_a_host_of_worded_slugs_is_spread(spark, monkeypatch):
    """100,000 slugs under one node of one host: its figures are sent or met by salted rows, and no task gathers them."""
    slug = F.concat(F.lit("https://big.org/blog/"), F.translate(F.conv(F.col("id").cast("string"), 10, 26), "0123456789", "qrstuvwxyz"))
    bad = F.when(F.col("id") % 10 == 0, (F.col("id") % 30 == 0).cast("int"))
    urls = (spark.range(100_000).select(F.col("id").alias("page_id"), slug.alias("url"), bad.alias("bad"))
            .union(spark.range(400).select((F.col("id") + 1_000_000).alias("page_id"), F.concat(F.lit("https://big.org/spam/x"), F.col("id")).alias("url"), F.lit(1).alias("bad"))))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shares, join = [], U._with_nodes

    def watched(rows, figures, s, row_id):
        out = join(rows, figures, s, row_id)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        if sum(sizes) > 50_000:
            shares.append(max(sizes) / sum(sizes))
        return out

    try:
        sent = {r["page_id"]: (r["verdict"], r["template"], r["purity"]) for r in U.judge(urls, []).collect()}
        monkeypatch.setattr(U, "_with_nodes", watched)
        salted = {r["page_id"]: (r["verdict"], r["template"], r["purity"])
                  for r in U.judge(urls, [], replace(U.Settings(), broadcast_nodes=0, node_rows=5_000)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sent == salted and len(sent) == 100_400
    assert {v[0] for i, v in sent.items() if i < 100_000} == {"allow"} and {v[0] for i, v in sent.items() if i >= 1_000_000} == {"block"}
    assert {v[1] for i, v in sent.items() if i < 100_000} == {"/blog/*"}
    assert len(shares) > 3 and max(shares) < 0.25


def test_op1_takes_long_tied_and_repeated_urls(spark):
    long = "https://h.org/" + "/".join(f"seg{chr(97 + i % 26)}" for i in range(3000))
    rows = [(1, long, 1), (1, long, 1), (2, None, None), (3, "no scheme", 0), (4, "https://H.org", None), (5, "https://h.org/a?x#y", 0)]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string, bad int").withColumn("host", F.lit("clash")), [U.Rule("h.org", "/a", "block")]).collect()
    assert sorted(r["page_id"] for r in got) == [1, 1, 2, 3, 4, 5]
    by = {r["page_id"]: r for r in got}
    assert by[5]["verdict"] == "block" and by[5]["rule"] == "h.org/a" and by[4]["host"] == "h.org" and by[3]["host"] == "" == by[2]["path"]
    assert len({tuple(r) for r in got if r["page_id"] == 1}) == 1


def test_packing_takes_odd_rows(spark, odd_documents, no_documents):
    """Null and empty texts, a null id, repeated rows, a very long text, clashing columns, no rows."""
    rows = P.pack(odd_documents, with_ids=True).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r["doc_id"], []).append(r)
    n = {i: sum(r["length"] for r in rs) for i, rs in whole.items()}
    assert n[2] == n[3] == 1 and n[1] == 2 * whole[1][0]["doc_tokens"] and n[5] == whole[5][0]["doc_tokens"] > 40_000
    assert n[None] == 1 + max(r["doc_tokens"] for r in whole[None])          # the null text's end id, and the other's ids
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert P.pack(no_documents).count() == 0
