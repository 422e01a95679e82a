"""Each operator against brute force or a round trip, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lullcast.llm import boost, decontaminate, gif, langmodel, minhash, pii, substrings, textvec, tokencount, toxicity, transducer, urls, work

EDGES = [(1, None), (2, ""), (3, " "), (4, "a b c"), (5, "a b c"), (6, "é日𝄞 x\n"), (7, "word " * 5000)]


def table(spark, rows, extra=("score", "ids", "spans", "host")):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("other") for c in extra})


def empty(spark):
    return table(spark, [])


# --- shared pieces -----------------------------------------------------------------------


def test_span_hashes_do_not_depend_on_place():
    buf = np.frombuffer(b"xabcyyabc", np.uint8)
    p = textvec.prefix_hash(buf)
    a = textvec.span_hash(p, np.array([1, 6, 0]), np.array([4, 9, 3]))
    assert a[0] == a[1] != a[2]


def test_word_spans_stay_within_texts():
    buf, offs = textvec.utf8(pa.array(["ab", "cd e", None, ""]))
    s, e, at = textvec.word_spans(buf, offs, np.array([b != 32 for b in range(256)]))
    assert [(buf[a:b].tobytes()) for a, b in zip(s, e, strict=True)] == [b"ab", b"cd", b"e"] and at.tolist() == [0, 1, 3, 3, 3]


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = boost.fit(x[:600], y[:600])
    assert ((m.predict(x[600:]) > 0.5) == y[600:]).mean() > 0.95
    assert boost.threshold_for(np.array([0.9, 0.8, 0.2]), np.array([1, 1, 0]), 0.99) == 0.8
    assert boost.fit(np.zeros((0, 2)), np.zeros(0)).predict(np.zeros((1, 2)))[0] == pytest.approx(0.5)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    parent = {}
    find = lambda a: a if parent.setdefault(a, a) == a else find(parent[a])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = work.components(spark.createDataFrame(edges, "a long, b long"), work.Work(spark))
    assert {r.node: r.component for r in got.collect()} == {a: find(a) for a in list(parent)}
    assert work.components(spark.createDataFrame([], "a long, b long"), work.Work(spark)).count() == 0


# --- 1 -------------------------------------------------------------------------------------


def test_gif_payload_round_trip(spark):
    got = {r.doc_id: r for r in gif.gif_features(gif.with_gif(table(spark, EDGES))).collect()}
    for i, t in EDGES:
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[4].media_sha256 == got[5].media_sha256
    assert gif.gif_features(gif.with_gif(empty(spark))).count() == 0
    bad = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    assert [r.payload_bytes for r in gif.gif_features(bad).collect()] == [None, None]


def greedy_lzw(data: bytes, bits: int) -> bytes:
    """An ordinary dictionary encoder, with growing codes and a reset when the table is full."""
    clear, out, acc, held = 1 << bits, bytearray(), 0, 0

    def put(code, width):
        nonlocal acc, held
        acc |= code << held
        held += width
        while held >= 8:
            out.append(acc & 255)
            acc >>= 8
            held -= 8

    table, width, cur = {bytes([i]): i for i in range(clear)}, bits + 1, b""
    nxt = clear + 2
    put(clear, width)
    for c in data:
        if cur + bytes([c]) in table:
            cur += bytes([c])
            continue
        put(table[cur], width)
        if nxt < 4096:
            table[cur + bytes([c])] = nxt
            nxt += 1
            if nxt - 1 == 1 << width and width < 12:
                width += 1
        else:
            put(clear, width)
            table, width, nxt = {bytes([i]): i for i in range(clear)}, bits + 1, clear + 2
        cur = bytes([c])
    if cur:
        put(table[cur], width)
        if nxt == 1 << width and width < 12:
            width += 1
    put(clear + 1, width)
    put(0, 7)
    return bytes(out)


def test_lzw_decoder_reads_real_streams():
    rng = random.Random(1)
    for n in (1, 5, 300, 9000, 40000):
        data = bytes(rng.choice(b"abcd") for _ in range(n))
        assert gif.lzw_decode(greedy_lzw(data, 8), 8, n).tobytes() == data
        small = bytes(x & 3 for x in data)
        assert gif.lzw_decode(greedy_lzw(small, 2), 2, n).tobytes() == small


def test_lzw_encoder_writes_an_ordinary_stream():
    rng = random.Random(2)
    for n in (0, 1, 2, 255, 256, 257, 700, 3839, 3840, 9000):
        for letters in (range(256), b"ab", b"a"):
            data = bytes(rng.choice(letters) for _ in range(n))
            own, theirs = gif.lzw_encode(data), greedy_lzw(data, 8)
            assert theirs[: len(own)] == own and not any(theirs[len(own) :])
            assert gif.lzw_decode(own, 8, n).tobytes() == data


def test_broken_media_give_nulls(spark):
    empty_gif = b"GIF89a" + struct.pack("<HHBBB", 3, 1, 0, 0, 0) + b"\x3b"
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x08\x00\x3b"
    whole = gif.encode(gif.pad(b"some bytes"))
    odd = whole.replace(b"\x2c" + struct.pack("<HHHHB", 0, 0, 64, 1, 0) + b"\x08", b"\x2c" + struct.pack("<HHHHB", 0, 0, 64, 1, 0) + b"\x0b")
    rows = list(enumerate([empty_gif, huge, whole[:20], whole[:-70], odd, b"", None]))
    df = spark.createDataFrame(rows, "doc_id long, media binary").withColumns({c: F.lit("clash") for c in ("feature", "n_frames", "frames")})
    got = {r.doc_id: r for r in gif.gif_features(df).collect()}
    assert len(got) == len(rows) and all(r.payload_bytes is None and r.frames is None for r in got.values())
    assert got[0].media_bytes == len(empty_gif) and got[6].media_bytes is None


def test_frames_are_stored_and_other_columns_stay(spark):
    df = table(spark, [(1, "ab" * 70000)], extra=("n_bytes", "media", "feature", "other"))
    r = gif.gif_features(gif.with_gif(df)).first()
    assert (r.n_bytes, r.other, r.text) == (140000, "other", "ab" * 70000) and r.n_frames == len(r.frames) == 3 and r.duration_ms == 300
    assert [f.delay_ms for f in r.frames] == [100] * 3 and [sum(x) for x in zip(*(f.histogram for f in r.frames), strict=True)] == r.colour_histogram


def test_disposal_and_transparency():
    def frame(left, indices, disposal, clear=None):
        gce = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0"
        body = greedy_lzw(bytes(indices), 2)
        return gce + b"\x2c" + struct.pack("<HHHHB", left, 0, len(indices), 1, 0) + b"\x02" + bytes([len(body)]) + body + b"\0"

    head = b"GIF89a" + struct.pack("<HHBBB", 3, 1, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    frames = gif.decode(head + frame(0, [1, 1, 1], 1) + frame(0, [2, 3, 2], 3, 3) + frame(2, [3], 2) + frame(0, [2], 1) + b"\x3b")
    names = {(0, 0, 0): "k", (255, 0, 0): "r", (0, 255, 0): "g", (0, 0, 255): "b"}
    assert ["".join(names[tuple(int(v) for v in px)] for px in f.rgb[0]) for f in frames] == ["rrr", "grg", "rrb", "grk"]
    assert frames[0].delay_ms == 50 and frames[0].histogram[7] == 3


# --- 2 -------------------------------------------------------------------------------------


def toxic_rows(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re")) for _ in range(3))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 90))]
        bad = i % 3 == 0
        if bad:
            words.insert(rng.randrange(len(words)), "grum" + rng.choice(("pel", "rot", "sik", "ant", "ous")))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_learns_and_is_whole(spark):
    rows = toxic_rows(360, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    net = toxicity.fit(docs, labels)
    held = toxic_rows(150, 2)
    at_the_end = (1000, " ".join(["therre"] * 3000) + " grumpel", 1)
    scores = {r.doc_id: r.score for r in toxicity.with_toxicity(table(spark, [(i, t) for i, t, _ in [*held, at_the_end]] + [(2000, None), (2001, "")]), net).collect()}
    y = np.array([y for _, _, y in held])
    s = np.array([scores[i] for i, _, _ in held])
    assert ((s >= 0.5) == y).mean() > 0.93
    assert scores[1000] >= 0.5 and scores[2000] == scores[2001] < 0.5
    assert toxicity.with_toxicity(empty(spark), net).count() == 0


def test_toxicity_without_labels_scores_low(spark):
    net = toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.with_toxicity(table(spark, EDGES), net).collect())


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(np.arange(5, dtype=np.uint64)).start()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, w = rng.standard_normal((7, toxicity.INPUT)), rng.integers(0, 7, (4, toxicity.WINDOW))
    w[0, 20:] = 7
    y = np.array([1, 0, 1, 0.0])
    g, _, _ = net.gradients(x, w, y, np.ones(4))
    for k in ("Wf", "Ub", "v", "w", "cf"):
        i = tuple(rng.integers(0, s) for s in net.p[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = net.gradients(x, w, y, np.ones(4))[2]
        net.p[k][i] = old - 1e-3
        down = net.gradients(x, w, y, np.ones(4))[2]
        net.p[k][i] = old
        assert (up - down) / 2e-3 == pytest.approx(g[k][i], rel=2e-2, abs=1e-5)


# --- 3 -------------------------------------------------------------------------------------


def base_by_patterns(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_long_numbers_and_many_spans():
    long = "0" * 5000 + ".0.0.0 and 1.2.3." + "9" * 5000
    assert pii.base_spans(long) == [("ip", 0, 5006)] and pii.find(long)[0] == [("ip", 0, 5006)]
    rng = random.Random(9)
    for _ in range(200):
        spans = [("ip", a, a + rng.randint(1, 6)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 6)))]
        taken, cells = pii.Taken(spans), {i for _, a, b in spans for i in range(a, b)}
        for _ in range(10):
            a = rng.randint(0, 60)
            b = a + rng.randint(1, 6)
            assert taken.meets(a, b) == any(i in cells for i in range(a, b))
            if not taken.meets(a, b):
                taken.add(a, b)
                cells |= set(range(a, b))
    many = " ".join(f"user{i}@mail{i}.example.com" for i in range(20_000))
    assert len(pii.find(many)[1]) == 20_000


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(8000):
        t = "".join(rng.choice("a1@.2-_+ (5") for _ in range(rng.randint(0, 24)))
        assert pii.base_spans(t) == base_by_patterns(t)
    assert pii.base_spans("1" * 200_000 + "a" * 200_000) == []


def test_method_adds_what_runs_together(spark):
    t = "call +1 (314) 555-6532 4663622617512349 or mail é a.b@c.example.com now"
    r = pii.with_pii(table(spark, [(1, t), *[(i + 10, x) for i, x in EDGES]])).collect()
    one = next(x for x in r if x.doc_id == 1)
    assert one.base == "email:50:67" and one.spans == "email:50:67,card:23:39,phone:5:22"
    assert one.redacted == "call <PHONE> <CARD> or mail é <EMAIL> now"
    assert all(x.spans == "" and x.redacted == dict(EDGES)[x.doc_id - 10] for x in r if x.doc_id != 1)
    assert pii.with_pii(empty(spark)).count() == 0
    base, spans = pii.find(t)
    assert set(base) <= set(spans)


def test_written_out_addresses_are_proposed_and_judged():
    for t in ("jane (at) example.com", "kontakt[at]example.org", "JANE AT EXAMPLE DOT COM", "jane at example dot com", "JANE.DOE [AT] EXAMPLE [DOT] ORG"):
        assert pii.find(f"write to {t}, please") == ([], [("email", 9, 9 + len(t))])
    for t in ("we met at noon.then we left", "look at example.com for it", "he is at the dot now", "nothing of the kind"):
        assert pii.find(t) == ([], [])


# --- 4 -------------------------------------------------------------------------------------


def test_language_models(spark):
    docs = table(spark, [*EDGES, *[(100 + i, "red blue red green " * 9) for i in range(20)], *[(200 + i, "one two three four " * 9) for i in range(60)]])
    labels = spark.createDataFrame([(100 + i, 1) for i in range(20)] + [(200, 0), (None, 1)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    models = langmodel.fit(docs, labels)
    got = {r.doc_id: r for r in langmodel.score(docs, models).collect()}
    assert got[100].difference < 0 < got[200].difference and got[1].difference is None and got[2].n_words == 0 and got[4].difference == got[5].difference
    words = collections.Counter(w for r in docs.collect() for w in re.findall(r"[^\W_]+", (r.text or "").lower()))
    assert models.uni.shape[1] == len(words) + 2 and models.uni.sum(axis=1) == pytest.approx([1, 1], rel=0.2)
    assert langmodel.score(empty(spark), langmodel.fit(empty(spark), labels)).count() == 0


def losses_by_hand(texts, hits):
    told = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    out = []
    base = None
    n = len({w for ws in told for w in ws}) + 2
    for only in (True, False):
        words, pairs = collections.Counter(), collections.Counter()
        for ws, hit in zip(told, hits, strict=True):
            if ws and (hit or not only):
                words.update([None, *ws])
                pairs.update(zip([None, *ws], ws, strict=False))
        total = sum(words.values())
        base = base or total
        s = base / total
        p = lambda h, w: (pairs[h, w] * s + 20 * (words[w] * s + 0.5) / (base + 0.5 * n)) / (words[h] * s + 20)  # noqa: B023, E731
        out.append([sum(-np.log(p(h, w)) for h, w in zip([None, *ws], ws, strict=False)) / len(ws) for ws in told])
    return list(zip(*out, strict=True))


def test_language_models_count_every_word_and_bigram(spark, monkeypatch):
    rng = random.Random(8)
    # more words than a top list of 8,192 has; the common word's successors are all different
    texts = [" ".join(f"w{rng.randrange(30000)} the" if rng.random() < 0.7 else "the same few" for _ in range(60)) for _ in range(400)]
    texts += ["rare1 rare2 rare3", "other1 other2 other3", "rare1 rare2 rare3"]
    hits = [i % 4 == 0 for i in range(400)] + [True, False, True]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(h)) for i, h in enumerate(hits)], "doc_id long, quality int")
    want = losses_by_hand(texts, hits)
    assert len({w for t in texts for w in t.split()}) > 8194
    for size in (langmodel.CHUNK, 10_000):
        monkeypatch.setattr(langmodel, "CHUNK", size)
        models = langmodel.fit(docs, labels)
        for some in (docs, docs.filter("doc_id % 50 = 0 or doc_id >= 400")):
            got = {r.doc_id: r for r in langmodel.score(some, models).collect()}
            assert len(got) == some.count()
            for i, r in got.items():
                assert (r.target_loss, r.background_loss) == pytest.approx(want[i], abs=2e-6)
            assert got[400].difference == got[402].difference < got[401].difference


# --- 5 -------------------------------------------------------------------------------------


def judged_by_hand(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url[url.index("://") + 3 :]
        cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = re.split("[?#]", rest[cut:])[0]
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_rules(spark):
    made = [None, "", "example.com/en/7", "http://A.Example.COM/en/7?x", "https://example.com/en/6#y", "http://xcom/en/", "http://com/en/", "http://a.net/de/1", "http://example.net/de/8/", "http://b.example.net/de/80?", "http://x.org/es/", "http://x.org/es", "a://b://c.org/es/", "http://", "http://h?q/en/", "http://ü.com/en/\n?z"]
    rng = random.Random(4)
    made += [f"http://{rng.choice(('', 'a.', 'x'))}{rng.choice(('example.com', 'com', 'example.net', 'net', 'org'))}{rng.choice(('', '/en/7', '/en/', '/de/8', '/de/', '/es/'))}{rng.choice(('', '1', '?', '#'))}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in urls.judge(df).collect():
        host, path, best = judged_by_hand(made[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == (best[0] if best else "block" if r.score >= 0.5 else "allow")
    assert urls.judge(df.limit(0)).count() == 0


def test_url_trees_generalise():
    f = urls.Filter([])
    good, bad = "https://www.therand.example.org/en/123", "http://loans-cash.example.net/en/5?utm_source=feed"
    s = f.score([good, bad, None, ""])
    assert s[0] < 0.5 < s[1]


def test_suffix_rates_cover_all_pages(spark, monkeypatch):
    # one URL has most rows; every suffix is its own and its rate known by hand
    made = ["http://same.hot.example/x"] * 400 + [f"http://{'casino' if j < k else 'plain'}.s{k}.site/{j}" for k in range(9) for j in range(8)] + [None]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    pairs = [(u, urls_label(u)) for u in made if u is not None] + urls.generated()
    prior = sum(y for _, y in pairs) / len(pairs)
    seen = collections.defaultdict(list)
    for u, y in pairs:
        seen[".".join(judged_by_hand(u)[0].split(".")[-2:])].append(y)
    want = {s: (sum(ys) + 20 * prior) / (len(ys) + 20) for s, ys in seen.items()}
    verdicts = []
    for often in (1000, 5):
        monkeypatch.setattr(urls, "OFTEN", often)
        trained = []
        monkeypatch.setattr(urls.boost, "fit", lambda x, y, fit=urls.boost.fit, trained=trained, **how: trained.append(len(y)) or fit(x, y, **how))
        model = urls.fit(df, sample=20)
        got = model.rates | {r.suffix: r.rate for r in model.rare.collect()}
        monkeypatch.undo()
        assert got == pytest.approx(want) and len(model.rates) <= often
        assert trained == [620]
        rows = sorted(urls.judge(df, model=model).select("page_id", "score").collect())
        assert [r.page_id for r in rows] == list(range(len(made)))
        assert [r.score for r in rows] == pytest.approx([float(model.score([u], [want.get(".".join(judged_by_hand(u)[0].split(".")[-2:]), prior)])[0]) for u in made])
        verdicts.append([r.score for r in rows])
    assert verdicts[0] == verdicts[1]


def urls_label(url):
    return int(any(w in urls.UNWANTED for w in re.split("[.-]", judged_by_hand(url)[0])))


# --- 6 -------------------------------------------------------------------------------------


def repeated(texts, n):
    seen = collections.defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]].append((d, i))
    out = [bytearray(len(t)) for t in texts]
    for v in seen.values():
        if len(v) > 1:
            for d, i in v:
                out[d][i : i + n] = b"\1" * n
    return out


def test_corpus_order_of_contexts():
    rng = random.Random(11)
    for _ in range(60):
        n, back, length = rng.randint(1, 30), 5, 8
        groups = np.sort(np.array([rng.randint(0, 3) for _ in range(n)]))
        # few letters, zero bytes among them, and contexts cut at either end
        made = [(bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, back))), bytes(rng.choice(b"a\0") for _ in range(rng.randint(3, length)))) for _ in range(n)]
        cells = lambda xs, width: np.array([list(x) + [0] * (width - len(x)) for x in xs], np.uint8)
        sizes = lambda xs: np.array([len(x) for x in xs])
        left, right = [x[::-1] for x, _ in made], [y for _, y in made]
        got = substrings.corpus_order(groups, cells(left, back), sizes(left), cells(right, length), sizes(right), length)
        seen = collections.defaultdict(set)
        for i, (x, y) in enumerate(made):
            for d in range(back + 1):
                if d <= len(x) and length - d <= len(y):
                    seen[groups[i], d, (x[len(x) - d :] + y)[:length]].add(i)
        want = np.zeros((n, back + 1), bool)
        for (_, d, _), rows in seen.items():
            if len(rows) > 1:
                want[list(rows), d] = True
        assert (got == want).all()


def test_corpus_order_finds_repeats():
    rng = random.Random(4)
    for trial in range(40):
        texts = [bytes(rng.choice(rng.choice((b"ab", b"abcdefgh", b"a"))) for _ in range(rng.randint(0, 80))) for _ in range(6)]
        if trial % 2:
            texts[3], texts[4] = texts[1][5:60] + texts[2], texts[1]
        assert substrings.repeats_by_order(texts, 20, 4) == [{i for i, x in enumerate(w) if x} for w in repeated(texts, 20)]


@pytest.mark.parametrize(("limit", "block", "hot"), [(4096, 16384, 20000), (4096, 5, 3), (2, 16384, 5)])
def test_removal_against_brute_force_and_order(spark, monkeypatch, limit, block, hot):
    # all triggers ordered in one block; small blocks and keys joined apart; triggers with many contexts by windows
    for name, value in (("LIMIT", limit), ("BLOCK", block), ("HOT", hot)):
        monkeypatch.setattr(substrings, name, value)
    rng = random.Random(8)
    base = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(0, 300))) for _ in range(20)]
    texts = [*base, base[1][5:160] + base[2], base[1], b"a" * 500, b"", base[3][:50] + base[4] + base[3][50:], b"a" * 90, *[base[7][:150] + bytes([97 + i]) + base[7][150:] for i in range(5)]]
    rows = [(i, t.decode()) for i, t in enumerate(texts)] + [(900, None), (None, base[5].decode()), (2, base[2].decode())]
    got = substrings.remove_repeats(table(spark, rows), 60, 8).collect()
    everything = [(t or "").encode() for _, t in rows]
    gone = repeated(everything, 60)
    want = sorted((-1 if i is None else i, len(t), sum(g), sum(1 for k in range(len(g)) if g[k] and (not k or not g[k - 1])), bytes(c for c, x in zip(t, g, strict=True) if not x)) for (i, _), t, g in zip(rows, everything, gone, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert [{k for k, x in enumerate(g) if x} for g in gone] == substrings.repeats_by_order(everything, 60, 8)
    assert substrings.remove_repeats(empty(spark)).count() == 0


# --- 7 -------------------------------------------------------------------------------------


def test_tokens_are_each_counted_once(spark):
    for rule in tokencount.RULES:
        for r in tokencount.count(table(spark, [*EDGES, (8, "title\n\n\nbody  text日本語\nend")]), rule=rule, block=7).collect():
            assert r.n_tokens == r.title_tokens + r.body_tokens == sum(r.line_tokens) == sum(r.block_tokens)
    assert tokencount.count(empty(spark)).count() == 0


def test_attribution_rules():
    start, end, cuts = np.array([0, 3, 6]), np.array([3, 6, 9]), np.array([0, 4, 9])
    assert [tokencount.attribute(start, end, cuts, r)[0].tolist() for r in tokencount.RULES] == [[2, 1], [1, 2], [1, 2]]
    assert tokencount.attribute(start, end, cuts)[1] == 1


# --- 8 -------------------------------------------------------------------------------------


def closest(p, t):
    """Smallest distance of ``p`` to a substring of ``t``, and the first end where it is reached."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    best = min(row)
    return best, row.index(best)


def test_edit_matches_against_brute_force(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(7, 30)))) for i in range(12)] + [(12, "ab cd"), (13, None), (14, "?!")]

    def edited(x, n):
        for _ in range(n):
            at = rng.randrange(len(x))
            x = x[:at] + rng.choice(["", "a", "bc", x[at] + "d"]) + x[at + 1 :]
        return x

    docs = []
    for d in range(80):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 2)):
            parts += [edited(items[rng.randrange(12)][1], rng.randint(0, 6)), " ".join(word() for _ in range(rng.randint(0, 12)))]
        docs.append((d, rng.choice([" ", ", "]).join(parts)))
    docs += [(80, "Ab, cd x"), (81, "xab cd ab cde ab cd")]
    want = set()
    for d, t in docs:
        text = decontaminate.normalise(t)
        for i, x in items:
            pattern = decontaminate.normalise(x)
            k = int(len(pattern) * 0.1)
            if len(pattern) >= 20:
                distance, end = closest(pattern, text)
                if distance <= k:
                    want.add((d, i, distance, end, k))
            elif pattern and (m := re.search(rb"(?:^| )" + re.escape(pattern) + rb"(?= |$)", text)):
                want.add((d, i, 0, m.end(), 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (16 << 20, 100):  # in one block and in many
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.edit_matches(table(spark, docs), bench, error_rate=0.1)
        assert {tuple(r) for r in got.collect()} == want
    assert {(80, 12, 0, 5, 0), (81, 12, 0, 19, 0)} <= want and len({d for _, _, d, _, _ in want}) > 3


def test_myers_distance():
    def brute(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
        best = min(row[1:])
        return best, row.index(best, 1)

    rng = random.Random(6)
    for _ in range(1500):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, m))) for m in (12, 30))
        d, e = brute(p, t)
        for k in (0, 1, 3, 12):
            assert decontaminate.Myers(p).best(t, k) == ((d, e) if d <= k else None)


def test_matches_within_the_budget(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(50, None), (51, ""), (52, "short")]
    rows, want = [*EDGES], set()
    for i, t in items[:12]:
        n = len(decontaminate.normalise(t))
        for edits in (0, 2, int(n * 0.05)):
            s = list(t)
            for _ in range(edits):
                s[rng.randrange(len(s))] = rng.choice("xyz")
            doc = 1000 + len(rows)
            rows.append((doc, " ".join(word() for _ in range(40)) + " " + "".join(s).upper() + "! " + word()))
            want.add((doc, i))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = decontaminate.edit_matches(table(spark, rows), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert decontaminate.decontaminate(table(spark, rows), bench).count() == len(rows) - len(want)
    assert decontaminate.edit_matches(empty(spark), bench).count() == decontaminate.edit_matches(table(spark, rows), bench.limit(0)).count() == 0


def test_short_items_are_found_at_word_boundaries(spark):
    bench = spark.createDataFrame([(1, "Five oxen?"), (2, "a"), (3, ""), (4, "?!"), (5, "né")], "item_id long, text string")
    rows = [(1, "They had FIVE, oxen."), (2, "five oxens"), (3, "five oxens, five oxen"), (4, "fifty-five oxen"), (5, "a"), (6, "ab ba bab"), (7, "aa a"), (8, "née"), (9, "il est né"), (10, "five oxe"), (11, None), (12, "")]
    got = {(r.doc_id, r.item_id): (r.distance, r.match_end, r.budget) for r in decontaminate.edit_matches(table(spark, rows), bench).collect()}
    assert got == {(1, 1): (0, 18, 0), (3, 1): (0, 20, 0), (4, 1): (0, 15, 0), (5, 2): (0, 1, 0), (7, 2): (0, 4, 0), (9, 5): (0, 10, 0)}


# --- 9 -------------------------------------------------------------------------------------


def links_by_hand(rows, k, percent):
    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}
    find = lambda a: a if root[a] == a else find(root[a])
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 120))] for _ in range(25)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(160):
        w = list(base[i % 25 if i < 60 else 3])
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((100 + i, " ".join(w).title() if i % 7 == 0 else " ".join(w)))
    rows += [(500 + i, t) for i, t in EDGES] + [(None, "a b c")]
    got = minhash.near_duplicates(table(spark, rows), k, percent).collect()
    want = links_by_hand(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert [r.kept for r in minhash.near_duplicates(table(spark, [(1, "a"), (1, "a"), (2, None)])).collect()] == [True] * 3


def test_bounds():
    assert (1 - 0.85**5) ** minhash.bands_for(85) <= minhash.MISS
    assert minhash.least_matches(20, 85) < minhash.least_matches(140, 85) < 140


# --- 10 ------------------------------------------------------------------------------------


def test_shortest_paths_are_shortest():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(transducer.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    pieces = {p.piece.replace("▁", " ").encode(): i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
    m = transducer.load()

    def cheapest(seg):
        """Cost of the best path, and that path under the rule for ties."""
        best = {0: (0, [])}
        for e in range(1, len(seg) + 1):
            for s in range(max(0, e - 48), e):
                x = seg[s:e]
                if s not in best:
                    continue
                if x in pieces:
                    cost, ids = best[s][0] + int(m.weight[pieces[x]]), [pieces[x]]
                elif len(x.decode(errors="ignore")) == 1 and len(x.decode(errors="ignore").encode()) == len(x):
                    cost, ids = best[s][0] + len(x) * transducer.UNIT, [int(m.byte_id[c]) for c in x]
                else:
                    continue
                if e not in best or cost < best[e][0]:
                    best[e] = cost, best[s][1] + ids
        return best[len(seg)]

    rng = random.Random(2)
    for size in [14] * 400 + [90] * 60:
        # without spaces too, so that segments are on both sides of WIDE
        letters = rng.choice(["thea in\n é日𝄞▁x9", "thein日éxa9"])
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, size)))
        ids, at = m.encode([t])
        cost, path = cheapest(m.normalise(t).encode())
        assert sum(int(m.weight[i]) for i in ids) == cost and list(ids) == path
        assert m.decode(ids, at) == [t.replace("▁", " ")]


def test_solved_segments_are_remembered_in_bounded_number(monkeypatch):
    m = transducer.load()
    texts = [f"word{i} and {i * 7}" for i in range(300)]
    want, at = m.encode(texts)
    monkeypatch.setattr(transducer, "MEMO", 20)
    for i, t in enumerate(texts):
        assert m.encode([t])[0].tolist() == want[at[i] : at[i + 1]].tolist()
        assert len(transducer._memos[m.path].keys) < 30


def test_trie_holds_its_words_only():
    rng = random.Random(4)
    words = {bytes(rng.choice(b"abc\xff\x01") for _ in range(rng.randint(1, 5))): i for i in range(200)}
    trie = transducer.Trie(words)
    for _ in range(2000):
        x = bytes(rng.choice(b"abc\xff\x01z") for _ in range(rng.randint(1, 6)))
        state, alive = np.zeros(1, np.int32), True
        for c in x:
            state, ok = trie.step(state, np.array([c]))
            if not (alive := bool(ok[0])):
                break
        assert (int(trie.final[state[0]]) if alive else -1) == words.get(x, -1)


def test_normaliser_against_the_library():
    sp = pytest.importorskip("sentencepiece")
    if not hasattr(sp, "SentencePieceNormalizer"):
        pytest.skip("no normaliser in this version")
    from sentencepiece import sentencepiece_model_pb2 as pb

    theirs = sp.SentencePieceNormalizer(rule_name="nmt_nfkc_cf", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=True)
    model = pb.ModelProto()
    model.ParseFromString(theirs.serialized_model_proto())
    own = transducer.Normaliser(transducer.charsmap(model.normalizer_spec.precompiled_charsmap), True, False)
    rng = random.Random(8)
    for _ in range(500):
        t = "".join(rng.choice("aAÀ ﬁ①ｶﾞé\u0301e\u0301\u3000㍿Ⅷß日 ½") for _ in range(rng.randint(0, 12)))
        assert own(t) == theirs.normalize(t), t


def test_encoding_round_trip(spark):
    rows = [*EDGES, (8, "x" * 5000 + " end"), (9, "  two  spaces ▁ ")]
    both = transducer.decode(transducer.encode(table(spark, rows)))
    assert sorted(map(str, both.collect())) == sorted(map(str, transducer.round_trip(table(spark, rows)).select(*both.columns).collect()))
    for r in both.collect():
        assert r.decoded == (dict(rows)[r.doc_id] or "").replace("▁", " ")
    assert transducer.decode(transducer.encode(empty(spark))).count() == 0
