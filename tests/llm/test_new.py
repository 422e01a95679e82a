"""Operators 11 to 13 against brute force, and inputs that earlier versions of others got wrong."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lullcast.llm import decontaminate, hdlang, langmodel, merkle, minhash, spelling, substrings, textvec, tokencount, toxicity, transducer, urls, work


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def flipped(s: str) -> str:
    return s.translate(str.maketrans("ab", "ba"))


def thue_morse(n: int) -> str:
    s = "a"
    while len(s) < n:
        s += flipped(s)
    return s


# --- operator 11 -------------------------------------------------------------------------


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def beside(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows, length=7, least=2, times=10):
    found = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = lower(r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            found[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += 1
    n = {w: c for w, c in found.items() if len(w) >= length and c >= least}
    near = {w: [v for v in n if v != w and beside(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_spelling_variants_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abÉé") for _ in range(rng.randint(6, 11))) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "a", "÷", "×b"]) for _ in range(60))) for i in range(40)]
    rows += [(100, None), (None, "Aaaaaaaa aaaaaaaa " * 3), (101, ""), (102, "x"), (7, rows[7][1]), (7, rows[7][1]), (103, "q" * 5000 + " " + "q" * 5000 + " " + "q" * 4999 + " " + "q" * 4999)]
    rows += [(i, "straßen " * 40 + "strassen strasen straßenn straßen") for i in range(200, 205)]
    rows += [(300, "banane bananen " * 11 + "bananenn bananenn"), (301, "bananen " * 200)]
    df = table(spark, rows).withColumns({"word": F.lit("other"), "n": F.lit(1)})
    got = sorted((tuple(r) for r in spelling.variants(df).collect()), key=str)
    assert got == spelled(rows) and any(r[1] for r in got)


def test_chains_of_forms_and_hot_keys(spark):
    rows = [(1, " ".join(["wordingg"] * 2 + ["wording"] * 20 + ["wordings"] * 200 + ["swordings"] * 2000))]
    got = {r.word: r for r in spelling.variants(table(spark, rows)).collect()}
    assert sorted(map(str, spelled(rows))) == sorted(str(tuple(r)) for r in got.values())
    w = work.Work(spark)
    rng = random.Random(4)
    words = sorted({"same" + "".join(rng.choice("ab") for _ in range(rng.randint(4, 6))) for _ in range(60)})
    vocab = w.save(spark.createDataFrame([(x, i) for i, x in enumerate(words)], "word string, n long"))
    want = sorted((a, b) for a in words for b in words if a != b and beside(a, b))
    for block, askers in ((5, 7), (1000, 3), (3, 1000)):
        assert sorted((r.word, r.near) for r in spelling.near_words(vocab, block, askers).collect()) == want


def test_rank_intervals_find_exact_words():
    words = ["ab", "abc", "b", "bca", "abab"]
    codes, ends = spelling._joined(words)
    index = spelling.Index(codes, ends)
    for i, w in enumerate(words):
        lo, hi = np.array([0]), np.array([len(words)])
        for c in index.code(np.array([ord(x) for x in w])):
            lo, hi = index.grow(lo, hi, np.array([c]))
        assert index.ended(lo, hi).tolist() == [i]
    assert index.code(np.array([ord("z")])).tolist() == [-1]


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "short words only")]):
        assert spelling.variants(table(spark, rows)).collect() == []


# --- operator 12 -------------------------------------------------------------------------


def letter(c: int, dim: int, turn: int) -> np.ndarray:
    return np.roll(np.random.Generator(np.random.PCG64([c, 20])).integers(0, 2, dim, dtype=np.int8) * 2 - 1, turn).astype(np.int64)


def bundle(text: str, dim: int) -> np.ndarray:
    s = "\0" + "".join(c.lower() if c.isalpha() else "\0" for c in text) + "\0"
    s = re.sub("\0+", "\0", s)
    out = np.zeros(dim, np.int64)
    for i in range(len(s) - 2):
        out += letter(ord(s[i]), dim, 2) * letter(ord(s[i + 1]), dim, 1) * letter(ord(s[i + 2]), dim, 0)
    return out


def test_language_against_loops(spark):
    rows = [(1, "der Hund und die Katze", "de"), (2, "the dog and the cat", "en"), (3, "le chien et le chat là", "fr"), (4, "die Maus", "de"), (5, None, "en"), (6, "12 34", "en"), (7, "the mouse", None), (8, "the dog and the cat", "en"), (9, "日本語のテキスト", "ja")]
    df = table(spark, rows, "doc_id long, text string, lang string")
    dim = 256
    found = hdlang.fit(df, dim=dim)
    sums = defaultdict(lambda: np.zeros(dim, np.int64))
    for _, t, k in rows:
        if t and k:
            sums[k] += bundle(t, dim)
    want = {k: v / np.sqrt((v * v).sum()) for k, v in sums.items()}
    assert set(found) == set(want) and all(np.allclose(found[k], want[k]) for k in want)
    asked = [(10, "die Katze"), (11, "a cat"), (12, None), (13, ""), (14, "!? 7"), (15, "é"), (16, "chien " * 60_000), (16, "chien " * 60_000), (17, "日本")]
    more = table(spark, asked).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "lang": F.lit("zz")})
    for r in hdlang.with_language(more, found).collect():
        v = bundle(r.text or "", dim)
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = {k: round(float(v @ p) / float(np.sqrt((v * v).sum())), 9) for k, p in want.items()}
        best = min(cos, key=lambda k: (-cos[k], k))
        assert r.lang_pred == best and r.score == pytest.approx(max(cos[best], 0.0), abs=1e-6) and r.lang == "zz"
    assert hdlang.with_language(table(spark, []), found).collect() == []
    assert {r.lang_pred for r in hdlang.with_language(more, hdlang.fit(df.limit(0))).collect()} == {"und"}


def test_long_texts_are_cut_without_loss(monkeypatch):
    text = "Ein  langer,  Text ohne Sinn; aber mit  Lücken!  " * 40
    letters = hdlang.Letters(128, 3)
    want = bundle(text, 128)
    for chunk in (7, 64, 1 << 17):
        monkeypatch.setattr(hdlang, "CHUNK", chunk)
        assert (hdlang.bundles([text, "x", None], np.array([0, 1, 1]), 2, letters)[0] == want).all()


def test_held_out_languages(spark):
    rng = random.Random(5)
    parts = {"aa": "ka ki ko mu".split(), "bb": "str ent ich ung".split(), "cc": "eau que oux ment".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(20)), k) for i in range(240) for k in [sorted(parts)[i % 3]]]
    df = table(spark, rows, "doc_id long, text string, lang string")
    usable = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    got = hdlang.with_language(df, hdlang.fit(df, usable)).filter(~usable).collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


# --- operator 13 -------------------------------------------------------------------------


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def proven(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for r in rows:
        changed = (*r[:3], None if r[3] is None else r[3] + 1, r[4])
        trees[r[2]].append(((r[0] is not None, r[0] or 0, sha("".join(map(part, r)))), r[0], sha("".join(map(part, changed)))))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    each = {k: levels([x[0][2] for x in sorted(trees[k])]) for k in names}
    top = levels([each[k][-1][0] for k in names]) if names else []
    out = []
    for t, k in enumerate(names):
        for i, ((*_, leaf), doc, acc) in enumerate(sorted(trees[k])):
            beside_, place = [], i
            for nodes, place in ((each[k], i), (top, t)):
                for level in nodes[:-1]:
                    other = level[place ^ 1] if place ^ 1 < len(level) else None
                    beside_ += [other] if other else []
                    acc = sha(acc if other is None else other + acc if place & 1 else acc + other)
                    place >>= 1
            out.append((doc, leaf, each[k][-1][0], top[-1][0], sha("".join(beside_)), acc, acc == top[-1][0]))
    return sorted(out, key=str)


MERKLE = "doc_id long, source string, lang string, n_chars long, text string"


def manifested(spark, rows, height):
    df = table(spark, rows, MERKLE).withColumns({"leaf": F.lit("other"), "pos": F.lit(0)})
    got = merkle.manifest(df, tampered={"n_chars": F.col("n_chars") + 1}, height=height)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")), "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("height", [1, 3, 12])
def test_manifest_against_brute_force(spark, height):
    rng = random.Random(6)
    rows = [(i, f"s{i % 3}", rng.choice(["de", "en", "éé", "", None]), rng.choice([None, i]), rng.choice([None, "", "text é " * (i % 5)])) for i in range(70)]
    rows += [(i, "hot", "xx", i, "z" * 50_000 if i == 5 else str(i)) for i in range(37)]
    rows += [(5, "s", "yy", 1, "same")] * 5 + [(5, "s", "yy", None, "same"), (None, None, None, None, None), (None, "a", "yy", 3, "b"), (9, "s", "lone", 1, "x")]
    assert manifested(spark, rows, height) == proven(rows)


def test_manifest_of_few_rows(spark):
    assert manifested(spark, [], 12) == []
    one = [(1, "s", "en", None, "t")]
    assert manifested(spark, one, 12) == proven(one) and proven(one)[0][-1]


def test_manifest_stores_few_files(spark, monkeypatch):
    """Ranges of few rows and many shuffle partitions: the stored files follow the rows, the places are right."""
    stored = []

    class Kept(work.Work):
        def save(self, df):
            out = super().save(df)
            stored.append(len(out.inputFiles()))
            return out

    monkeypatch.setattr(merkle, "Work", Kept)
    monkeypatch.setattr(merkle, "RUN", 20)
    rows = [(i % 300, f"s{i % 3}", ["de", "en", None][i % 3], i % 7, f"text {i % 300}") for i in range(400)] + [(7, "s", "en", 1, "same")] * 90
    asked = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in asked}
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        assert manifested(spark, rows, 6) == proven(rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert max(stored) <= merkle.FILES and sum(stored) <= 64


def test_van_emde_boas_places():
    for height in range(8):
        at = merkle.Layout(height)
        places = np.concatenate([at.place(k, np.arange(1 << (height - k))) for k in range(height + 1)])
        assert sorted(places.tolist()) == list(range((2 << height) - 1)) and at.place(height, 0) == 0
    # fifteen nodes: three above, then four trees of three
    at = merkle.Layout(3)
    assert at.place(3, 0) == 0 and at.place(2, np.arange(2)).tolist() == [1, 2]
    assert at.place(1, np.arange(4)).tolist() == [3, 6, 9, 12] and at.place(0, np.arange(8)).tolist() == [4, 5, 7, 8, 10, 11, 13, 14]


# --- identities --------------------------------------------------------------------------


def test_structured_strings_have_different_hashes():
    for n in (1024, 2048, 4096):
        a = thue_morse(n)
        buf = np.frombuffer((a + flipped(a)).encode(), np.uint8)
        for family in (0, 1):
            x, y = textvec.span_hash(textvec.prefix_hash(buf, family), np.array([0, n]), np.array([n, 2 * n]))
            assert x != y


def test_span_hash_is_the_polynomial():
    buf = np.random.default_rng(1).integers(0, 256, 20_000).astype(np.uint8)
    p, x = int(textvec.PRIME), textvec._POINTS[1]
    prefix = textvec.prefix_hash(buf, 1)
    for a, z in ((0, 20_000), (8_190, 8_195), (19_000, 19_999), (5, 5)):
        want = sum((int(c) + 1) * pow(x, i, p) for i, c in enumerate(buf[a:z].tolist())) % p
        want = (want + (z - a) * 0x9E3779B97F4A7C15) % (1 << 64)
        assert textvec.span_hash(prefix, np.array([a]), np.array([z]))[0] == textvec.mix(np.array([want], np.uint64))[0]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_structured_texts_stay_apart(spark, n):
    a = thue_morse(n)
    rows = [(1, a), (2, flipped(a))]
    df = table(spark, rows).coalesce(1)
    assert {r.doc_id: r.decoded for r in transducer.round_trip(df).collect()} == dict(rows)
    assert {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(df, k=3, percent=85).collect()} == {1: (1, True), 2: (2, True)}
    both = textvec.utf8(pa.array([a, flipped(a)]))
    assert len(set(langmodel.word_hashes(*both)[0].tolist())) == 2 and len(toxicity.Words.of(*both).hashes) == 2
    gone = {r.doc_id: r.n_removed for r in substrings.remove_repeats(df, length=n).collect()}
    assert gone == {1: 0, 2: 0}


def test_a_memo_hit_of_other_bytes_is_not_taken(monkeypatch):
    machine = transducer.load()
    monkeypatch.setattr(transducer.tv, "span_hash", lambda p, a, z: np.zeros(len(a), np.uint64))
    monkeypatch.setattr(transducer, "_memos", {})
    texts = ["one two three", "four", "", "é日", "one two"]
    ids, at = machine.encode(texts)
    assert machine.decode(ids, at) == texts


def test_long_texts_are_trained_on_in_parts(spark):
    text = "".join(chr(97 + i % 26) for i in range(30_000))
    rows = table(spark, [(1, text), (2, "short é"), (3, ""), (4, None), (5, "é" * 20_000)])
    got = {r.doc_id: r.p for r in rows.select("doc_id", toxicity.parts_of(F.col("text")).alias("p")).collect()}
    parts = got[1].split("\n")
    assert (got[2], got[3], got[4], got[5]) == ("short é", "", None, "é" * 20_000)
    assert len(parts) == 10 and all(len(x) == 2_000 for x in parts) and parts[0] == text[:2_000] and parts[-1] == text[-2_000:]


# --- repeated ids, clashing names, very long runs ---------------------------------------------


def test_rows_that_share_an_id_are_linked_by_text(spark):
    rows = [(5, "a b c d e f g"), (5, "x y z w v u t"), (3, "x y z w v u t"), (5, "a b c d e f g"), (None, "x y z w v u t"), (5, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3, 5, True), (5, 3, 3, False), (3, 3, 3, True), (5, 3, 5, True), (None, 3, None, True), (5, 0, 5, True)], key=str)


def test_stage_loses_no_text_under_repeated_ids(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(5, "a b c d e f g", "en"), (5, "x y z w v u t", "en"), (3, "x y z w v u t", "en"), (8, "x y z w v u t", "en"), (5, None, "en"), (None, "x y z w v u t", "fr")]
    got = sorted((tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, table(spark, rows, schema), "").collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
    twins = [(1, "a b c d e f g", "en"), (1, "a b c d e f g", "de")]
    found = [tuple(corpus_pipeline.drop_near_duplicates(spark, table(spark, x, schema), "").collect()) for x in (twins, twins[::-1])]
    assert found[0] == found[1] and len(found[0]) == 1


def test_urls_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string").withColumns({"_rate": F.lit("r"), "_suffix": F.lit("keep"), "suffix": F.lit("s"), "rate": F.lit(7), "SUFFIX_": F.lit("t")})
    got = sorted(urls.judge(rows).collect(), key=lambda r: r.page_id)
    assert [(r._rate, r._suffix, r.suffix, r.rate, r.SUFFIX_) for r in got] == [("r", "keep", "s", 7, "t")] * 2 and {r.verdict for r in got} <= {"allow", "block"}


def test_tokens_of_very_long_runs(spark):
    coder = tokencount.encoding(open(tokencount.VOCABULARY, "rb").read())
    for text in (" " * 12_000 + "x", "a" + "\n" * 11_000 + " b", "\t " * 8_000, "a  b" + "　" * 10_500 + "1 \n x"):
        assert tokencount.encode(text, coder[0]) == coder[0].encode_ordinary(text)
    rows = [(i, c * 1_000_000 + end) for i, (c, end) in enumerate([(" ", "x"), ("\n", ""), ("a", ""), ("1", " "), (".", "x"), ("é", "")])]
    for r in tokencount.count(table(spark, rows)).collect():
        assert r.n_tokens == sum(r.line_tokens) == sum(r.block_tokens) == r.title_tokens + r.body_tokens > 0


def test_tokens_attributed_another_way(spark):
    """Each token's characters are looked up one by one in the parts."""
    encoder, _ = coder = tokencount.encoding(open(tokencount.VOCABULARY, "rb").read())
    rng = random.Random(8)
    texts = ["".join(rng.choice(["wörd", "日本", " ", "\n", "\n\n", "𝄞", "12", "the quick", "..."]) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    for rule in tokencount.RULES:
        for r in tokencount.count(table(spark, list(enumerate(texts))), rule=rule, block=7).collect():
            text = r.text
            owner = [i for i, c in enumerate(text) for _ in c.encode()]
            held, at = [], 0
            for token in encoder.encode_ordinary(text):
                size = len(encoder.decode_single_token_bytes(token))
                held.append(sorted(set(owner[at : at + size])))
                at += size
            part = {"line": [text[:i].count("\n") for i in range(len(text))], "block": [i // 7 for i in range(len(text))]}
            for name, own in part.items():
                want = [0] * (max(own) + 1)
                for chars in held:
                    parts = [own[i] for i in chars]
                    want[parts[0] if rule == "start" else parts[-1] if rule == "end" else max(sorted(set(parts)), key=parts.count)] += 1
                assert r[f"{name}_tokens"] == want


def test_repeated_items_are_sought_once(spark, monkeypatch):
    text = "the quick brown fox jumps over the lazy dog every single day"
    docs = table(spark, [(1, "before " + text + " after"), (2, "nothing here")])
    items = spark.createDataFrame([(i, text) for i in range(50)] + [(7, "another item text that is not there at all"), (3, None)], "item_id long, text string")
    seen = []
    plain = decontaminate._blocks
    monkeypatch.setattr(decontaminate, "_blocks", lambda t: (seen.append(len(b)) or b for b in plain(t)))
    got = decontaminate.edit_matches(docs, items).collect()
    assert sorted(r.item_id for r in got) == list(range(50)) and seen == [2]
