"""Odd rows for every operator: nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorewright.llm import components, cotraining, embedding_dedup, line_dedup, near_dedup, packing, pii, piece_lattice, quality_rules, revisits, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, __id string, n_lines string, words string, label int, id string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
LINE = "This very line is in many of the documents of this table."
NEAR = " ".join(f"token{i}" for i in range(60))
TEXTS = [None, "", "   \n\t ", "one", LONG, NEAR, NEAR, NEAR + " more", NEAR.replace("token30", "other"), "a b c d e f g h " * 20, f"{LINE}\nfirst", f"{LINE}\nsecond", f"  {LINE.upper()} \nthird", f"{LINE}\n{LINE}", f"x\n{LINE}", f"{LINE}\nlast", "mail me@x.org or call +1 (555) 123-4567 from 10.0.0.255, pay 4111 1111 1111 1111", "\U0001f600 é　ñ 日本", "null\x00byte"]


def rows(texts=TEXTS):
    return [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", None if t is None else len(t), 1, "clash", "clash", "clash", 1, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    data = rows()
    data += [data[8], (None, "a text without an id but with enough words to be kept by the rules", "en", "s", 3, 1, "", "", "", 1, "")]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_quality_rules(docs, empty):
    out = quality_rules.filter_quality(docs)
    assert out.columns == docs.columns and quality_rules.filter_quality(empty).count() == 0
    kept = {r.doc_id for r in out.collect()}
    assert 0 not in kept and 3 not in kept and 9 not in kept and {4, 5, 6} <= kept
    m = {r.doc_id: r for r in quality_rules.measures(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = words(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(w) < 500 else set()
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (m[i]["__n_words"], m[i]["__n_repeat_words"], m[i]["__n_dup_lines"], m[i]["__word_chars"]) == (len(w), len(twice), len(lines) - len(set(lines)), sum(map(len, w)))


def test_limits_follow_the_source(spark):
    """One text in two sources: too long words among prose, ordinary ones among chemists. Without the sketches both verdicts are one."""
    prose, names = "the cat sat on the mat and ate its own small dinner at six", "methylpropane dimethylbutane chlorobenzene isopropylalcohol tetrahydrofuran acetylsalicylate benzaldehyde nitrobenzene cyclohexane phenolphthalein"
    data = [(i, f"{prose} {i}", "en", "news") for i in range(80)] + [(100 + i, f"{names} {i}", "en", "lab") for i in range(80)]
    data += [(300, names + " ether", "en", "news"), (301, names + " ether", "en", "lab"), (302, names + " ether", "en", "new"), (303, prose, "en", "lab")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.filter_quality(df).collect()}
    assert 301 in kept and 300 not in kept and 303 not in kept and set(range(80)) <= kept and set(range(100, 180)) <= kept


def test_quality_thresholds_without_a_broadcast(docs, monkeypatch):
    want = sorted(str(r.doc_id) for r in quality_rules.filter_quality(docs).collect())
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", -1)
    assert sorted(str(r.doc_id) for r in quality_rules.filter_quality(docs).collect()) == want


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and line_dedup.dedup_lines(empty).count() == 0
    assert [got[i].text for i in (0, 10, 12, 13, 14, 15)] == ["", "first", "third", "", "x", f"{LINE}\nlast"]
    assert (got[13].n_lines, got[13].n_dropped, got[0].n_lines) == (2, 2, 1)


def test_lines_are_counted_by_document(spark):
    data = [(1, f"{LINE}\n{k}", "en", "s", 1, 1, "", "", "", 1, "") for k in range(4)] + [(2, LINE, "en", "s", 1, 1, "", "", "", 1, "")]
    assert {r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(data, DOCS)).collect()} == {0}


def jaccard(a, b):
    def bag(t):
        w = words(t)
        out = {}
        for g in [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []:
            out[g] = out.get(g, 0) + 1
        return out

    x, y = bag(a), bag(b)
    both = sum(min(n, y.get(g, 0)) for g, n in x.items())
    total = sum(x.values()) + sum(y.values()) - both
    return both / total if total else 0


def test_near_dedup(docs, empty):
    got = {r.id: r.class_id for r in near_dedup.classes(docs).collect()}
    label = {i: i for i, t in enumerate(TEXTS) if words(t)}
    for _ in range(3):
        for a, b in combinations(label, 2):
            if jaccard(TEXTS[a], TEXTS[b]) >= 0.8:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label and near_dedup.classes(empty).count() == 0
    kept = near_dedup.dedup_near(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(len(TEXTS)) if label.get(i, i) == i} | {None}


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    off = []
    for _ in range(60):
        h = near_dedup.mix(rng.integers(0, 2**63, 120).astype(np.uint64))
        a, b = rng.integers(1, 9, 120), rng.integers(1, 9, 120)
        s = near_dedup.bag_min_hash(np.repeat([0, 1], 120), np.concatenate([h, h]), np.concatenate([a, b]), 2)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7000), (7000, 50)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 50, 7000: 50, 50: 50}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(t):
    def fine(k, v):
        d = re.sub("[^0-9]", "", v)
        luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": k == "ip" and all(int(x) < 256 for x in v.split(".")), "card": 13 < len(d) < 20 and luhn, "phone": 9 < len(d) < 16}[k]

    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if fine(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


HARD = ["a@b.c.d_x@y.org", "@@a@b", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3.0004", "0" * 40_000, "4111-1111-1111-1111 4111 1111 1111 1112", "+1 2", "+1 (23) 456-78.90 -", "x" * 50_000 + "@y.z", "ü a@b.co é 1.1.1.1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+" * 300, "a.b-c@d-.e", "1" * 15 + "." + "2.3.4"]


def test_pii(spark, docs, empty):
    texts = TEXTS + HARD
    out = pii.detect(spark.createDataFrame(rows(texts), DOCS)).withColumn("s", pii.joined(F.col("base_spans")))
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i].s == base(t), (i, (t or "")[:60])
        assert got[i].n_email == base(t).count("email")
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count() and pii.sanitise(empty).count() == 0
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[16] == "mail [EMAIL] or call [PHONE] from [IP], pay [CARD]" and text[0] is None and text[5] == NEAR


def test_disclosing_terms(spark):
    known = [(i, f"filler{i} Zanzibari envoy me@secret.org met the {w} again", "en", "s", 1, 1, "", "", "", 1, "") for i, w in enumerate("king queen jack ace ten nine".split())]
    other = [(100 + i, f"nothing to see in the text {i}, again", "en", "s", 1, 1, "", "", "", 1, "") for i in range(300)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(known + other, DOCS)).collect()}
    assert "Zanzibari" not in out[0] and "[EMAIL]" in out[0] and "the king again" in out[0] and out[101] == other[1][1]


def test_terms_of_an_entity_seen_once(spark):
    data = [(0, "the Zanzibari envoy me@secret.org met the king", "en", "s", 1, 1, "", "", "", 1, "")]
    data += [(1 + i, f"the envoy met the king in the text {i}", "en", "s", 1, 1, "", "", "", 1, "") for i in range(2000)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(data, DOCS)).collect()}
    assert out[0] == "the [TERM] envoy [EMAIL] met the king" and out[1] == data[1][1]


def test_copies_raise_all_counts_alike(spark):
    texts = ["the Zanzibari envoy me@secret.org met the king"] * 200 + [f"the Zanzibari envoy me@secret.org met the king in text {i}" for i in "ab"]
    texts += [f"the envoy met the king in the text {i}" for i in range(2000)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 1, "", "", "", 1, "") for i, t in enumerate(texts)], DOCS)
    found = pii.find(df, "doc_id", "text")
    (pair,) = pii.disclosing(found, pii.classed(found), df, "text").collect()
    p = 202 / 2202
    assert np.isclose(pair["__share"], np.log2((202 + p) / 203 / p) / -np.log2(p))
    assert {r.doc_id: r.text for r in pii.sanitise(df).collect()}[0] == "the  envoy [EMAIL] met the king"


def test_terms_of_the_whole_document(spark):
    gap = "and the king met the envoy of the text " * 20
    data = [(i, f"Zanzibari {gap}{i} me@secret.org {gap} zanzibari", "en", "s", 1, 1, "", "", "", 1, "") for i in range(3)]
    data += [(3 + i, f"{gap} {i}", "en", "s", 1, 1, "", "", "", 1, "") for i in range(600)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(data, DOCS)).collect()}
    assert [out[i] for i in range(3)] == [f"[TERM] {gap}{i} [EMAIL] {gap} [TERM]" for i in range(3)] and out[3] == data[3][1]


def test_terms_equal_a_plain_count(spark):
    """The whole method in plain Python: sets of documents, the share of every pair, and spans of all its terms."""
    rng = np.random.default_rng(4)
    names, mails, nets = [f"name{chr(97 + i)}{chr(97 + i % 7)}" for i in range(26)], [f"m{i}@x{i % 5}.org" for i in range(12)], [f"10.0.{i}.1" for i in range(6)]
    texts = []
    for i in range(300):
        w = [f"filler{chr(97 + x)}" for x in rng.integers(0, 9, 12)] + [names[x] for x in rng.integers(0, 26, 1)]
        if i % 6 == 0:
            k = int(rng.integers(0, 12))
            w += [mails[k], f"secret{chr(97 + k)}", f"{names[k]}{mails[k]}"] + [nets[k % 6]] * (i % 4 == 0)
        if i % 7 == 0:
            w += ["boss@example.org", "zanzibar"]
        texts.append(" ".join(rng.permutation(w)))
    texts += texts[:20] + [None, "ééa@b.co xyzé@b.co abc"]
    entity, words_in = {}, []
    for i, t in enumerate(texts):
        t = t or ""
        mail = [(m.start(), m.end()) for m in re.finditer(PATTERNS["email"], t)]
        for k in ("email", "ip"):
            for m in re.finditer(PATTERNS[k], t):
                entity.setdefault((k, m[0].lower()), set()).add(i)
        blank = list(t)
        for a, b in mail:
            blank[a:b] = " " * (b - a)
        words_in.append([(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", "".join(blank))])
    n = len(texts)
    of = {}
    for i, ws in enumerate(words_in):
        for *_, w in ws:
            of.setdefault(w, set()).add(i)
    best = {}
    for e, d in entity.items():
        p = len(d) / n
        for w, at in of.items():
            if both := len(d & at):
                share = np.log2((both + p) / (len(at) + 1) / p) / -np.log2(p)
                for i in d & at:
                    best[i, w] = max(best.get((i, w), 0.0), share)
    got = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(rows(texts), DOCS)).select("doc_id", pii.joined(F.col("all_spans")).alias("spans")).collect()}
    kinds = set()
    for i, t in enumerate(texts):
        terms = [(a, 4, b, "removed" if best[i, w] >= pii.REMOVE else "term") for a, b, w in words_in[i] if best.get((i, w), 0) >= pii.GENERALISE]
        kinds |= {x[3] for x in terms}
        spans = [(int(a), ("email", "ip", "card", "phone").index(k), int(b), k) for k, a, b in (x.split(":") for x in base(t).split(",") if x)]
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans + terms)), i
    assert kinds == {"term", "removed"}


def test_dense_texts_take_seconds(spark):
    import time

    mails = " ".join(f"user{i}x@host{i % 50}.org wrote{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} {i}" for i in range(20_000))
    df = spark.createDataFrame(rows([mails, "no address in here", mails + " again"]), DOCS)
    start = time.time()
    got = {r.doc_id: r for r in pii.detect(df).select("doc_id", "n_email").collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert got[0].n_email == 20_000 and "@" not in clean[0] and clean[0].count("[EMAIL]") == 20_000 and clean[1] == "no address in here"
    assert time.time() - start < 90


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack_documents(docs, with_ids=True).toPandas()
    assert packing.pack_documents(empty).count() == 0
    for r in got.itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 2048
    for i, t in enumerate(TEXTS):
        mine = got[got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert [x for ids in mine.ids for x in ids] == real.encode(t or "", add_special_tokens=False).ids + [0]
        assert all(mine.length.iloc[1:] == 2048)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_very_long_texts_of_few_kinds(spark):
    """Runs that a backtracking pattern cannot take; the ids are the named tokenizer's."""
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(packing.tokenizer_path())
    texts = [" " * 3_000_000, "\n" * 3_000_000, "x" + "\t " * 600_000 + "y", "a" * 1_000_000, "!" * 1_000_000 + " end"]
    got = packing.pieces(spark.createDataFrame(rows(texts), DOCS), packing.tokenizer_path(), with_ids=True).toPandas().sort_values(["doc_id", "piece"])
    for i, t in enumerate(texts):
        assert [x for ids in got[got.doc_id == i].ids for x in ids] == real.encode(t, add_special_tokens=False).ids + [0]


def test_bins_are_bounded():
    fit = packing.BestFit(10, 2)
    assert [fit.put(n) for n in (6, 7, 8, 2, 4)] == [(0, 0), (1, 0), (2, 0), (2, 8), (0, 6)]


@pytest.mark.parametrize("hot", [10_000, 1])
def test_suffix_dedup(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    a, b = "".join(chr(97 + i % 26) + str(i) for i in range(200)), "é" * 60
    texts = [a, a[100:300] + "zz", "q" * 49, "q" * 49, "q" * 50, "q" * 51 + "w", b, b[1:], None, "", a + a, "x" + a[10:59]]
    out = suffix_dedup.dedup_suffixes(spark.createDataFrame(rows(texts), DOCS))
    got = {r.doc_id: r for r in out.collect()}
    assert suffix_dedup.dedup_suffixes(empty).count() == 0 and suffix_dedup.dedup_suffixes(docs).count() == docs.count()
    raw = [(t or "").encode() for t in texts]
    for i, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 49):
            if any(t[s : s + 50] in raw[j] for j in range(i)):
                gone[s : s + 50] = True
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256, bytes(got[i].kept)) == (len(t), gone.sum(), spans, hashlib.sha256(kept).hexdigest(), kept)


def test_interleave_equals_a_sort():
    rng = np.random.default_rng(5)
    segs = list(dict.fromkeys(bytes(rng.integers(97, 99, rng.integers(50, 81)).astype(np.uint8)) for _ in range(40))) + [b"a" * 70, b"a" * 60]
    docs = rng.permutation(len(segs))
    got = suffix_dedup.least_documents(segs, docs)
    keys = suffix_dedup.anchor_keys(segs)
    assert len(keys) == len(segs) and keys[-1] == keys[-2]
    for s, out in zip(segs, got, strict=True):
        assert list(out) == [min(d for t, d in zip(segs, docs, strict=True) if s[k : k + 50] in t) for k in range(len(s) - 49)]


def test_suffix_rows_that_move(spark):
    """Rows that move are blocks times parts: 14 MB of one partition are one block."""
    data = [(i, chr(97 + i) * 1_000_000) for i in range(14)]
    held = suffix_dedup.blocks(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), "doc_id", "text")
    assert held.count() == 1 and suffix_dedup.anchors(held, 3).count() <= 3


def test_segments_of_one_document_are_not_merged(monkeypatch):
    segs = [b"a" * 60 + bytes([98 + k]) * 9 for k in range(3)]
    segs = [s for s, key in zip(segs, suffix_dedup.anchor_keys(segs), strict=True) if key == suffix_dedup.anchor_keys(segs)[0]]
    monkeypatch.setattr(suffix_dedup, "least_documents", None)
    least, windows = suffix_dedup.all_least(segs, np.full(len(segs), 7))
    assert len(segs) == 3 and list(least) == [7, 7, 7] and not windows


def test_runs_hold_every_window_once():
    rng = np.random.default_rng(4)
    some = rng.integers(97, 123, 3000).astype(np.uint8)
    texts = [some, some[:49], some[:50], np.zeros(0, np.uint8), np.full(70_000, 97, np.uint8), some[700:], np.tile(some[:7], 30), rng.integers(97, 99, 40_000).astype(np.uint8)]
    sizes = np.array(list(map(len, texts)))
    raw, ends = np.concatenate(texts), np.cumsum(sizes)
    h, start, n, doc = suffix_dedup.runs(raw, sizes)
    at = np.concatenate([np.arange(s, s + k) for s, k in zip(start, n, strict=True)])
    assert list(at) == [s for a, b in zip(ends - sizes, ends, strict=True) for s in range(a, b - 49)] and n.max() <= suffix_dedup.SPAN
    assert ((start >= (ends - sizes)[doc]) & (start + n + 49 <= ends[doc])).all()
    found, data = {}, raw.tobytes()
    for s, x in zip(at.tolist(), np.repeat(h, n).tolist(), strict=True):
        assert found.setdefault(data[s : s + 50], x) == x


def test_sorts_of_packed_numbers_and_of_others():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 40, 200).astype(np.uint64)
    for bits in (40, 60):  # 60 leave no room for the places
        got, order = suffix_dedup.sorted_with_order(x, bits)
        assert list(order) == list(np.argsort(x, kind="stable")) and list(got) == sorted(x)
    sizes = np.array([5, 1, 9, 5])
    letters = rng.integers(1, 4, sizes.sum())
    letters[np.cumsum(sizes) - 1] = 0
    (order, before), (order2, before2) = suffix_dedup.transform(letters, sizes), suffix_dedup.transform(letters << 29, sizes)
    assert list(order) == list(order2) and list(before << 29) == list(before2)


def test_embeddings(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((40, 16)).astype(np.float32)
    v[10:20] = v[0] + rng.standard_normal((10, 16)).astype(np.float32) * 0.04
    v[25] = v[24]
    data = [(i, x.tolist(), int(i % 2) if i > 20 else 0) for i, x in enumerate(v)]
    data += [(50, None, 0), (51, [0.0] * 16, 0), (52, [float("nan")] * 16, 0), (53, [None] * 16, 0), (54, v[0].tolist(), None), (55, [], 0), (None, v[0].tolist(), 0), (57, v[0].tolist()[:8], 0)]
    out = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (np.array([d[2] for d in data[:40]])[:, None] == np.array([d[2] for d in data[:40]])[None, :])
    np.fill_diagonal(link, False)
    comp = np.arange(40)
    for _ in range(40):
        comp = np.array([min([comp[i], *comp[link[i]]]) for i in range(40)])
    assert [(out[i].n_links, out[i].component_id, out[i].kept) for i in range(40)] == [(link[i].sum(), comp[i], comp[i] == i) for i in range(40)]
    assert link.sum() > 20 and all(out[i].n_links == 0 and out[i].kept for i in (50, 51, 52, 53, 54, 55, None, 57))
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = (np.ones(16) + rng.standard_normal((60, 16)) * 0.05).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    want = sorted(map(tuple, embedding_dedup.near_vectors(df).collect()))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    assert sorted(map(tuple, embedding_dedup.near_vectors(df).collect())) == want and sum(w[1] for w in want) > 1000


def test_revisits(spark):
    r = "record_id long, url string, ts long, kind string, headers map<string,string>, outcome string"
    full = {"etag": '"a"', "last-modified": "d1", "content-type": "text/html", "date": "old"}
    data = [(1, "http://WWW.x.org/a/?utm_source=q#t", 10, "response", full, ""), (2, "https://x.org/a", 20, "revisit", {"etag": 'W/"a"', "date": "new", "content-type": "no"}, ""), (3, "x.org/a", 10, "revisit", {}, ""), (4, "x.org/a", 30, "revisit", {"etag": '"b"'}, ""), (5, "x.org/a", 30, "revisit", None, ""), (6, None, 30, "revisit", {}, ""), (7, "x.org/a", None, "revisit", {}, ""), (8, "x.org/a", 25, "response", None, ""), (9, "x.org/a", 22, "revisit", {"last-modified": "d1"}, "")]
    out = {x.record_id: x for x in revisits.resolve(spark.createDataFrame(data, r)).collect()}
    assert {k: (x.outcome, x.refers_to) for k, x in out.items()} == {2: ("resolved", 1), 3: ("no-response", None), 4: ("mismatch", 8), 5: ("unverified", 8), 6: ("no-response", None), 7: ("no-response", None), 9: ("resolved", 1)}
    assert out[2].headers == full | {"etag": 'W/"a"', "date": "new"}
    assert revisits.resolve(spark.createDataFrame([], r)).count() == 0


def test_canonical_url_keeps_the_query(spark):
    want = {
        "h/p?page=2": ["h/p?page=2", "HTTP://www.H:80/p/?utm_source=a&page=2#x", "h/p?gclid=1&page=2&", "h/p.html?page=2&fbclid=c&utm_medium="],
        "h/p?a=1&ref=dev": ["h/p?ref=dev&a=1", "https://h/p?a=1&ref=dev&utm_term=x"],
        "h/p": ["h/p", "h/p?", "h/p/index.html?utm_source=a", "h/p?&&#?a=1"],
        "h/p?q=http://h/": ["h/p?q=http://h/"],
        "h": ["h", "http://h/", "www.h:443"],
    }
    pairs = [(u, k) for k, us in want.items() for u in us]
    df = spark.createDataFrame(pairs, "url string, want string")
    assert [(r.url, r.u) for r in df.select("url", revisits.canonical(F.col("url")).alias("u")).collect()] == pairs


def test_repeated_record_ids(spark):
    data = [(1, "h/a", 10, "response", {"etag": '"a"'}), (1, "h/a", 10, "response", {"etag": '"b"'}), (2, "h/a", 20, "revisit", {"etag": '"b"'}), (2, "h/a", 20, "revisit", {"etag": '"b"'})]
    df = spark.createDataFrame(data, "record_id long, url string, ts long, kind string, headers map<string,string>")
    assert [(r.record_id, r.outcome) for r in revisits.resolve(df).collect()] == [(2, "resolved")] * 2


def test_cotraining(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.quality_score for r in cotraining.score(docs, labels).collect()} == {0.5} and cotraining.score(empty, labels).count() == 0
    d, l_ = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = l_.where("doc_id % 5 = 0").toPandas()
    got = cotraining.score(d, l_.where("doc_id % 5 <> 0")).toPandas().merge(held, on="doc_id")
    for t, floor in (("quality", 0.97), ("toxic", 0.95)):
        assert ((got[f"{t}_score"] >= 0.5) == (got[t] == 1)).mean() > floor
    assert (got[got.toxic == 0].toxic_score < 0.5).mean() > 0.99


def test_both_views_teach(spark):
    """Metadata and text each tell the class of most documents, so labels pass both ways, and the two together beat either."""
    rng = np.random.default_rng(8)
    data, labels, truth = [], [], {}
    for i in range(4000):
        y = int(rng.random() < 0.5)
        truth[i] = y
        source = f"s{rng.integers(0, 4) * 2 + (y if rng.random() < 0.9 else 1 - y)}"
        own = [f"{'good' if y else 'bad'}{chr(97 + k)}" for k in rng.integers(0, 20, 2)] if rng.random() < 0.8 else []
        data.append((i, " ".join(own + [f"word{chr(97 + k)}" for k in rng.integers(0, 26, 12)]), "en", source, int(rng.integers(50, 150))))
        if i % 8 == 0:
            labels.append((i, y))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    features = cotraining.written(docs, known, ("quality",))
    try:
        cotraining.SURE, kept = 0.85, cotraining.SURE
        _, log = cotraining.co_train(features, ("quality",))
        out = cotraining.score(docs, known, ("quality",)).where("doc_id % 8 <> 0").toPandas()
    finally:
        cotraining.SURE = kept
    passed = {v: sum(x["up"] + x["down"] for x in log if x["view"] == v) for v in ("text", "meta")}
    assert min(passed.values()) >= 100, log
    y = out["doc_id"].map(truth)
    right = {v: ((out[f"quality_{v}"] >= 0.5) == (y == 1)).mean() for v in ("text", "meta", "score")}
    assert right["score"] > max(right["text"], right["meta"]) + 0.01, right


def test_scores_of_repeated_and_odd_rows(spark):
    data = [(1, "a good text", "en", "s", 3)] * 2 + [(1, "another text", None, None, None), (None, "a good text", "en", "s", 3), (2, None, "en", "s", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert [r.quality_score for r in cotraining.score(docs, labels, ("quality",)).collect()] == [1.0] * 5
    three = spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    got = [(r.doc_id, r.quality_score) for r in cotraining.score(docs, three, ("quality",)).collect()]
    assert len(got) == 5 and got[0] == got[1] and all(0 <= s <= 1 for _, s in got)


def test_pieces(spark, docs, empty):
    import sentencepiece

    model = piece_lattice.Model.read(piece_lattice.model_path())
    real = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.model_path())
    texts = [*TEXTS[:4], *TEXTS[5:], "  two  spaces ", "▁ mark", "tab\tnew\n\nline", "a" * 200, "internationalization" * 9]
    df = spark.createDataFrame(rows(texts), DOCS)
    coded = piece_lattice.encode(df, model)
    got, back = {r.doc_id: r.ids for r in coded.collect()}, {r.doc_id: r.text for r in piece_lattice.decode(coded, model).collect()}
    for i, t in enumerate(texts):
        want = real.encode(t or "")
        assert got[i] == want, (i, t)
        if "\x00" not in (t or ""):
            assert back[i] == real.decode(want)
    assert piece_lattice.encode(empty, model).count() == 0


def test_pieces_of_whole_documents(spark):
    import sentencepiece

    model, path = piece_lattice.Model.read(piece_lattice.model_path()), "/root/testdata/sf0.01"
    real = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.model_path())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in piece_lattice.op10_piece_lattice(spark, path).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = real.encode(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_pieces_of_long_words(spark, monkeypatch):
    import sentencepiece

    model = piece_lattice.Model.read(piece_lattice.model_path())
    real = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.model_path())
    texts = ["a" * 100_000, "x" + " " * 1000, "ab" * 40 + "日本語" * 30, "wordsthatneverend" * 50, "é" * 70 + "\U0001f600" * 80, "1234567890" * 20]
    monkeypatch.setattr(piece_lattice, "CHUNK", 1000)
    got = {r.doc_id: r.ids for r in piece_lattice.encode(spark.createDataFrame(rows(texts), DOCS), model).collect()}
    assert [got[i] for i in range(len(texts))] == [real.encode(t) for t in texts]


def test_viterbi_of_a_unigram_model(spark):
    pieces = [("▁", -3.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("▁a", -3.5), ("bab", -4.5), ("aba", -6.0)]
    model = piece_lattice.Model((*((p, s, 1) for p, s in pieces), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))), False)
    texts = ["ab", "abab", "ba", "babab", "ac"]
    got = {r.doc_id: r.ids for r in piece_lattice.encode(spark.createDataFrame(rows(texts), DOCS), model).collect()}
    table = dict(pieces)

    def best(t):
        return max(((best(t[:-k])[0] + table[t[-k:]], [*best(t[:-k])[1], t[-k:]]) for k in range(1, len(t) + 1) if t[-k:] in table), default=(-1e9, [])) if t else (0.0, [])

    order = [p for p, _ in pieces]
    for i, t in enumerate(texts[:4]):
        ids = got[i]
        assert "".join(order[x] for x in ids) == "▁" + t and np.isclose(sum(pieces[x][1] for x in ids), best("▁" + t)[0])
    assert got[4] == [order.index("▁a"), len(pieces) + ord("c")]


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    assert set(out.doc_id.dropna()) == {float(r.doc_id) for r in at.collect() if r.doc_id is not None} and len(corpus_pipeline.STAGES) == 5
    assert isinstance(out, pd.DataFrame) and {4.0, 5.0} <= set(out.doc_id)
