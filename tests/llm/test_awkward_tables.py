"""Null, repeated and extreme ids, one text or source of a third of all rows, a very long text, clashing column names: for every operator."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("lumenframe.llm")
from lumenframe.llm import blocks, bpe, fingerprints, licenses, lm, mixing, nearcopies, quality, sharding, substring, warc  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, source string, n_chars long, token_ids string, n_tokens string, slot int, block string, epoch int, target_weight string, shard int, _size string, _null int, _row string, rest string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randrange(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(r.choices(vocabulary, k=n))
    hot = make(120)
    out = [(i, make(r.randrange(1, 150))) for i in range(100)] + [(1000 + i, hot) for i in range(60)]
    out += [(None, hot), (None, None), (None, make(30)), (2**63 - 1, hot), (-(2**63), make(40)), (2**63 - 1, make(50))]
    out += [(7, make(30)), (7, make(30)), (8, out[8][1]), (3000, make(20_000)), (3001, "")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


@pytest.fixture(scope="module")
def clashing(spark, rows):
    wide = [(i, t, "hot" if k % 3 else None, len(t or ""), "x", "x", 1, "x", 1, "x", 1, "x", 1, "x", "x") for k, (i, t) in enumerate(rows) if len(t or "") < 5000]
    return spark.createDataFrame(wide, CLASH).repartition(3).cache()


def test_fingerprints(docs, rows):
    found = fingerprints.op1(docs).collect()
    assert len(found) == len(rows) and Counter(r.n_chars for r in found) == Counter(len(t or "") for _, t in rows)
    of = {}
    for r in found:
        of.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    single = {i: t for i, t in rows if sum(j == i for j, _ in rows) == 1}
    order = sorted(single, reverse=True)
    by_id = {r.doc_id: r for r in found}
    for a, b in zip(order, order[1:], strict=False):
        if not any(i is not None and a > i > b for i, _ in rows):
            t = single[a] or ""
            edited = t[: len(t) - len(t) // 3] + (single[b] or "")[: len(t) // 3]
            assert by_id[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_long_differing_texts(spark):
    r = random.Random(2)
    texts = [(i, "\n".join(" ".join("%x" % r.getrandbits(24) for _ in range(20)) for _ in range(1500))) for i in range(2)]
    near = {x.doc_id: x for x in fingerprints.op1(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert near[0].near_next == near[1].near_next == 0.0 and near[0].near_edited > 0.4


def test_one_repeated_id_is_cut(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = [(5, f"text {i}") for i in range(300)] + [(i, f"other {i}") for i in range(10, 40)]
        got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    after = {(r.doc_id, r.text): r.next_text for r in got}
    assert len(got) == len(rows) and Counter(after.values()) == Counter(t for _, t in rows)  # one ring through all rows
    seen, at = set(), "other 39"
    while at not in seen:
        seen.add(at)
        at = next(n for (_, t), n in after.items() if t == at)
    assert len(seen) == len(rows)


def test_bpe(docs, rows, clashing):
    coder = bpe.bpe(*bpe.default_vocabulary())
    found = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.op2(docs).collect())
    assert found == Counter((i, len(coder.encode(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    out = bpe.stage(clashing)
    assert sorted(out.columns) == sorted(clashing.columns) and all(r.n_tokens == len(r.token_ids) and coder.decode(r.token_ids).decode() == (r.text or "") for r in out.collect())


def test_bpe_memo_and_high_characters(monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    monkeypatch.setattr(bpe, "MEMO", 3)
    path, pattern = bpe.default_vocabulary()
    coder = bpe.Bpe(bpe.load_ranks(path), pattern)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})
    r = random.Random(4)
    for _ in range(300):
        t = "".join(r.choices("aeZ  '\n\t.,!0٣é漢\U0001f600\u2003\x1c𝒜", k=r.randrange(60)))
        assert coder.encode(t) == own.encode_ordinary(t), t


def _windows(rows, size=13):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        k = 2**63 - 1 if i is None else i
        for j in range(len(w) - size + 1):
            g = tuple(w[j : j + size])
            first[g] = min(first.get(g, k), k)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < (2**63 - 1 if i is None else i):
                gone[j : j + size] = [True] * size
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("frame", [4 << 20, 2000])
def test_substring(docs, rows, frame, monkeypatch):
    monkeypatch.setattr(blocks, "FRAME_BYTES", frame)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4 * frame)
    real = lambda i: None if i == 2**63 - 1 else i  # noqa: E731 - the largest id stands for null
    assert Counter(map(tuple, substring.op3(docs).collect())) == Counter((real(a), *b) for a, *b in _windows(rows))


def test_substring_stage(clashing):
    out = substring.stage(clashing)
    assert out.schema == clashing.schema and out.count() == clashing.count()
    assert {r.text for r in out.collect()} >= {None, ""} and all(r.n_chars == len(r.text or "") for r in out.collect())
    assert substring.stage(clashing.select("doc_id", "text")).columns == ["doc_id", "text"]


def test_near_copies(docs, rows, clashing):
    sets = {}
    low = lambda t: WORD.findall((t or "").lower())
    for i, t in rows:
        w = low(t)
        sets.setdefault(frozenset(zip(w, w[1:], strict=False)) or frozenset([tuple(w)] if w else []), set()).add(2**63 - 1 if i is None else i)
    classes = list(sets)
    label = {c: min(sets[c]) for c in classes}
    for _ in classes:
        before = dict(label)
        for a in classes:
            for b in classes:
                if a and 100 * len(a & b) >= 80 * len(a | b):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    real = lambda i: None if i == 2**63 - 1 else i
    want = Counter()
    for i, t in rows:
        w, k = low(t), 2**63 - 1 if i is None else i
        s = frozenset(zip(w, w[1:], strict=False)) or frozenset([tuple(w)] if w else [])
        c = label[s] if s else k
        want[(real(k), len(s), real(c), c == k)] += 1
    assert Counter(map(tuple, nearcopies.op4(docs).collect())) == want
    out = nearcopies.stage(clashing, shingle=2)
    assert out.schema == clashing.schema
    left = Counter(r.text for r in out.collect())
    assert all(n == 1 for t, n in left.items() if t and len(t.split()) > 2)  # one of each group, whatever its ids are


def test_warc(spark):
    data = [(i, f"http://h{i % 2}/x", "hot" if i % 3 else f"p{i}") for i in range(60)] + [(2**62, "http://h/", "hot"), (None, None, "hot"), (None, "u", None), (5, "http://h5/", "hot"), (5, "http://h5/", "hot"), (-4, "http://h/", "hot")]
    out = warc.op5(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert len(out) == len(data) and Counter((r.page_id, r.payload_bytes) for r in out) == Counter((i, len(h or "")) for i, _, h in data)
    assert all((r.record_type, r.refers_to) == (("revisit", -4) if r.page_id is not None and r.page_id > -4 else ("response", None)) for r in out if r.payload_bytes == 3 and r.payload_digest == next(x for x in out if x.page_id == -4).payload_digest)
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r.captured) for r in out) and sorted(r.place for r in out) == list(range(len(out)))


def test_shards_of_equal_texts_and_odd_ids(spark):
    data = [(i, "copy of a text") for i in range(1500)] + [(None, "copy of a text")] * 1500 + [(2**63 - 1, "copy of a text"), (-(2**63), "x"), (None, None)]
    out = sharding.op6(spark.createDataFrame(data, "doc_id long, text string")).collect()
    sizes, slots = Counter(), {}
    for r in out:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    total = sum(sizes.values())
    assert len(out) == len(data) and len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 0.01 * total / 16 + 2 * 15
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in data)


def test_splitters_against_a_full_sort(spark, docs, monkeypatch):
    keys = sharding.staged(sharding.keyed(docs), "test-keys").cache()
    order = sorted((r.h, r.k, r["size"]) for r in keys.collect())
    total, at, below = sum(x[2] for x in order), 0, {}
    for h, k, n in order:
        below[h, k] = at
        at += n
    largest = max(x[2] for x in order)
    for i, cut in enumerate(sharding.splitters(keys, 16, 0.002), 1):
        got = sum(n for h, k, n in order if (h, k) < tuple(cut))
        assert abs(got - total * i / 16) <= max(0.002 * total / 16, largest)


def test_shard_documents(clashing):
    out = sharding.shard_documents(clashing, 4)
    assert sorted(out.columns) == sorted(clashing.columns) and out.count() == clashing.count() and {r.shard for r in out.collect()} == {0, 1, 2, 3}


def test_quality(docs, rows, clashing):
    assert Counter((r.doc_id, r.n_words) for r in quality.op7(docs).collect()) == Counter((i, len(WORD.findall(t or ""))) for i, t in rows)
    out = quality.stage(clashing)
    assert out.schema == clashing.schema


def test_quality_stage_passes_cleaned_text(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    texts = [(1, f"{good}\nCookie policy | Terms of use\nHome > News > Sport > Video\n{good[::-1]}", 5), (2, "http://a.b http://c.d www.e.f\n" + good, 5), (3, "All rights reserved\n" * 9, 5), (4, good, 77)]
    out = {r.doc_id: r for r in quality.stage(spark.createDataFrame(texts, "doc_id long, text string, n_chars long")).collect()}
    assert out[1].text == f"{good}\n{good[::-1]}" and out[1].n_chars == len(out[1].text) and out[2].text == good and 3 not in out and (out[4].text, out[4].n_chars) == (good, 77)


def test_language_model_has_a_row_for_each(docs, rows):
    assert Counter(r.doc_id for r in lm.op8(docs).collect()) == Counter(None if i == 2**63 - 1 else i for i, _ in rows)


def test_mix(clashing):
    out = mixing.mix(clashing)
    assert out.columns.count("slot") == 1 and {r.text for r in out.collect()} == {r.text for r in clashing.collect()}
    again = mixing.mix(clashing.repartition(7))
    pick = ("doc_id", "text", "block", "epoch", "slot")
    assert Counter(tuple(r[c] for c in pick) for r in out.collect()) == Counter(tuple(r[c] for c in pick) for r in again.collect())
    stage = mixing.stage(clashing)
    assert stage.columns == clashing.columns


def test_licenses_wherever_they_start(spark):
    r = random.Random(6)
    pad = lambda n: " ".join("".join(r.choices("qzxvkj", k=5)) for _ in range(n))
    templates = dict(licenses.TEMPLATES)
    header = templates["gpl-header"].split()
    spread = " ".join(w + (" " + pad(1) if i % 2 else "") for i, w in enumerate(header))
    texts = [(i, f"{pad(i)} {spread} {pad(50)}") for i in range(0, 80, 3)]
    texts += [(200, pad(90) + " " + templates["mit-text"] + " " + pad(30)), (201, " ".join(templates["mit-text"].split()[:80])), (202, pad(3000) + " " + templates["isc-text"])]
    found = {x.doc_id: set(x.labels.split(",")) for x in licenses.op10(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all("gpl-header" in found[i] for i in range(0, 80, 3))
    assert {"mit-text", "mit-permission", "warranty-disclaimer"} <= found[200] and "mit-text" not in found[201] and "isc-text" in found[202]
