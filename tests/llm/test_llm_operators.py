"""Each operator against a brute-force version on small, awkward tables."""

import hashlib
import math
import random
import re
import zlib

import pytest

pytest.importorskip("lumenframe.llm")
from lumenframe.llm import bpe, fingerprints, licenses, lm, mixing, nearcopies, quality, queries, sharding, substring, warc  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _size string, extra int"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghé") for _ in range(r.randrange(1, 6))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ".", "", "\n"]) for _ in range(n))
    out = [make(r.randrange(1, 120)) for _ in range(60)]
    passage = make(40)
    out += [make(30) + " " + passage + " " + make(20) for _ in range(12)]
    near = make(100)
    for _ in range(25):
        w = near.split(" ")
        w[r.randrange(len(w))] = "changed%d" % r.randrange(99)
        out.append(" ".join(w))
    out += [out[3]] * 30 + ["", " \n\t", "word", "Released under the MIT License.", "a | b | c | d.\n" * 20, make(5000), "x" * 5000]
    return [(i, t) for i, t in enumerate([*out, None])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", ("hot" if i % 3 == 0 else f"s{i % 4}") if i % 11 else None, len(t or ""), "clash", i) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPS = {"op1": fingerprints.op1, "op2": bpe.op2, "op3": substring.op3, "op4": nearcopies.op4, "op6": sharding.op6, "op7": quality.op7, "op8": lm.op8, "op9": mixing.op9, "op10": licenses.op10}


@pytest.mark.parametrize("name", OPS)
def test_empty_table(empty, name):
    assert OPS[name](empty).count() == 0


def test_fingerprints(docs, texts):
    rows = {r.doc_id: r for r in fingerprints.op1(docs).collect()}
    piece = re.compile(r"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,%d}" % fingerprints.WORDS)
    pieces = lambda x: {m.group() for m in piece.finditer(x)}
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    order = sorted(((i, t or "") for i, t in texts), reverse=True)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r.near_edited, like(pieces(t), pieces(edited))) and math.isclose(r.near_next, like(pieces(t), pieces(after)))
        assert (r.fingerprint == rows[3].fingerprint) == (pieces(t) == pieces(texts[3][1]))


def test_bpe_equals_tiktoken(docs, texts):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = {r.doc_id: r for r in bpe.op2(docs).collect()}
    for i, t in texts:
        ids = own.encode_ordinary(t or "")
        assert tuple(rows[i]) == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


@pytest.mark.parametrize("size", [13, 30])
def test_substring(docs, texts, size):
    rows = {r.doc_id: r for r in substring.dedup(docs.select("doc_id", "text"), size).collect()}
    first, words = {}, {i: WORD.findall(t or "") for i, t in texts}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert tuple(rows[i]) == (i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def _components(texts, size=2):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        before = dict(label)
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return sets, label


@pytest.mark.parametrize("chunk", [512, 8])
def test_near_copies(docs, texts, chunk, monkeypatch):
    monkeypatch.setattr(nearcopies, "CHUNK", chunk)  # small chunks take the way of large clusters, small lists that of long ones
    monkeypatch.setattr(nearcopies, "LIST", chunk)
    sets, label = _components(texts)
    rows = {r.doc_id: tuple(r) for r in nearcopies.op4(docs).collect()}
    assert rows == {i: (i, len(sets[i]), label[i], label[i] == i) for i in sets}


def test_warc(spark):
    data = [(i, f"https://www.h{i % 3}.org/p{i % 7}?q#f", "same" if i % 2 else f"<p>{i}\r\n\r\nWARC/1.1\r\n") for i in range(40)] + [(50, None, None), (51, "http://x/\n", "")]
    rows = warc.op5(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    import base64

    first = {}
    for i, _, h in data:
        first.setdefault(h or "", i)
    expected = set()
    for i, _, h in data:
        body, f = (h or "").encode(), first[h or ""]
        expected.add((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if f < i else "response", f if f < i else None))
    assert {tuple(r)[:5] for r in rows} == expected and len(rows) == len(data)
    keys = [(r.urlkey, r.captured, r.page_id) for r in sorted(rows, key=lambda r: r.place)]
    assert keys == sorted(keys) and sorted(r.place for r in rows) == list(range(len(rows)))
    assert warc.op5(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shards(docs, texts):
    rows = sharding.op6(docs).collect()
    sizes, slots = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    by_id = dict(texts)
    assert all(r["size"] == len((by_id[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((by_id[r.doc_id] or "").encode()) for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(texts)
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + 2 * largest


def test_quality(docs, texts):
    rows = {r.doc_id: r for r in quality.op7(docs).collect()}
    for i, t in texts:
        w = WORD.findall(t or "")
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)} if len(w) < 1000 else None
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
        assert covered is None or r.n_repeat_words == len(covered)
    assert not rows[len(texts) - 4].kept  # bars


def test_schedule_stays_within_a_block():
    quota = mixing.quotas({"a": 0.5, "b": 0.3, "c": 0.19, None: 0.01})
    order = mixing.schedule(quota)
    for s, q in quota.items():
        had = 0
        for t, x in enumerate(order, 1):
            had += x == s
            assert abs(had - q * t / len(order)) < 1


def test_mix_uses_every_document(docs, texts):
    rows = mixing.op9(docs).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in texts}
    stage = mixing.stage(docs)
    assert stage.columns == docs.columns and {r.text for r in stage.collect()} == {t for _, t in texts}


def test_license_places(docs, texts):
    rows = {r.doc_id: r for r in licenses.op10(docs).collect()}
    i = next(i for i, t in texts if t and t.startswith("Released"))
    assert tuple(rows[i]) == (i, 5, 1, 3, 3, "mit", "mit,mit-notice", 1.0)
    assert rows[0].n_base == 0 and rows[0].first_word is None and rows[0].base_labels == ""


@pytest.mark.parametrize("name", [k for k in queries.oracle_sql() if "warc" not in k])
def test_sql_on_awkward_texts(docs, name):
    duckdb, pa = pytest.importorskip("duckdb"), pytest.importorskip("pyarrow")
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([{"doc_id": r.doc_id, "text": r.text} for r in docs.collect()]))
    got = OPS[name.split("_")[0]](docs)
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(found, key=str)


def test_warc_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    got = queries.queries()["op5_warc_captures"](spark, path)
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()['op5_warc_captures']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(found, key=str)


def test_pipeline_against_its_parts(docs, spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    now = docs.drop("extra", "_size")
    good = {r.doc_id for r in quality.op7(docs).collect() if r.kept}
    now = pipeline.quality_rules(spark, now, "").cache()
    assert {r.doc_id for r in now.collect()} == good
    _, label = _components([(r.doc_id, r.text) for r in now.collect()], 5)
    now = pipeline.near_dedup(spark, now, "").cache()
    assert {r.doc_id for r in now.collect()} == {i for i, k in label.items() if i == k}
    expected = {r.doc_id: r.kept_sha256 for r in substring.op3(now).collect()}
    now = pipeline.substring_dedup(spark, now, "").cache()
    assert {r.doc_id: hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() for r in now.collect()} == expected
    mixed = pipeline.source_mix(spark, now, "").cache()
    assert {r.doc_id for r in mixed.collect()} == set(expected)
    coder = bpe.bpe(*bpe.default_vocabulary())
    assert all(coder.decode(r.token_ids).decode() == r.text for r in pipeline.token_ids(spark, mixed, "").collect())
