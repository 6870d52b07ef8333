"""Every stage of the pipeline against brute force, on rows with nulls, empties, long texts, ties, repeats and clashing columns."""

import re
import zlib

import numpy as np
import pytest

pytest.importorskip("lociflow.llm")
import corpus_pipeline  # noqa: E402
import xxhash  # noqa: E402
from lociflow.llm import packing, tokens, toxicity  # noqa: E402

LOW = -(1 << 63)
CLASHES = "gone keep _keep _kept kept t t1 t2 to fp c n key doc node id starts copy text_hash hash score label m0 block _n".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
STAGES = dict(corpus_pipeline.STAGES)


def rows_of():
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 3000, n))
    line = "A line of forty or more characters, in many documents"
    base, other = text(120), text(90)
    passage = text(30)
    rows = [(None, text(40)), (None, None), (1, None), (2, ""), (3, base), (4, base), (4, base), (5, base + " " + text(4)), (6, text(60) + " " + passage + " " + text(20)), (7, passage + " " + text(50))]
    rows += [(10 + i, f"{text(25)}\n {line.upper() if i % 2 else line}\t\n{text(6)}") for i in range(6)] + [(15, f"{line}\n{line}")]
    rows += [(30, other), (30, text(80)), (31, other), (32, "é" * 60 + " " + text(30)), (33, "ü " + "é" * 60), (40, text(6000)), (41, "\n\n"), (42, "word"), (43, "Word")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), *range(len(CLASHES))) for i, t in rows_of()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def result(df):
    assert df.columns == [x.split()[0].strip("`") for x in SCHEMA.split(", ")]
    out = df.collect()
    assert all(tuple(r[5:]) == tuple(range(len(CLASHES))) for r in out)
    return sorted([(LOW if r["doc_id"] is None else r["doc_id"], r["text"]) for r in out], key=repr)


def given():
    return [(LOW if i is None else i, t) for i, t in rows_of()]


def keyed(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 44)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_toxicity(spark, docs, sf):
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    import pyarrow as pa

    keep = [r for r in given() if toxicity.scores(model, pa.array([r[1]], pa.string()))[0] < toxicity.THRESHOLD]
    assert 0 < len(keep) <= len(given())
    assert result(STAGES["toxicity"](spark, docs, sf)) == keyed(keep)


def test_line_dedup(spark, docs, sf):
    key = lambda x: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for i, t in given():
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    want = [(i, t if t is None else "\n".join(x for x in t.split("\n") if i >= gone.get(key(x), LOW))) for i, t in given()]
    assert want != given()
    assert result(STAGES["line_dedup"](spark, docs, sf)) == keyed(want)


def shingled(t, n):
    w = re.findall(rb"[^ \t-\r]+", (t or "").encode().lower())
    return [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []


def fingerprint(t):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingled(t, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_copies(spark, docs, sf):
    rows = given()
    prints, sets = [fingerprint(t) for _, t in rows], [set(shingled(t, 5)) for _, t in rows]
    label = {i: i for i, _ in rows}
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3 or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    for _ in rows:
        for a, b in near:
            i, j = rows[a][0], rows[b][0]
            label[i] = label[j] = min(label[i], label[j])
    want = [r for r in rows if label[r[0]] == r[0]]
    assert len(want) < len(rows)
    assert result(STAGES["simhash"](spark, docs, sf)) == keyed(want)


def test_passages(spark, docs, sf):
    first = {}
    for i, t in given():
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    want = []
    for i, t in given():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(int)))
        want.append((i, t if not gone.any() else "".join(b[x:y].decode(errors="ignore") for x, y in zip(edges[::2], edges[1::2], strict=True))))
    assert sum(a != b for a, b in zip(want, given(), strict=True)) >= 5
    assert result(STAGES["suffix_dedup"](spark, docs, sf)) == keyed(want)


def test_packing(spark, docs, sf):
    library = tokens.encoder(tokens.default_tokenizer()).whole
    ids = sorted((i, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in given())
    pieces = sorted(STAGES["packing"](spark, docs, sf).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    assert sum(r["length"] for r in pieces) * 4 == sum(len(b) for _, b in ids)
    # Documents come in ascending order, pieces of one document after the other; rows of one id come in any order.
    named = lambda r: LOW if r["doc_id"] is None else r["doc_id"]
    assert [named(r) for r in pieces] == sorted(named(r) for r in pieces)
    left, data, at = list(ids), b"", 0
    for r in pieces:
        if at == len(data):
            size = 4 * r["length"]
            data = next(b for i, b in left if i == named(r) and len(b) == 4 * r["doc_tokens"] and zlib.crc32(b[:size]) == r["ids_crc32"])
            left.remove((named(r), data))
            at = 0
        part = data[at : at + 4 * r["length"]]
        assert (r["start"] * 4, r["doc_tokens"] * 4, r["ids_crc32"]) == (at, len(data), zlib.crc32(part))
        at += len(part)
    assert not left and at == len(data)
    filled = {}
    for r in pieces:
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(filled) == list(range(len(filled))) and max(filled.values()) <= packing.WINDOW


def test_empty(spark, sf):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_whole_run(spark, docs, sf):
    docs.write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # What no stage takes is there as it was.
    lone = next(t for i, t in rows_of() if i == 40)
    n = len(tokens.encoder(tokens.default_tokenizer()).whole.encode(lone, add_special_tokens=False).ids) + 1
    assert out.filter("doc_id = 40").agg({"length": "sum"}).first()[0] in (n, None)
