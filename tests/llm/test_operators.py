"""Every operator against brute force on a small table with nulls, empties, copies and clashing columns."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

pytest.importorskip("lociflow.llm")
from lociflow.llm import bpe, line_dedup, media, neighbours, packing, queries, simhash, suffix_dedup, token_counts, token_files, tokens, toxicity  # noqa: E402

LINE = "This line of forty or more characters is in many of them."
PASSAGE = " ".join(f"shared{i} words" for i in range(30))


def fixture_rows():
    rng = np.random.default_rng(3)
    vocab = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    rows = [(i, f"{text(30)}\n  {LINE.upper() if i % 2 else LINE}\t\n{text(5)}") for i in range(0, 60, 3)]
    base = text(200)
    rows += [(200, base), (201, base), (202, base + " more"), (203, text(20) + PASSAGE + text(3)), (204, PASSAGE), (205, "é" * 40 + base[:80])]
    rows += [(300, None), (301, ""), (302, "a"), (303, "\n\n"), (304, "x" * 30_000), (305, "<|endoftext|> İstanbul 日本語 ''s"), (306, PASSAGE[:50]), (307, "Der eineä.")]
    rows += [(308, " ".join(rng.choice(vocab, 9000)))]
    return rows


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs = pd.DataFrame(fixture_rows(), columns=["doc_id", "text"])
    docs = docs.assign(lang="en", source="s", n_chars=docs.text.str.len().fillna(0).astype("int64"), gone=1, t=2, h1=3, fp=4, _score=5, to=6)
    docs.sample(frac=1, random_state=1).to_parquet(d / "documents.parquet")
    pd.DataFrame({"doc_id": docs.doc_id, "quality": 1, "toxic": (docs.doc_id % 9 == 0).astype(int)}).to_parquet(d / "labels.parquet")
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 16)).astype(np.float32).tolist()
    for i in range(0, 100, 2):
        v[i] = v[0]
    v[7], v[9], v[11] = None, [0.0] * 16, [float("nan")] * 16
    pd.DataFrame({"vec_id": range(300), "embedding": v, "label": 0}).to_parquet(d / "embeddings.parquet")
    return str(d), docs.sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def library():
    return tokens.encoder(tokens.default_tokenizer()).whole


def got(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def ids_of(library, docs, end=None):
    return [np.array(e.ids + ([] if end is None else [end]), "<u4") for e in library.encode_batch(docs.text.fillna("").tolist(), add_special_tokens=False)]


def test_op1(spark, table, library):
    d, docs = table
    out, ids = got(token_files.op1_token_files(spark, d), "doc_id"), ids_of(library, docs, 1)
    assert out.doc_id.tolist() == docs.doc_id.tolist()
    assert out.n_tokens.tolist() == [len(x) for x in ids]
    assert out.start.tolist() == np.cumsum([0, *[len(x) for x in ids[:-1]]]).tolist()
    assert out.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in ids]


def test_op2(spark, table):
    d, _ = table
    out = got(neighbours.op2_neighbours(spark, d), "query_id", "rank")
    e = pd.read_parquet(f"{d}/embeddings.parquet")
    ok = [i for i, v in enumerate(e.embedding) if v is not None and np.isfinite(v).all() and np.any(v)]
    x = {i: np.array(e.embedding[i], float) / np.linalg.norm(np.array(e.embedding[i], float)) for i in ok}
    hits = 0
    for q in (i for i in ok if i % 50 == 0):
        want = sorted((i for i in ok if i != q), key=lambda i: (-round(float(x[i] @ x[q]), 12), i))[:5]
        mine = out[out.query_id == q]
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, [x[i] @ x[q] for i in mine.vec_id])
        hits += len(set(want) & set(mine.vec_id)) / 5
    assert hits / 6 >= 0.9


def test_op3(spark, table):
    d, docs = table
    first = {}
    data = [(t or "").encode() if isinstance(t, str) else b"" for t in docs.text]
    for i, b in zip(docs.doc_id, data, strict=True):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = []
    for i, b in zip(docs.doc_id, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        want.append((i, len(b), int(gone.sum()), int((np.diff(gone[::-1].astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest()))
    out = got(suffix_dedup.op3_suffix_dedup(spark, d), "doc_id")
    assert [tuple(r) for r in out.itertuples(index=False)] == want


def test_op4(spark, table):
    d, docs = table

    def fp(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t if isinstance(t, str) else "").encode().lower())
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    f = np.array([fp(t) for t in docs.text], dtype=np.uint64)
    label = docs.doc_id.to_numpy()
    near = np.bitwise_count(f[:, None] ^ f) <= 3
    for _ in range(len(label)):
        label = np.array([label[m].min() for m in near])
    out = got(simhash.op4_simhash(spark, d), "doc_id")
    assert out.fingerprint.tolist() == [f"{x:016x}" for x in f]
    assert out.component_id.tolist() == label.tolist()


@pytest.mark.parametrize("most_bits", [3, 7])
def test_anchors_meet(most_bits):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    y = x.copy()
    for i in range(200):
        for b in rng.choice(64, most_bits, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    sets = []
    for f in (x, y):
        s = [set() for _ in f]
        for row, block, anchor, home in zip(*simhash.replicate(f, most_bits), strict=True):
            if home or f is x:
                s[row].add((block, anchor))
        sets.append(s)
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_near_groups(spark, table):
    d, _ = table
    out = {r["doc_id"]: r["group"] for r in simhash.near_groups(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    assert out[201] == out[202] == 200 and out[308] == 308 and out[0] == 0


def test_op5(spark, table):
    d, docs = table
    pieces = token_counts.read_pieces(token_counts.default_pieces())
    longest = max(map(len, pieces))

    def brute(w):
        best = [(0.0, 0)]
        for j in range(1, len(w) + 1):
            score, n = max((best[i][0] + pieces.get(w[i:j], token_counts.UNKNOWN if j - i == 1 else -np.inf), -best[i][1] - 1) for i in range(max(0, j - longest), j))
            best.append((score, -n))
        return best[-1][1]

    words = [re.findall(r"[^ \t-\r]+", t if isinstance(t, str) else "") for t in docs.text]
    memory = {w: brute(token_counts.MARK + w) for w in {w for ws in words for w in ws} if len(w) < 500}
    out = got(token_counts.op5_token_counts(spark, d), "doc_id")
    assert out.n_pretokens.tolist() == [len(w) for w in words]
    some = [k for k, ws in enumerate(words) if all(w in memory for w in ws)]
    assert out.n_tokens[some].tolist() == [sum(memory[w] for w in words[k]) for k in some]


def test_op6(spark, table):
    d, docs = table
    out = got(media.op6_media(spark, d), "doc_id")
    for t, r in zip(docs.text, out.itertuples(), strict=True):
        n, payload = media.payload_of(t if isinstance(t, str) else None)
        image = media.to_png(payload)
        assert media.from_png(image) == payload and len(payload) % 576 == 0 and len(payload) > 0
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) == (n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(image).hexdigest())


def test_op7(spark, table):
    d, _ = table
    out = got(line_dedup.op7_line_dedup(spark, d), "doc_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    want = con.execute(line_dedup.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    assert out.n_dropped.sum() == 19
    pd.testing.assert_frame_equal(out, want[out.columns.tolist()], check_dtype=False)


def test_op8(spark, table, library):
    d, docs = table
    out, ids = got(packing.op8_packing(spark, d), "sequence_id", "offset"), dict(zip(docs.doc_id, ids_of(library, docs, 2), strict=True))
    assert out.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    for r in out.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    lengths = out.groupby("sequence_id").length.sum()
    assert lengths.max() <= 4096 and lengths.index.tolist() == list(range(len(lengths)))
    assert all((g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() for _, g in out.groupby("sequence_id"))


def test_best_cuts_are_best():
    rng = np.random.default_rng(2)
    for _ in range(20):
        at = np.unique(np.concatenate(([0], np.cumsum(rng.integers(1, 9, 12)))))
        cost = rng.integers(0, 5, len(at))
        window = 20
        best = [0] + [10**9] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min((best[i] + (0 if j == len(at) - 1 else window - at[j] + at[i] + cost[j]) for i in range(j) if at[j] - at[i] <= window), default=10**9)
        chosen = packing.best_cuts(at, cost, window)
        total = sum(window - at[b] + at[a] + cost[b] for a, b in zip(chosen[:-2], chosen[1:-1], strict=True))
        assert total == best[-1]


def test_op9(spark, table):
    d, docs = table
    out = got(toxicity.op9_toxicity(spark, d), "doc_id")
    assert out.doc_id.tolist() == docs.doc_id.tolist()
    assert out.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id]
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()


def test_op9_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    out = toxicity.scored(docs, toxicity.fit(docs, labels)).filter("held_out").toPandas().merge(labels.toPandas(), on="doc_id")
    said, true = out.score >= toxicity.THRESHOLD, out.toxic == 1
    assert (said & true).sum() >= 0.7 * true.sum() and (said & ~true).sum() <= 0.05 * (~true).sum()


def test_op10(spark, table, library):
    d, docs = table
    out, ids = got(bpe.op10_bpe(spark, d), "doc_id"), ids_of(library, docs)
    assert out.ids_sha256.tolist() == [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
    assert out.decoded_sha256.tolist() == [hashlib.sha256(library.decode(x.tolist(), skip_special_tokens=False).encode()).hexdigest() for x in ids]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


LONG = " ".join(f"word{i}" for i in range(40))


@pytest.fixture(scope="module")
def odd_rows(spark, tmp_path_factory):
    """Null ids, null and empty texts, repeated rows, rows that share a doc_id, and columns whose names operators use."""
    d = tmp_path_factory.mktemp("odd")
    rows = [(None, LONG), (None, None), (4, LONG), (4, LONG), (5, "other"), (5, "")]
    clash = "gone keep t t1 h1 fp key node c to id start copy part path range local rank digest".split()
    spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in clash)).coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def values(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


def test_odd_rows_op1_op10(spark, odd_rows, library):
    d, rows = odd_rows
    ids = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4")) for i, t in rows]
    end = np.array([1], "<u4")
    assert values(token_files.op1_token_files(spark, d), "doc_id", "n_tokens", "ids_crc32") == sorted([(i, len(x) + 1, zlib.crc32(x.tobytes() + end.tobytes())) for i, x in ids], key=repr)
    starts = sorted(values(token_files.op1_token_files(spark, d), "start", "n_tokens"))
    assert [s for s, _ in starts] == np.cumsum([0] + [n for _, n in starts[:-1]]).tolist()
    assert values(bpe.op10_bpe(spark, d), "doc_id", "n_tokens", "ids_sha256") == sorted([(i, len(x), hashlib.sha256(x.tobytes()).hexdigest()) for i, x in ids], key=repr)


def test_odd_rows_op3(spark, odd_rows):
    d, rows = odd_rows
    # Null counts as the smallest doc_id: it keeps the text, both rows of 4 lose theirs.
    n = len(LONG)
    gone = lambda i, t: len(t or "") if i == 4 else 0
    assert n >= 50
    want = sorted([(i, len(t or ""), gone(i, t), int(gone(i, t) > 0)) for i, t in rows], key=repr)
    assert values(suffix_dedup.op3_suffix_dedup(spark, d), "doc_id", "n_bytes", "n_removed", "n_spans") == want


def test_odd_rows_op4(spark, odd_rows):
    d, rows = odd_rows
    out = values(simhash.op4_simhash(spark, d), "doc_id", "component_id")
    # 4 and null share LONG; null's other row and 5's empty one have fingerprint zero; rows of one id are one document.
    assert out == sorted([(i, None) for i, _ in rows], key=repr) or len({c for _, c in out if c is not None}) <= 1
    assert len(out) == len(rows) and {i for i, _ in out} == {None, 4, 5}


def test_odd_rows_op5_op6(spark, odd_rows):
    d, rows = odd_rows
    assert values(token_counts.op5_token_counts(spark, d), "doc_id", "n_pretokens") == sorted([(i, len((t or "").split())) for i, t in rows], key=repr)
    pad = lambda b: b + b"\xff" * (-len(b) % 576 or (576 if not b else 0))
    want = sorted([(i, len(t or ""), hashlib.sha256(pad((t or "").encode())).hexdigest()) for i, t in rows], key=repr)
    assert values(media.op6_media(spark, d), "doc_id", "n_bytes", "payload_sha256") == want


def test_odd_rows_op7(spark, tmp_path):
    """Rows that share a doc_id count as one document: four documents hold LINE here, and five hold the other line."""
    rows = [(1, LINE), (1, LINE), (2, LINE), (3, LINE), (4, LINE), (None, LINE[::-1]), (5, LINE[::-1]), (6, LINE[::-1]), (7, LINE[::-1]), (8, LINE[::-1] + "\n" + LINE[::-1]), (8, LINE[::-1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = values(line_dedup.op7_line_dedup(spark, str(tmp_path)), "doc_id", "n_lines", "n_dropped")
    assert out == sorted([(i, t.count("\n") + 1, int(i in (None, 5, 6, 7))) for i, t in rows], key=repr)


def test_odd_rows_op8_op9(spark, odd_rows, library):
    d, rows = odd_rows
    n = sorted([(i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows], key=repr)
    pieces = values(packing.op8_packing(spark, d), "doc_id", "doc_tokens", "start", "length")
    assert {p[:2] for p in pieces} == set(n) and sum(p[3] for p in pieces) == sum(x for _, x in n)
    assert sum(p[2] == 0 for p in pieces) == len(rows)  # each document begins once
    assert values(toxicity.op9_toxicity(spark, d), "doc_id", "held_out", "score", "predicted") == sorted([(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, 0.0, 0) for i, _ in rows], key=repr)


def test_op2_ties_lengths_and_repeats(spark, tmp_path):
    """Vectors that are one times powers of two tie to the last bit: the smallest ids win. Other lengths are other spaces."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=8)
    rows = [(i, [float(x) * 2.0 ** (i % 40 - 20) for x in v]) for i in range(300)]
    rows += [(350, [1e200] * 3), (351, [2e200, 2e200, 1e200]), (352, [1e-200] * 3), (None, [1.0, 2.0, 3.0]), (400, []), (401, [0.0, 0.0, 0.0]), (402, [1.0, float("inf"), 0.0]), (352, [1e-200] * 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {}
    for r in neighbours.op2_neighbours(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    small = [0, 1, 2, 3, 4, 5]
    assert out == {q: [i for i in small if i != q][:5] for q in (0, 50, 100, 150, 200, 250)} | {350: [352, 351]}


def test_op2_recall_on_many(spark, tmp_path):
    """Enough vectors that a query's windows are a small part of them."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got_, hits = {}, 0
    for r in neighbours.op2_neighbours(spark, str(tmp_path)).collect():
        got_.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & got_[q])
    assert len(got_) == 120 and hits / 600 >= 0.9


def test_encoders_equal_the_library_on_every_plain_character(library):
    """Alone, in a word and between words: all that the fast path takes, and the characters around it."""
    import pyarrow as pa

    chars = [chr(i) for i in range(1, 0x300) if chr(i) not in "\0"] + ["ẞ", "ſ", "K", "Å", "ﬁ", "Σ", "ς", "日", "😀"]
    some = [t for c in chars for t in (c, f"a{c}x", f"{c} 'S{c}", f"x {c}{c}9")]
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    for kind in (tokens.ChunkEncoder, bpe.MergeEncoder):
        ids, n = tokens.encoder(tokens.default_tokenizer(), kind).encode(pa.array(some))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_encoder_that_forgets(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "CACHE", 5)
    enc = tokens.ChunkEncoder(tokens.default_tokenizer())
    for part in (["a few words here", "and a few", ""], ["a few more words", "here"], ["words a few"]):
        ids, n = enc.encode(pa.array(part))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_whole_groups():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(0).integers(0, 9, 60))
    batches = [pa.RecordBatch.from_pydict({"k": keys[a:b], "v": np.arange(a, b)}) for a, b in ((0, 1), (1, 1), (1, 20), (20, 23), (23, 60))]
    seen = []
    for (k, v), ends in simhash.whole_groups(batches, ["k", "v"], 1):
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            assert len(set(k[a:b])) == 1
            seen.append((int(k[a]), v[a:b].tolist()))
    assert seen == [(g, np.flatnonzero(keys == g).tolist()) for g in np.unique(keys).tolist()]


def test_parity_maps_bound_differences():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    for _ in range(50):
        a, b = (np.unique(rng.choice(pool, 150)) for _ in "ab")
        apart = int(np.bitwise_count((simhash.parity_map(a) ^ simhash.parity_map(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def shingles(t, words=5):
    w = t.split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def jaccard(s, t):
    x, y = shingles(s), shingles(t)
    return len(x & y) / len(x | y)


def bits_apart(s, t):
    a, b = (simhash.fingerprint(simhash.shingle_hashes(x, simhash.WORDS)) for x in (s, t))
    return (a ^ b).bit_count()


def brute_groups(texts):
    label = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if bits_apart(texts[i], texts[j]) <= simhash.MOST_BITS or jaccard(texts[i], texts[j]) >= 0.8]
    for _ in texts:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return label


def near_groups_of(spark, texts):
    out = simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    return [g for _, g in sorted((r["doc_id"], r["group"]) for r in out)]


def test_near_groups_far_fingerprints(spark):
    """Copies with one replaced passage, some of them more than 11 bits apart."""
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 5000, n))
    texts = []
    for _ in range(40):
        body = text(150)
        texts += [body + " " + text(15), body + " " + text(15)]
    alike = [(s, t) for s, t in zip(texts[::2], texts[1::2], strict=True) if jaccard(s, t) >= 0.8]
    assert len(alike) == 40 and sum(bits_apart(s, t) > 11 for s, t in alike) >= 3
    assert near_groups_of(spark, texts) == brute_groups(texts)


def test_near_groups_by_any_member(spark):
    """a2 has a1's group by its fingerprint; b1 is alike to a2, but not to a1."""
    rng = np.random.default_rng(9)
    text = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    while len(texts) < 15:
        a1 = text(200)
        a2 = a1[:]
        a2[197:] = text(3)
        b1 = text(21) + a2[21:]
        a1, a2, b1 = map(" ".join, (a1, a2, b1))
        if bits_apart(a1, a2) <= 3 and jaccard(a2, b1) >= 0.8 > jaccard(a1, b1) and min(bits_apart(a1, b1), bits_apart(a2, b1)) > 3:
            texts += [a1, a2, b1]
    assert brute_groups(texts) == [i // 3 * 3 for i in range(15)]
    assert near_groups_of(spark, texts) == brute_groups(texts)


def test_repeats_of_nul_bytes(spark):
    """The gram of NUL bytes has hash 0."""
    passage = " in both " + "\0" * 60 + " of them"
    texts = ["a first text:" + passage + "; its end", "second text," + passage + ". Another end"]
    out = suffix_dedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: texts[0], 1: texts[1].replace(passage, "")}
