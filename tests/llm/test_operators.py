"""Each operator against brute force or the library, over awkward rows: nulls, empty and long texts,
ties, repeated rows, extra columns with clashing names, and empty tables."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

from tidemill.llm import bpe, common, embedding_links, induced, language, lines, near_texts, packing, pieces, quality, range_coder, simhash, substrings, token_counts, token_ids

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, spans string"


def awkward():
    rng = np.random.default_rng(3)
    words = ["the", "of", "thst", "ereon", "In", "été", "ñl,", "a", "zz9", "bl-e"]
    text = lambda n: " ".join(rng.choice(words, n))
    base = text(80)
    shared = text(60)
    out = [None, "", " ", "\n\n", "a", "x y", "  two  spaces\t\n tabs ", "　日本語 テキスト é", "a<|endoftext|>b <s> ▁x", "ab" * 400, "x" * 1500, base, base, base + " extra", base.upper(),
           shared + "\n" + text(30), text(30) + "\n" + shared, text(30) + "\n" + shared, "I'm don't 'S\x1c x\x1c y", text(6000), "🙂" * 40]
    rows = [(i * 3, t, ["en", None, "de"][i % 3], "s", 0, "g", "s") for i, t in enumerate(out)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def null_id(spark):
    return spark.createDataFrame([(None, "a b c d e f", None, None, None, None, None), (None, None, None, None, None, None, None), (1, "a b c d e f", None, None, None, None, None), (1, "a b c d e f", None, None, None, None, None)], SCHEMA)


def texts():
    return {r[0]: r[1] or "" for r in awkward()}


BYTE, WORD, PIECE = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
RUNS = {
    "op1": substrings.summary, "op2": lambda d: packing.pack(d, WORD), "op3": quality.measures, "op4": lambda d: token_ids.round_trip(d, BYTE), "op6": lines.summary,
    "op7": lambda d: token_counts.count_tokens(d, BYTE), "op8": language.identify, "op9": simhash.near_duplicates, "op10": lambda d: pieces.digests(d, PIECE),
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table_and_odd_ids(empty, null_id, name):
    assert RUNS[name](empty).count() == 0
    assert RUNS[name](null_id).count() == 4


def brute_substrings(rows):
    seen, out = set(), {}
    for d, t in sorted(rows.items()):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_substrings(docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.summary(docs).collect()}
    assert got == brute_substrings(texts())
    kept = {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()}
    assert kept[0] is None and "�" not in "".join(t for t in kept.values() if t)


def test_substrings_periodic_and_overlapping(spark):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh "), 300))
    rows = {i: "x" * int(rng.integers(0, 300)) + passage[int(rng.integers(0, 60)):int(rng.integers(150, 300))] + "".join(rng.choice(list("ab"), 150)) for i in range(50)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.summary(df).collect()} == brute_substrings(rows)


def test_induced_order_and_prefixes_with_queues_on_disk():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n, symbols, most = int(rng.integers(1, 60)), int(rng.choice([2, 3, 5, 40, 3000])), int(rng.choice([3, 10, 2**31 - 2]))
        a = rng.integers(0, symbols, n)
        a = np.tile(a[:max(1, n // 7)], 7) if rng.random() < 0.3 else np.repeat(a, rng.integers(1, 6, n)) if rng.random() < 0.3 else a
        text = a.tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        order, shared = induced.suffix_order(a.astype(np.int32), symbols, memory=int(rng.integers(1, 50)), most=most, names=int(rng.choice([0, 10, 100])))
        both = [sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(text[i:], text[j:]))) for i, j in zip(want, want[1:])]
        assert order.tolist() == want and shared.tolist() == [0, *(min(x, most) for x in both)]


def number_copies(rows):
    """doc_id -> texts, of rows that may repeat an id."""
    out = defaultdict(list)
    for d, t in rows:
        out[d].append(t or "")
    return out


def test_rows_that_repeat_an_id_are_different_documents(spark):
    rng = np.random.default_rng(9)
    passage, line = "".join(rng.choice(list("abcdefgh "), 400)), "one two three four five six"
    rows = [(1, passage), (1, passage), (1, passage + "x"), (0, "short"), (2, passage), (3, line), (3, line), (3, "other line of six words here"), (4, line + "\n" + line)] + [(5, "left alone " + str(k) * 40) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    kept = sorted((r.doc_id, r.n_removed) for r in substrings.summary(df).collect())
    ones = sorted(n for d, n in kept if d == 1)
    assert ones in ([0, 400, 400], [0, 400, 401]) and (2, 400) in kept and [n for d, n in kept if d == 5] == [0, 0, 0]
    gone = sorted((r.doc_id, r.n_removed) for r in lines.summary(df.filter("doc_id in (3, 4)")).collect())
    assert gone == [(3, 0), (3, 0), (3, 1), (4, 2)]
    left = sorted((r.doc_id, r.text) for r in lines.without_repeats(df.filter("doc_id in (3, 4)")).collect())
    assert left == [(3, ""), (3, line), (3, "other line of six words here"), (4, "")]
    import corpus_pipeline

    stay = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect())
    assert stay == [0, 1, 3, 3, 4, 5, 5, 5]


def test_long_texts_are_worked_on_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(10)
    words = ["w%d" % i for i in range(400)]
    passage = " ".join(rng.choice(words, 60))
    long = " ".join(rng.choice(words, 700_000))  # over 2 MB: several slices, hundreds of blocks
    rows = {1: passage, 2: long[:1_500_000] + " " + passage + " " + long[1_500_000:], 3: "\n".join([passage, "z" * 5000, long[:3000]]), 4: "x" * 1_200_000}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.summary(df).collect()}
    assert got == brute_substrings(rows)
    tk, at = Tokenizer.from_file(BYTE), 0
    ids = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_ids.round_trip(df.filter("doc_id < 4"), BYTE).collect()}
    for d in (1, 2, 3):
        want = tk.encode(rows[d], add_special_tokens=False).ids + [2]
        assert ids[d] == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_crowded_anchors_and_frequent_tokens(spark, monkeypatch):
    """The ways for crowded keys give the same rows: limits are lowered in this process, where the functions run without Spark."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    monkeypatch.setattr(substrings, "HOT_BYTES", 500)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 1000)
    shared = "".join(rng.choice(list("abcdefgh"), 60))
    rows = [(i, 0, "".join(rng.choice(list("xyz "), int(rng.integers(20, 90)))) + shared + "".join(rng.choice(list("xyz "), 90))) for i in range(30)]
    rows += [(30 + i, 0, rows[i][2][:200]) for i in range(6)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "copy", "text"), r)) for r in rows])
    index = pa.Table.from_batches(list(substrings.index_batches([batch]))).sort_by([(c, "ascending") for c in ("anchor", "segment", "doc_id", "copy", "start")])
    met = pa.Table.from_batches(list(substrings.meet_batches(index.to_batches(max_chunksize=7)))).to_pylist()
    assert any(r["hot"] for r in met)
    found, asked = defaultdict(list), defaultdict(list)
    for r in met:
        (asked if r["look"] else found)[r["doc_id"]].append(r)
    kind = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("text", pa.string()), ("asked", pa.list_(pa.struct([("anchor", pa.int64()), ("hot", pa.bool_()), ("first", pa.int64()), ("end", pa.int64())])))])
    data = pa.RecordBatch.from_pylist([{"doc_id": d, "copy": c, "text": t, "asked": [{k: r[k] for k in ("anchor", "hot", "first", "end")} for r in asked[d]]} for d, c, t in rows if d in asked], kind)
    for b in substrings.sort_batches(pa.Table.from_batches(list(substrings.byte_batches([data]))).sort_by("anchor").to_batches(max_chunksize=9)):
        for r in b.to_pylist():
            found[r["doc_id"]].append(r)
    want = brute_substrings({d: t for d, _, t in rows})
    assert {d: substrings.cut(t.encode(), found[d])[1:] for d, _, t in rows} == {d: w[1:3] for d, w in want.items()}
    # lines of which every token is frequent meet at pairs
    texts = {d: " ".join(rng.choice(["the", "of", "and", "to", "in", "is", "was", "a", "b", "c", "d", "e", "f", "g", "h"], int(rng.integers(1, 26)))) for d in range(500)}
    often = bytes([40]) * (1 << lines.WORD_BITS)
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "copy": 0, "text": t} for d, t in texts.items()])
    packed = pa.Table.from_batches(list(lines.index_batches([batch], often, 8))).sort_by("bucket")
    met = pa.Table.from_batches(list(lines.meet_batches(packed.to_batches())))
    gone = {r["doc_id"] for r in met.to_pylist() if not r["verify"]}
    asked = defaultdict(list)
    for r in met.to_pylist():
        if r["verify"]:
            asked[r["doc_id"]].append(r)
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "copy": 0, "text": texts[d], "asked": a} for d, a in asked.items()])
    wanted = pa.Table.from_batches(list(lines.list_batches([batch], often)))
    for b in lines.verify_batches(wanted.sort_by([(c, "ascending") for c in ("token", "doc_id", "copy", "line")]).to_batches(max_chunksize=11)):
        gone |= set(b.column("doc_id").to_pylist())
    assert gone == set(k for k, v in brute_lines(texts).items() if v)


def test_packing(docs):
    tk, rows = Tokenizer.from_file(WORD), packing.pack(docs, WORD).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, t in texts().items():
        ids = tk.encode(t, add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_column_generation_is_near_the_bound():
    demand = np.bincount(np.random.default_rng(1).integers(1, 257, 20000), minlength=257)[1:]
    used = sum(x for _, x in packing.solve(demand, 256))
    assert used <= 1.01 * max((demand * np.arange(1, 257)).sum() / 256, demand[128:].sum())
    rows = packing.assign({i + 1: int(n) for i, n in enumerate(demand) if n}, 256, 1)
    placed = Counter()
    for c, a, b, *_ in rows:
        placed[c] += b - a
    assert all(placed[i + 1] == n for i, n in enumerate(demand))


def test_quality(docs):
    for r in quality.measures(docs).collect():
        t = texts()[r.doc_id]
        words = [w.decode() for w in t.encode().split()]
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
        split = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(split) - len(set(split)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(words) < 50 or 2 * len(covered) > len(words)) and not (r.kept and r.base_failed)
    rng = np.random.default_rng(0)
    import base64

    assert not quality.Bands().measure(base64.b64encode(rng.bytes(30000)))[0] and not quality.Bands().measure(b"buy now " * 3000)[0]
    assert set(quality.keep(docs).columns) == set(docs.columns)


def test_token_ids(docs):
    tk, at = Tokenizer.from_file(BYTE), 0
    got = {r.doc_id: r for r in token_ids.round_trip(docs, BYTE).collect()}
    for d, t in sorted(texts().items()):
        ids = tk.encode(t, add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_range_coder():
    rng = np.random.default_rng(0)
    blocks = [([1, None], [rng.integers(0, 50000, 50).astype("u4"), np.array([], "u4")], False), ([5], [rng.integers(0, 2**32, 30).astype("u4")], True), ([], [], False), ([7], [np.zeros(5000, "u4")], False)]
    data = range_coder.pack_blocks(blocks)
    for (d, a, f), (e, b, g) in zip(blocks, range_coder.unpack_blocks(data)):
        assert d == e and f == g and all((x == y).all() for x, y in zip(a, b))
    assert len(data[3]) < 200
    with pytest.raises(ValueError):
        range_coder.unpack_blocks([data[0][:-1] + bytes([data[0][-1] ^ 1])])


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 32))
    rows = [(i, [float(v) for v in (base[i % 60] + rng.normal(size=32) * rng.choice([0.0, 0.1, 0.3]))], int(rng.integers(0, 2)) if i % 17 else None, "x") for i in range(300)]
    rows += [(300, None, 1, "x"), (301, [0.0] * 32, 1, "x"), (302, [float("nan")] + [1.0] * 31, 1, "x"), (303, [], 1, "x"), (304, [None] + [1.0] * 31, 1, "x"), (None, [1.0] * 32, 1, "x"), (305, [1.0, 2.0], 1, "x"), (306, [1.0, 2.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, first string").repartition(3)
    got = {r.vec_id: r for r in embedding_links.near_duplicates(df).collect()}
    ok = [(i, np.array(e), lab) for i, e, lab, _ in rows if i is not None and e and lab is not None and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    links = defaultdict(set)
    for (i, a, p), (j, b, q) in itertools.combinations(ok, 2):
        if p == q and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
            links[i].add(j)
            links[j].add(i)
    found = sum(got[i].n_links for i in links)
    assert found >= 0.99 * sum(map(len, links.values())) and all(got[i].n_links <= len(links[i]) for i in got if i is not None)
    assert all(got[i].n_links == 0 and got[i].kept for i in (300, 301, 302, 303, 304)) and got[306].component_id == 305
    assert embedding_links.near_duplicates(df.limit(0)).count() == 0


def brute_lines(rows):
    sets, gone = [], defaultdict(set)
    for d, t in sorted(rows.items()):
        for k, line in enumerate(t.split("\n")):
            w = line.encode().split()
            if len(w) < lines.MIN_WORDS:
                continue
            s = frozenset(w)
            if any(9 * len(s & x) >= 4 * (len(s) + len(x)) for x in sets):
                gone[d].add(k)
            sets.append(s)
    return gone


@pytest.mark.parametrize("source", ["awkward", "table"])
def test_lines(spark, docs, source):
    df = docs if source == "awkward" else common.table(spark, SF, "documents")
    rows = texts() if source == "awkward" else {r.doc_id: r.text for r in df.collect()}
    gone = brute_lines(rows)
    for r in lines.summary(df).collect():
        parts = rows[r.doc_id].split("\n")
        left = "\n".join(x for i, x in enumerate(parts) if i not in gone[r.doc_id])
        assert (r.n_lines, r.n_removed, r.kept_sha256) == (len(parts), len(gone[r.doc_id]), hashlib.sha256(left.encode()).hexdigest())
    assert set(lines.without_repeats(df).columns) == set(df.columns)


def test_token_counts(docs):
    tk = Tokenizer.from_file(BYTE)
    for r in token_counts.count_tokens(docs, BYTE).collect():
        t = texts()[r.doc_id]
        n = len(tk.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)


def test_whole_tokens_are_proved():
    v = bpe.ByteVocabulary(BYTE)
    tk = Tokenizer.from_file(BYTE)
    for s in list(token_counts.whole_tokens(v, token_counts.proof(BYTE)))[::997]:
        try:
            text = s.decode()
        except UnicodeDecodeError:
            continue
        if token_counts.counter(BYTE).pattern.findall(text) == [text]:
            assert len(tk.encode(text).ids) == 1


def test_language(spark):
    df = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(df).toPandas().merge(df.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(d).encode()) % 4 == 2) == h for d, h in zip(got.doc_id, got.held_out))


def test_language_of_every_row_by_the_fitted_machines(spark):
    """Brute force: the machines applied one by one to the trigrams of each text; rare and repeated languages are learned too."""
    df = common.table(spark, SF, "documents").select("doc_id", "text", "lang")
    extra = [(10_000 + i, "zz yy xx ww " * 30 + str(i % 3), "qq") for i in range(400)] + [(20_000, "ооо ппп рррр " * 20, "uk")] * 5
    df = df.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string")).repartition(3)
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 4 == 2
    model = language.learn(df.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"), 200)
    assert {c for codes, *_ in model["inside"].values() for c in codes} >= {"en", "qq"}
    rows = {r.doc_id: r for r in language.identify(df, 200).collect()}
    for d, text, _ in {(r.doc_id, r.text, None) for r in df.collect()}:
        x = np.append(language.features(text or ""), np.float32(1))
        if not any(c.isalpha() for c in text or ""):
            assert rows[d].lang_pred == "und"
            continue
        family = model["families"][int(np.argmax([w @ x for w in model["first"]]))]
        codes, pairs, machines = model["inside"][family]
        votes, soft = np.zeros(len(codes)), np.zeros(len(codes))
        for (i, j), w in zip(pairs, machines):
            p = float(language.sure(w @ x))
            votes[i if p >= 0.5 else j] += 1
            soft[i] += p
            soft[j] += 1 - p
        want = codes[int(np.argmax(votes + soft / (len(codes) + 1)))] if pairs else codes[0]
        assert rows[d].lang_pred == want and rows[d].held_out == held(d)


def test_quality_verdict_by_brute_force(spark):
    """kept is false exactly if the base rules or the bands reject: ratios from the library, one text at a time."""
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=3)

    def inside(data):
        ratio = len(data) / len(zip_.compress(data))
        low, high = next((a, b) for n, a, b in quality.BANDS if len(data) < n)
        return low <= ratio <= high

    for r in quality.measures(common.table(spark, "/root/testdata/sf0.01", "documents")).join(common.table(spark, "/root/testdata/sf0.01", "documents"), "doc_id").select("doc_id", "text", "base_failed", "kept").collect():
        data = (r.text or "").encode()
        cuts = list(range(0, len(data), quality.CHUNK))
        if len(cuts) > 1 and len(data) - cuts[-1] < quality.CHUNK // 2:
            cuts.pop()
        parts = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]
        bad = sum(not inside(p) for p in parts) if len(parts) > 1 else 0
        assert r.kept == (not r.base_failed and inside(data) and bad <= 0.25 * len(parts))


def test_language_of_awkward_texts(docs):
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d, t in texts().items() if not any(c.isalpha() for c in t))
    assert {r.lang_pred for r in got.values()} <= {"en", "de", "und"}


def brute_fingerprint(t):
    w = t.encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    want = {d: brute_fingerprint(t) for d, t in texts().items()}
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == want
    assert [r.h for r in spark.sql("SELECT xxhash64('the of thst') AS h").collect()] == [int(np.uint64(xxhash.xxh64_intdigest("the of thst", 42)).view(np.int64))]


def test_simhash_components_end_to_end(spark):
    for df in (common.table(spark, SF, "documents"), common.table(spark, SF, "documents").limit(0)):
        rows = {r.doc_id: r.text or "" for r in df.collect()}
        fp = {d: brute_fingerprint(t) for d, t in rows.items()}
        ids = sorted(fp)
        values = np.array([fp[d] for d in ids], np.uint64)
        label = np.arange(len(ids))
        if len(ids):
            label = simhash.merge_labels(label, *np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2))
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
        assert got == {d: (f"{fp[d]:016x}", ids[label[i]]) for i, d in enumerate(ids)}


def test_bk_tree_and_shards(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    near = [b ^ np.uint64((1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))) for b in base for _ in range(6)]
    fp = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    pairs = {(int(q), int(m)) for a, b in simhash.BKTree(fp).search(fp, 2) for q, m in zip(a, b)}
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 2))}
    label = np.arange(len(fp))
    label = simhash.merge_labels(label, *np.nonzero(d <= 2))
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(fp.view(np.int64))], "fp long, first_doc long")
    df = common.written(df, "distinct")
    for shard in (20_000, 3):  # whole shards, and shards split into several trees
        parts = {r.node: r.component for r in common.connected_components(simhash.links(df, 2, shard)).collect()}
        assert [parts.get(i, i) for i in range(len(fp))] == label.tolist()


def test_pieces(docs):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECE)
    for r in pieces.digests(docs, PIECE).collect():
        ids = sp.encode(texts()[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, PIECE), PIECE).collect()}
    assert back == {d: sp.decode(sp.encode(t)) for d, t in texts().items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 400)] + [(500, 500), (None, 3)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 400)) and 500 not in got
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    df = common.table(spark, SF, "documents")
    n = df.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, df, SF), "stage")
        assert out.columns == df.columns and 0 < out.count() <= n, name
        df, n = out, out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() >= n


def test_near_dedup_stage_removes_every_near_copy(spark):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    names = ["w%d" % i for i in range(3000)]
    rows = {}
    for base in range(40):
        words = list(rng.choice(names, int(rng.integers(5, 400))))
        for _ in range(4):
            own = list(words)
            for at in rng.integers(0, len(own), int(rng.integers(0, 1 + len(own) // 30))):
                own[at] = str(rng.choice(names))
            rows[len(rows)] = " ".join(own)
    rows |= {1000: "a b c", 1001: "A  b\nc", 1002: "a b d", 1003: rows[0].upper(), 1004: "", 1005: None}
    sets = {}
    for d, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    home = {d: d for d in rows}

    def root(d):
        while home[d] != d:
            d = home[d]
        return d

    n = 0
    for d, e in itertools.combinations(rows, 2):
        if 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]):
            n += sets[d] != sets[e]
            a, b = sorted((root(d), root(e)))
            home[b] = a
    assert n > 20
    df = spark.createDataFrame([*rows.items(), (None, rows[0])], "doc_id long, text string").repartition(5)
    left = [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()]
    assert sorted(d for d in left if d is not None) == [d for d in rows if root(d) == d] and left.count(None) == 1


def test_random_words_are_rejected_in_every_band(spark):
    import base64

    rng, bands, low = np.random.default_rng(8), quality.Bands(), 50
    for high, least, _ in quality.BANDS:
        for short, long in ((1, 2), (2, 3), (3, 5), (6, 10)):
            if (short == 1) != (high <= 200):
                continue
            for _ in range(40):
                n = int(rng.integers(low, min(high, 60000)))
                pool = base64.b64encode(rng.bytes(n)).decode()
                cuts = np.cumsum(rng.integers(short, long + 1, n))
                text = " ".join(pool[a:b] for a, b in zip(cuts, cuts[1:]))[:n].encode()
                ok, ratio, *_ = bands.measure(text)
                assert not ok and ratio < least, (high, short, ratio)
        low = high
    rows = [r.text for r in common.table(spark, SF, "documents").collect() if r.text and len(r.text.encode().split()) >= 50]
    limit = lambda n: next(least for high, least, _ in quality.BANDS if n < high)
    assert len(rows) > 50 and all(quality.measure(t, bands)[7] >= limit(len(t.encode())) for t in rows)


def test_short_lines_are_deduplicated(spark):
    rows = [(1, "All rights reserved.\na b\n\nx\n日本語の長い行です。"), (2, "reserved. rights All\na c\n\nx\n日本語の長い行です。"), (3, "a b c d\n \na b c\na b"), (None, "x")]
    got = {r.doc_id: r.text for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {1: rows[0][1], 2: "a c\n", 3: "a b c d\n \na b c", None: "x"}


@pytest.mark.parametrize("rows", [10_000, 1_000_000, 100_000_000])
def test_cap_filters_keep_their_recall_as_the_code_grows(rows):
    rng = np.random.default_rng(7)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 300, 64)))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    code = embedding_links.plan(rows)
    shared = [len(np.intersect1d(a, b)) > 0 for a, b in zip(embedding_links.decode(x, *code), embedding_links.decode(y, *code))]
    assert np.mean(shared) >= 0.99


def test_components_that_have_not_settled_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        common.connected_components(path, max_rounds=1)


def test_near_dedup_joins_copies_in_bk_trees_and_verifies_them(spark, monkeypatch):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    names = ["w%d" % i for i in range(5000)]
    words = [list(rng.choice(names, 3000)) for _ in range(3)]
    rows = {}
    for i in range(40):  # one word of 3000 differs: the simhashes differ by few bits
        rows[i] = " ".join([*words[i % 2][:50 + i], "own%d" % i, *words[i % 2][51 + i:]])
    for i in range(40, 60):  # equal simhashes by a run of one word, different texts all the same
        rows[i] = "spam " * 4000 + " ".join(rng.choice(names, 40))
    rows |= {100: " ".join(words[2]), 101: " ".join(words[2][:2600])}  # too far apart for the trees
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    searched, asked = [], []
    link, ask = simhash.links, near_texts.asked_lists
    monkeypatch.setattr(simhash, "links", lambda first, *a: searched.append(first.count()) or link(first, *a))
    monkeypatch.setattr(near_texts, "asked_lists", lambda docs, met, *a: asked.extend(r.doc_id for r in met.select("doc_id").distinct().collect()) or ask(docs, met, *a))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()) == [0, 1, *range(40, 60), 100]
    assert len(searched) == 1 and searched[0] <= len(rows)
    assert {100, 101} <= set(asked)
    docs = common.numbered(df)
    marks = common.written(common.arrow_map(docs, "tidemill.llm.near_texts:set_batches", "doc_id long, copy long, h1 long, h2 long, fp long", shingle=5).select("doc_id", "copy", "fp"), "marks")
    fp = {r.doc_id: r.fp for r in marks.collect()}
    assert fp == {d: int(np.uint64(simhash.fingerprint(t, 5)).view(np.int64)) for d, t in rows.items()}
    rank = lines.rarity(docs, 5)
    for leaders in (1, 32):
        got = near_texts.tree_links(docs, marks, rank, leaders=leaders).collect()
        assert all(r.b1 == r.a1 % 2 and r.a1 < 40 for r in got) and len(got) == len({r.a1 for r in got}) > 20
    # texts that the trees have joined aren't verified against each other again, but against others they are
    joined = common.written(spark.createDataFrame([(2, 0, 1, 0), (3, 0, 1, 0)], "a1 long, a2 long, b1 long, b2 long"), "joined")
    met = common.written(spark.createDataFrame([(True, d, 0, 0, t, t) for t, ds in ((7, (1, 2, 3)), (8, (2, 3, 4)), (9, (5, 6))) for d in ds], lines.MET), "met")
    assert sorted((r.token, r.doc_id) for r in near_texts.unsettled(met, joined).collect()) == [(8, 2), (8, 3), (8, 4), (9, 5), (9, 6)]


def test_token_blocks_of_any_alphabet_are_coded_in_step():
    """Blocks of two to four digits an id, coded and read together, and a range that runs low many times over."""
    rng = np.random.default_rng(13)
    kinds = [rng.integers(0, k, 3000) * 7 for k in (1, 20, 900, 1100, 4000)] + [np.arange(5000) * 60_000, np.repeat(np.arange(2**32 - 3000, 2**32), 2)]
    blocks = [([i], [ids.astype("u4")], False) for i, ids in enumerate(kinds)]
    assert {range_coder.shape_of(len(np.unique(ids))) for ids in kinds} == {(32, 2), (16, 3), (16, 4)}
    data = range_coder.pack_blocks(blocks)
    for some in (data, data[3:], data[:1]):  # a block is read with any others, or alone
        for back, (docs, ids, _) in zip(range_coder.unpack_blocks(some), blocks[len(data) - len(some):] if len(some) > 1 else blocks):
            assert back[0] == docs and (back[1][0] == ids[0]).all()
    # a text whose words come again: fewer bits than its entropy without context, and less than an eighth of its ids as they are
    text = np.tile(rng.integers(0, 50_000, 300), 14)[:4096].astype("u4")
    assert len(range_coder.pack_blocks([([0], [text], False)])[0]) < 4096 / 2


def test_blocks_are_decoded_as_many_at_a_time_as_go_in_step():
    import pyarrow as pa

    n = 2 * token_ids.LANES + 5
    batch = pa.RecordBatch.from_pydict({"at": list(range(n))})
    got = [b.column("at").to_pylist() for b in token_ids.full_batches(batch.slice(a, 700) for a in range(0, n, 700))]
    assert [len(g) for g in got] == [token_ids.LANES, token_ids.LANES, 5] and sum(got, []) == list(range(n))


def test_words_with_the_same_pre_tokens_share_their_merges():
    """Marks and cases around a word don't have it merged again (op2: CPU seconds)."""
    e, seen = packing.WordEncoder(WORD), []
    e.vocabulary.encode = lambda words, f=e.vocabulary.encode: seen.extend(words) or f(words)
    words = ["ondrel", "ondrel,", "Ondrel", "ONDREL!", "ondrel's", "Éndrel", "éndrel.", "éndrel###", "<|endoftext|>", "ﬁn", "J̌a"]
    made = [*e.texts([" ".join(words)]), *e.texts(["ondrel; " + words[-1]])]
    assert seen.count(b"ondrel") == 1 and seen.count("éndrel".encode()) == 1 and len(seen) == len(set(seen))
    tk = Tokenizer.from_file(WORD)
    assert [np.frombuffer(m, "<u4").tolist() for m in made] == [tk.encode(t, add_special_tokens=False).ids for t in (" ".join(words), "ondrel; " + words[-1])]


def test_pairs_are_found_by_hash():
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)): (r, 5000 + r % 300) for r, (a, b) in enumerate(rng.permutation(200 * 200)[:9000, None] // [200, 1] % 200)}
    m = bpe.Merges(pairs, 6000)
    left, right = (x.ravel() for x in np.mgrid[-3:203, -3:203])
    want = [(r << bpe.MADE | made) if (r, made) != (None, None) else bpe.NONE for r, made in (pairs.get(p, (None, None)) for p in zip(left.tolist(), right.tolist()))]
    assert m.find(left, right).tolist() == want


def test_pre_tokens_are_merged_once_for_token_ids():
    """As for packing, with white space and marks in every place (op4: CPU seconds)."""
    e, seen = token_ids.IdEncoder(BYTE), []
    v = e.counter.vocabulary
    texts = ["ondrel ondrel, ondrel. ondrel's", "", " ondrel", "ondrel ", "a  ondrel", "a\nondrel\tondrel b", "\n", "<|endoftext|> ondrel!", ", . ondrel;;", "a　ondrel 　b", "x y"]
    v.encode = lambda words, f=v.encode: seen.extend(words) or f(words)
    try:
        made = [x for t in texts for x in e.texts([t])]
    finally:
        del v.encode
    assert seen.count(b" ondrel") == 1 and len(seen) == len(set(seen))
    tk = Tokenizer.from_file(BYTE)
    assert [np.frombuffer(m, "<u4").tolist() for m in made] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_of_summed_counts_are_halved_in_time():
    """Rows hold sums in 16 bits: long blocks of few ids neither overflow nor stay with what came first."""
    rng = np.random.default_rng(17)
    streams = [np.zeros(30_000, np.int64), np.repeat([0, 31], 8000), rng.integers(0, 32, 20_000)]
    data = range_coder.encode_lanes(streams, (32, 2))
    assert all((a == b).all() for a, b in zip(streams, range_coder.decode_lanes(data, [len(s) for s in streams], (32, 2))))
    m = range_coder.Models(1, (32, 2))
    coder = range_coder.Range(1)
    for _ in range(500):
        m.step(1, np.zeros(1, np.int64), coder, lambda: coder.span.fill(2**63))
    assert 0 < m.upto[:, -1].max() <= range_coder.FULL + range_coder.STEP and (np.diff(m.upto.astype(int), axis=1) >= 0).all()
