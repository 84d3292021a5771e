"""Exact duplicates, WARC archives, nearest vectors and packing against brute force."""

import base64
import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayframe.llm import exact_dedup, nearest, packing, warc
from wayframe.llm.registry import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).repartition(parts)


def brute_groups(rows):
    out = []
    by = {}
    for d, t in rows:
        by.setdefault(t or "", []).append(d)
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for d in sorted(ids, key=lambda x: (x is not None, x or 0), reverse=True):
            out.append((d, keep, len(ids), d == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


EXACT = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "x" * 200_000), (6, "x" * 200_000), (7, "x" * 199_999 + "y"), (8, "A b"), (9, "a b "),
         (9, "a b "), (None, "a b"), (None, "only"), *[(100 + i, "copy") for i in range(300)]]


@pytest.mark.parametrize("bits", [62, 2])
def test_exact_groups(spark, bits):
    got = exact_dedup.exact_groups(docs_of(spark, EXACT), bits=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups(EXACT)


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(docs_of(spark, []).limit(0)).collect() == []


def test_exact_dedup_keeps_columns(spark):
    df = docs_of(spark, EXACT).withColumn("text_digest", F.lit(1)).withColumn("print", F.lit("p"))
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    want = sorted(((d, t) for d, _, _, k, s in brute_groups(EXACT) if k for t in [s]), key=str)
    got = sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()), key=str)
    assert got == want


def test_any_cutting_gives_one_fingerprint():
    raw = np.frombuffer(bytes(range(256)) * 50, np.uint8)
    tables = exact_dedup.powers(1000)
    whole = exact_dedup.fingerprint(raw, tables)
    for cuts in ([0, 1, 999, 12800], [0, 500, 777, 1700, 2600, 12800]):
        parts = (0, 0)
        for a, b in zip(cuts, cuts[1:]):
            piece = (0, 0)
            for lo in range(a, b, 1000):
                seg = raw[lo : min(b, lo + 1000)]
                piece = exact_dedup.combine(piece, exact_dedup.chunk_hash(seg, tables), len(seg))
            parts = exact_dedup.combine(parts, piece, b - a)
        assert (parts[0] << 31 | parts[1]) == whole


def test_pieces_in_any_task_give_the_fingerprint_of_the_text(spark):
    texts = {1: "aé" * 90_000, 2: "", 3: "short", 4: None}
    rows = []
    for d, t in texts.items():
        for k in range(7):
            size = len(t or "") // 7 + 1
            rows.append((d, 10 * k, None if t is None else t[k * size : (k + 1) * size]))
    got = exact_dedup.piece_fingerprints(spark.createDataFrame(rows, "id long, seq int, text string").repartition(9))
    tables = exact_dedup.powers()
    want = {d: (exact_dedup.fingerprint(np.frombuffer((t or "").encode(), np.uint8), tables), len((t or "").encode())) for d, t in texts.items()}
    assert {r.id: (r.print, r.size) for r in got.collect()} == want


PAGES = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://b/\r\nX: y", "other é\u0001"), (4, "u", None), (5, "u", ""), (6, "v", "z" * 100_000),
         (6, "v", "z" * 100_000), (None, "w", "same"), (9, "big", None)]


def pages_of(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def brute_pages(rows):
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    out, done = [], set()
    for p, _, h in rows:
        data = (h or "").encode()
        first = p == best[h or ""] and (p, h or "") not in done
        done.add((p, h or ""))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((p, len(data), digest, "response" if first else "revisit", None if first else best[h or ""]))
    return sorted(out, key=str)


def test_archives_come_back(spark):
    got = warc.archived_pages(pages_of(spark), roll_bytes=300, range_rows=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_pages(PAGES)


def test_archives_are_plain_gzip_and_the_same_each_time(spark, tmp_path):
    files = []
    for name, parts in (("one", 1), ("two", 5)):
        paths = warc.write_archives(pages_of(spark).repartition(parts), str(tmp_path / name), 300, 2)
        files.append([(p.rsplit("/", 1)[1], open(p, "rb").read()) for p in paths])
    assert files[0] == files[1] and len(files[0]) > 1
    plain = b"".join(gzip.decompress(data) for _, data in files[0])
    assert plain.count(b"WARC/1.1\r\n") == len(PAGES) and plain.endswith(b"\r\n\r\n")
    assert not [p for p in tmp_path.iterdir() if "writing" in p.name]
    with pytest.raises(RuntimeError):
        warc.write_archives(pages_of(spark), str(tmp_path / "one"))


def test_large_records_take_several_members():
    data = warc.record(1, "u", b"q" * (40 << 20), None, False, 0)
    found = warc.members(data)
    assert len(found) == 3 and all(m[-1] == 0 for m in found)
    (head, block), = warc.read_records(b"".join(found))
    assert len(block) > 40 << 20 and head["WARC-Type"] == "response"


def test_a_record_of_100_mb_is_read_back_in_one_pass():
    import time

    payload = bytes(range(33, 120)) * (100 * 1024 * 1024 // 87)
    data = b"".join(warc.members(warc.record(1, "u", payload, None, False, 0) + warc.record(2, "v", b"small", None, False, 0)))
    start = time.process_time()
    (first, block), (second, _) = warc.read_records(data)
    assert time.process_time() - start < 10
    assert block.endswith(payload) and len(block) == int(first["Content-Length"]) and second["X-Page"] == "2"
    with pytest.raises(ValueError):
        list(warc.read_records(data[: len(data) // 2]))


def test_broken_archives_are_refused(spark):
    data = b"".join(warc.members(warc.record(1, "u", b"payload", None, False, 0).replace(b"payload", b"pAyload")))
    with pytest.raises(ValueError):
        list(warc.read_records(data))


def test_no_pages(spark):
    assert warc.archived_pages(pages_of(spark).limit(0)).collect() == []


def brute_nearest(rows, k, every=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q, x in good:
        if q % every:
            continue
        found = sorted((nearest.distances(x[None], y[None])[0], i) for i, y in good if i != q and len(y) == len(x))[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("limits", [(4096, 512), (7, 3)])
def test_nearest_is_exact(spark, monkeypatch, limits):
    monkeypatch.setattr(nearest, "ROW_BLOCK", limits[0])
    monkeypatch.setattr(nearest, "QUERY_BLOCK", limits[1])
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(60)]
    rows += [(60 + i, rows[0][1]) for i in range(15)]  # ties
    rows += [(100, None), (105, [0.0] * 8), (110, [None] + [1.0] * 7), (115, [float("nan")] * 8), (120, [1e30] * 8), (125, [1.0, 2.0]), (126, [1.0, 2.5]), (None, [1.0] * 8), (130, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).withColumn("dim", F.lit(1)).withColumn("block", F.lit("x"))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = nearest.nearest(df, df.where("vec_id % 5 = 0"), 4)
    assert sorted(tuple(r) for r in got.collect()) == brute_nearest(rows, 4)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(df, df).collect() == []


TEXTS = [None, "", "One two. Three!", "  \t\n x\ty's İΣ it's 12 <|endoftext|> é́ ", "word " * 3000, "### @@ ... !!!\u0085x\u001cy", "Don't stop. " * 400, "ﬁ ́combining é", "plain", "plain", "one <|endoftext|> two", "a<|startoftext|>b",
         "<|endoftext|><|endoftext|>", "<|endo<|endoftext|>text|>\n<|ENDOFTEXT|> ΑΣ<|endoftext|>́x", "ΑΣ " * 20 + "<|startoftext|>"]


def test_ids_are_those_of_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    assert untouched.encode("one <|endoftext|> two", add_special_tokens=False).ids == [637, 49407, 1237]
    words = packing.WordIds(tokenizer_file("word_bpe_49k.json"))
    for turn in range(3):
        if turn == 2:
            monkeypatch.setattr(packing, "REMEMBERED_CHARS", 10)
        ids, sizes = words.encode([t or "" for t in TEXTS])
        want = [e.ids + [1] for e in untouched.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        if turn == 0:
            words.forget()


def test_ids_of_a_text_without_spaces():
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    text = "日本語é" * 300_000 + "x" * 200_000
    ids, sizes = packing.WordIds(tokenizer_file("word_bpe_49k.json")).encode([text])
    assert ids.tolist() == [*untouched.encode(text, add_special_tokens=False).ids, 1] and sizes.tolist() == [len(ids)]


def check_pieces(rows, texts, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    return padding / total


def test_packing_of_odd_texts(spark):
    texts = dict(enumerate(TEXTS))
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, length int").coalesce(1)
    check_pieces(packing.packed(df, tokenizer_file("word_bpe_49k.json"), 64).collect(), texts, 64)


def test_packing_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = packing.packed(df, tokenizer_file("word_bpe_49k.json")).collect()
    assert check_pieces(rows, texts, 2048) < 0.01


def test_nothing_to_pack(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(df, tokenizer_file("word_bpe_49k.json")).collect() == []


def brute_cost(places, penalty, length, capacity, costs):
    """Cheapest cost over all ways to cut at any place; cuts inside a sentence may fall anywhere."""
    extra = dict(zip(places, penalty))
    best = [0.0] + [None] * length
    for j in range(1, length + 1):
        best[j] = min(best[i] + (0 if (j - i) & (j - i - 1) == 0 else capacity - (j - i)) for i in range(max(0, j - capacity), j)) + extra.get(j, costs.inside) + costs.sequence
    return best[length]


def test_cuts_are_near_the_best():
    rng = np.random.default_rng(3)
    costs = packing.Costs(sentence=2, inside=6, sequence=5)
    for _ in range(30):
        length, capacity = int(rng.integers(5, 300)), 32
        places = sorted({*rng.integers(1, length + 1, int(length / rng.integers(3, 60)) + 1).tolist(), length})
        penalty = [0.0 if rng.random() < 0.4 or p == length else 2.0 for p in places]
        cuts = packing.best_cuts(places, penalty, length, capacity, costs, True)
        sizes = np.diff([0, *cuts])
        assert cuts[-1] == length and sizes.min() > 0 and sizes.max() <= capacity
        extra = dict(zip(places, penalty))
        cost = sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes.tolist()) + sum(extra.get(c, 6) for c in cuts) + 5 * len(cuts)
        best = brute_cost(places, penalty, length, capacity, costs)
        # the program cuts sentences only where a full sequence ends
        assert best <= cost <= best + 2 * capacity


def test_cuts_of_long_streams_are_within_some_per_cent_of_the_best():
    """Streams of many sequences, with sentence and document ends as thick as in prose."""
    rng = np.random.default_rng(4)
    costs, capacity = packing.Costs(sentence=4, inside=12, sequence=32), 256
    paid = best = 0
    for _ in range(6):
        length = int(rng.integers(6_000, 9_000))
        places = sorted({*rng.integers(1, length + 1, length // 18).tolist(), length})
        penalty = [0.0 if rng.random() < 0.05 or p == length else 4.0 for p in places]
        cuts = packing.best_cuts(places, penalty, length, capacity, costs, True)
        sizes, extra = np.diff([0, *cuts]), dict(zip(places, penalty))
        own = sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes.tolist()) + sum(extra.get(c, 12) for c in cuts) + 32 * len(cuts)
        least = brute_cost(places, penalty, length, capacity, costs)
        assert least <= own
        paid, best = paid + own, best + least
    assert paid <= 1.06 * best, paid / best
