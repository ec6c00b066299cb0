import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from foliant.llm import bpe, token_files, units, warc
from foliant.llm.files import opened
from foliant.llm.queries import tokenizer_path

P = pytest.importorskip("public_tokenizers")
PIECES = ["a", "b", " ", "  ", "\n", " \n", "\t", "é", "ß", "中文", "1", "²", ".", "'s", "'t", "’", " ", "　", "\x1c", "\x85", "😀", "_", "The", "Ⅷ", "̀", "\r\n", "\x00"]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def test_codec_is_tiktoken_and_decodes(ranks):
    codec, own = bpe.Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    all_ = texts(4000)
    flat, per = codec.encode(pa.array(all_))
    at = np.concatenate([[0], np.cumsum(per)])
    for i, t in enumerate(all_):
        ids = flat[at[i] : at[i + 1]]
        assert ids.tolist() == own.encode_ordinary(t)
        assert codec.decode(ids)[0].tobytes() == t.encode()


def test_perfect_hash_is_minimal_and_rejects_others(ranks):
    keys = list(ranks)[:5000]
    h = bpe.PerfectHash(keys)
    assert sorted(h.find(keys)) == list(range(len(keys)))
    assert set(h.find(["certainly not a key ".encode() + bytes([i]) for i in range(200)])) == {-1}


def test_units_and_a_small_memory(monkeypatch):
    all_ = [*texts(2000, 2), "long " * 400, "x" * 900, None]
    encode = lambda units: (np.frombuffer("".join(units).encode("utf-32-le"), "<u4"), np.array([len(u) for u in units]))
    own = units.span_hashes
    for chunk, hashes in ((64, own), (1 << 20, own), (64, lambda d, s, e: own(d, s, e) % np.uint64(7) << np.uint64(61))):
        monkeypatch.setattr(units, "CHUNK", chunk)
        monkeypatch.setattr(units, "span_hashes", hashes)
        memory = units.UnitMemory(encode, most_units=50, most_ids=300)
        for i in range(0, len(all_), 40):
            part = all_[i : i + 40]
            flat, per = memory.ids(pa.array([None, *part, None]).slice(1))
            assert flat.tolist() == [ord(c) for t in part for c in t or ""] and per.tolist() == [*(len(t or "") for t in part), 0]


def test_units_are_cut_where_the_pattern_never_matches_across():
    import regex

    pattern = regex.compile(P.PATTERN)
    for t in [*texts(4000, 3), "It's 3 o'clock, isn't it?\n\n  Yes.\t'so' a.'s x\u00a0y \u2003z", "'. 's", "a  b \n c"]:
        data = np.frombuffer(t.encode(), np.uint8)
        if len(data):
            at = [*units.unit_starts(data, np.array([0])).tolist(), len(data)]
            cut = [bytes(data[a:b]).decode() for a, b in zip(at, at[1:])]
            assert [w for u in cut for w in pattern.findall(u)] == pattern.findall(t)


def test_encoded_rows(odd, odd_rows, none, ranks):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = own.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = bpe.encoded(odd, ranks, P.PATTERN, keep_ids=False)
    assert Counter(map(tuple, got.collect())) == want
    assert bpe.encoded(none, ranks, P.PATTERN).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 200_001])
def test_range_coding_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 5000).astype(np.int64)
    symbols, counts = np.unique(np.concatenate([ids, [2]]), return_counts=True)
    table = token_files.Table.of(symbols, counts, 14)
    state, words = token_files.coded(ids, table)
    assert (token_files.uncoded(state, words, n, table) == ids).all()
    assert int(table.freq.sum()) == 1 << table.bits and table.freq.min() >= 1
    if n > 10_000:
        p = np.bincount(ids) / n
        assert 4 * len(words) < 1.1 * n * -(p[p > 0] * np.log2(p[p > 0])).sum() / 8 + 20_000


def test_token_files(spark, odd, odd_rows, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, x, *_ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    index, table = token_files.write_token_files(odd, open(path, "rb").read(), 2, block_ids=50)
    got = token_files.read_token_files(index, table, keep_ids=True).collect()
    assert sorted((r[:4] for r in map(tuple, got)), key=lambda r: r[1]) == want
    assert token_files.op4_query(none, path).count() == 0
    one = index.where("docs > 0").head()
    with opened(one.path) as f:
        f.seek(one.offset)
        raw = bytearray(f.read(one.bytes))
    raw[len(raw) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.read_block(bytes(raw), table)


def test_added_tokens_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path, end = tokenizer_path("byte_bpe_50k.json"), "<|endoftext|>"
    t = Tokenizer.from_file(path)
    said = ["plain words", f"a {end} b", end, None, f"{end}{end} x", "", f"no <|end oftext|>\n {end}\n", "after", "<|endoftext", f"tail {end}"]
    start, want = 0, []
    for i, x in enumerate(said):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert t.encode(said[1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, token_files.op4_query(docs, path).collect())) == want


def page_rows():
    inner = warc.record_bytes([("WARC-Type", "response"), ("X-Page-ID", "999")], b"false " * 50)
    big = "é" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX-Page-ID: 77", big), (3, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", "no id")]
    rows += [(8, "u", inner.decode() * 3), (9, "u", "WARC/1.1\r\n" * 40), (10, "u", "x" * 3000 + inner.decode()), (4, "u", "short")]
    return rows + [(100 + i, "u", f"page {i} " * (i * 7 % 50 + 1)) for i in range(60)]


def test_warc_round_trip_with_records_inside_payloads(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, 0, "clash") for r in rows], "page_id long, url string, html string, bytes int, digest string").repartition(3)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(i or -1, top.get(h or "", -1))
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and i != top[h or ""]
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[h or ""] if again else None] += 1
    assert Counter(map(tuple, warc.op2_query(pages).collect())) == want
    files = warc.write_warc(pages, file_bytes=20_000)
    for size in (97, 1000, 1 << 20):
        got = warc.read_warc(files, range_bytes=size, bodies=True).collect()
        assert Counter((r.page_id, r.payload_bytes) for r in got) == Counter((None if a is None else str(a), b) for (a, b, *_), n in want.items() for _ in range(n))
        assert all(r.record_type == "revisit" or hashlib.sha1(r.body).hexdigest() == r.payload_digest for r in got)
    assert not any(r.page_id in ("999", "77") for r in got)


def test_warc_without_pages_and_with_a_broken_file(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.op2_query(none).count() == 0
    good = warc.record_bytes([("WARC-Type", "response"), ("X-Page-ID", "1")], b"abc")
    (tmp_path / "a.warc").write_bytes(good + b"broken" + good)
    (tmp_path / "b.warc").write_bytes(b"no record" + good)
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}.warc", (tmp_path / f"{n}.warc").stat().st_size, 1) for n in "ab"], "path string, bytes long, records long")
    assert [r.page_id for r in warc.read_warc(files).collect()] == ["1"]


def test_warc_with_very_long_urls(spark):
    rows = [(i, f"http://a/{i}", f"page {i} " * 30) for i in range(20)]
    rows[3] = (3, "u" * 1_000_000, "after a long address " * 80)
    rows[7] = (7, "%" * 30_000, "WARC/1.1\r\n" * 3000)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.op2_query(pages).collect()
    assert Counter((x.page_id, x.payload_bytes, x.record_type) for x in got) == Counter((i, len(h), "response") for i, _, h in rows)
    files = warc.write_warc(pages)
    for size in (1000, 100_000):
        urls = {x.page_id: x.url for x in warc.read_warc(files, range_bytes=size, whole=True).collect()}
        assert len(urls) == 20 and urls["3"] == rows[3][1] and urls["7"] == "%25" * 30_000


def test_warc_that_lacks_records_is_reported(spark, tmp_path):
    good = warc.record_bytes([("WARC-Type", "response"), ("X-Page-ID", "1")], b"abc")
    (tmp_path / "a.warc").write_bytes(good + good[:-1] + b"x" + good)
    at = f"file://{tmp_path}/a.warc"
    listed = lambda n: spark.createDataFrame([(at, 3 * len(good), n)], "path string, bytes long, records long")
    (tmp_path / "a.warc").write_bytes(good + b"?" * len(good) + good)
    with pytest.raises(ValueError, match="3 records, 1 are reached"):
        warc.read_warc(listed(3), whole=True)
    assert warc.read_warc(listed(None), whole=True).count() == 1
