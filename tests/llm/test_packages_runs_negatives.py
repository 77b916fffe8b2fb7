"""Packages, runs and hard negatives against brute force, with nulls, blanks, long texts, ties, repeats and extra columns."""

import io
import random
import struct
import zipfile
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from greenspark.llm import hard_negatives, runs, warc_zip


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, length, offset):
        return self.data[offset:offset + length]


# --- packages ---

def test_members_of_plain_and_zip64_files():
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("a.txt", b"first")
        with z.open(zipfile.ZipInfo("dir/b"), "w", force_zip64=True) as member:
            member.write(b"second PK\x05\x06 inside")
        z.comment = b"a note with PK\x05\x06 in it"
    found = warc_zip.members(Bytes(body.getvalue()))
    assert {k: body.getvalue()[a:a + n] for k, (a, n) in found.items()} == {"a.txt": b"first", "dir/b": b"second PK\x05\x06 inside"}


def test_members_through_the_zip64_directory():
    """A package written by hand whose sizes, offset, count and directory all stand in ZIP64 fields."""
    data, name = b"payload", b"archive/x"
    local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name
    local += struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
    front = b"stub" * 5
    extra = struct.pack("<HHH", 0x7777, 2, 9) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), len(front))
    central = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra),
                          0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(front) + len(local)
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<IIQI", 0x07064B50, 0, at + len(central), 1)
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = front + local + central + end64 + locator + end
    (offset, length), = warc_zip.members(Bytes(whole)).values()
    assert whole[offset:offset + length] == data


def test_broken_and_compressed_packages_are_errors():
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    for bad in (body.getvalue(), b"", b"no zip at all", body.getvalue()[:-5]):
        with pytest.raises(ValueError):
            warc_zip.members(Bytes(bad))


def test_record_round_trip():
    for payload in (b"", b"\r\n\r\nWARC/1.1\r\n", "é中".encode()):
        digest = sha256(payload).hexdigest()
        warc, http, back = warc_zip.parse_record(warc_zip.record_bytes(7, "http://a/b\r\nX: y z", payload, digest, None, "p"))
        assert back == payload and warc["warc-target-uri"] == "http://a/b%0D%0AX:%20y%20z" and warc["warc-page-id"] == "7" and "x" not in warc
        warc, http, back = warc_zip.parse_record(warc_zip.record_bytes(8, None, payload, digest, 7, "p"))
        assert back == b"" and int(http["content-length"]) == len(payload) and warc["warc-refers-to-page-id"] == "7"


def pages_table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id bigint, url string, html string, digest string, first int")


def test_pages_come_back(spark):
    long_, short = "<p>" + "a" * 200, "<p>b"
    rows = [(5, "http://x", long_), (3, "http://y", long_), (3, "http://y", long_), (9, None, long_), (None, "http://n", long_), (1, "u", short),
            (2, "u", short), (4, "u", None), (6, "u", ""), (7, "u", "é" * 49 + "x"), (8, "u", "é" * 49 + "x"), (10, "u", "é" * 50),
            (11, "u", "é" * 50), (12, "big", "word " * 400_000), (None, None, "z" * 150), (None, None, "z" * 150)]
    rows += [(100 + k, "many", "hot page " * 20) for k in range(500)]
    packages = warc_zip.write_packages(pages_table(spark, rows), warc_zip.shared_folder(spark))
    assert packages.agg(F.sum("n_records")).first()[0] == len(rows)
    records = warc_zip.read_packages(packages)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = sorted((repr(i), len((h or "").encode()), sha256((h or "").encode()).hexdigest(),
                   *(("response", None) if first.get(h) in (None, i) else ("revisit", first[h]))) for i, _, h in rows)
    got = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == want
    full = warc_zip.with_payloads(records).select("page_id", "payload").collect()
    assert sorted((repr(r[0]), bytes(r[1]).decode()) for r in full) == sorted((repr(i), h or "") for i, _, h in rows)


def test_no_pages(spark):
    assert warc_zip.warc_digest(pages_table(spark, [])).count() == 0


def test_small_ranges_and_packages(spark, monkeypatch):
    rows = [(k, f"u{k}", f"page {k} " * 30) for k in range(200)]
    table = pages_table(spark, rows).coalesce(1)
    monkeypatch.setattr(warc_zip, "PACKAGE_BYTES", 3000)
    packages = warc_zip.write_packages(table, warc_zip.shared_folder(spark))
    assert packages.count() > 5
    monkeypatch.setattr(warc_zip, "RANGE_BYTES", 300)
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in warc_zip.read_packages(packages).collect()} == {(i, h) for i, _, h in rows}


# --- runs ---

def brute_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q) and not any(all(w[i + k] == w[i + k + d] for k in range(size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + size for s, size, q in found)]
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest())


def random_words(rnd):
    n, kinds = rnd.randrange(0, 100), rnd.choice([1, 2, 2, 3, 4, 40])
    w = [f"w{rnd.randrange(kinds)}" for _ in range(n)]
    if n > 20 and rnd.random() < 0.6:
        a, p = rnd.randrange(n), rnd.randrange(1, 12)
        w = w[:a] + (w[a:a + p] * n)[:n - a]
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(n)] = "odd"
    return w


def test_runs_equal_brute_force():
    rnd, finder = random.Random(8), runs.RunFinder()
    for _ in range(800):
        w = [x.encode() for x in random_words(rnd)]
        assert finder.runs(w) == brute_runs(w)


def test_link_cut_gives_last_ends():
    rnd = random.Random(3)
    for _ in range(60):
        w = [rnd.randrange(2) for _ in range(40)]
        automaton = runs.SuffixAutomaton(w)
        tree = runs.LastEnds(automaton.link)
        for i in range(len(w)):
            got = {c: automaton.length[x] for x, c in tree.access(automaton.ends[i], i) if automaton.length[x]}
            want = {}
            for size in range(1, i + 1):
                ends = [e for e in range(size - 1, i) if w[e - size + 1:e + 1] == w[i - size + 1:i + 1]]
                if ends:
                    want[ends[-1]] = size
            assert got == want


def test_runs_digest(spark):
    rnd = random.Random(4)
    texts = [(i, " ".join(random_words(rnd))) for i in range(300)] + [(500, None), (501, ""), (502, " \n\t "), (503, "a " * 12), (503, "a " * 12), (504, "a " * 11)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id bigint, text string, start string, n_runs int")
    got = sorted((tuple(r) for r in runs.runs_digest(table).collect()), key=repr)
    assert got == sorted((brute_row(i, t) for i, t in texts), key=repr)
    nothing = spark.createDataFrame([(None, "b c " * 20)], "doc_id bigint, text string")
    row = runs.runs_digest(nothing).first()
    assert (row["doc_id"], row["n_runs"], row["period"]) == (None, 1, 2)
    assert runs.runs_digest(table.limit(0)).count() == 0


def test_runs_of_a_very_long_text(spark):
    block = [f"w{k % 9973}" for k in range(30_000)]
    words = [f"v{k}" for k in range(5_000)] + block * 4
    table = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    rows = runs.without_repeats(table).collect()
    finder = runs.RunFinder()
    assert (5_000, 120_000, 30_000) in finder.runs([w.encode() for w in words]) and len(rows) == 1 and rows[0]["text"].startswith("v0 v1 ")


# --- hard negatives ---

def brute_negatives(rows):
    use, seen = [], set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        q = tuple(int(np.floor(256 * np.float64(x))) for x in v)
        if (i, label, q) not in seen:
            seen.add((i, label, q))
            use.append((i, label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in use:
        if a[0] % 100:
            continue
        scored = sorted((-dot(a[2], b[2]), b[0], b[1]) for b in use if b is not a)
        for ps, p, _ in [s for s in scored if s[2] == a[1]][:5]:
            fit = [s for s in scored if s[2] != a[1] and 30 * -ps <= 100 * -s[0] <= 90 * -ps]
            out += [(a[0], p, k + 1, s[1], -ps, -s[0]) for k, s in enumerate(fit[:10])]
    return sorted(out)


def vectors_table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows],
                                 f"vec_id bigint, embedding array<{kind}>, label int, q string, score int")


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e5])
def test_negatives_equal_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 70)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    rng = np.random.default_rng(int(scale))
    middle = rng.normal(size=7) * 0.3
    rows = [(int(i), [float(np.float32(x)) for x in (middle + rng.normal(size=7) * 0.2) * scale], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + k, rows[5][1], 2) for k in range(20)]  # ties
    rows += [(600, None, 1), (601, [None, 1.0], 1), (602, [float("nan")], 1), (603, [float("inf"), 1.0], 2), (604, [1.0] * 7, None), (None, [1.0] * 7, 1),
             (700, [], 1), (701, [0.5], 2), (3, rows[3][1], rows[3][2])]
    got = sorted(tuple(r) for r in hard_negatives.negatives_digest(vectors_table(spark, rows)).collect())
    assert got == brute_negatives(rows) and got


def test_no_vectors(spark):
    assert hard_negatives.negatives_digest(vectors_table(spark, [])).count() == 0
    assert hard_negatives.negatives_digest(vectors_table(spark, [(100, [1.0], 1)])).count() == 0


def test_scores_beyond_a_long_keep_their_order(spark):
    rows = [(100, [1e20, 1.0], 1), (101, [2e20, 0.0], 1), (102, [9e19, 0.0], 2), (103, [8e19, 5.0], 2), (104, [-9e19, 0.0], 2)]
    got = [tuple(r) for r in hard_negatives.negatives_digest(vectors_table(spark, rows, "double")).orderBy("rank").collect()]
    assert [(r[1], r[2], r[3], r[4], r[5]) for r in got] == [(101, 1, 102, None, None), (101, 2, 103, None, None)]


def test_residue_scores_are_exact():
    rng = np.random.default_rng(2)
    for scale in (3, 250, 1e4, 1e8, 1e15, 1e30):
        a, b = (np.floor(rng.normal(size=(k, 90)) * scale) for k in (4, 30))
        bound = 90 * int(max(np.abs(a).max(), np.abs(b).max())) ** 2
        want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a]
        assert hard_negatives.Scorer(b, bound).scores(a).tolist() == want
