"""Corpus operators on small fixtures against brute force, with nulls, blanks, long texts, repeats and extra columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from greenspark.llm import decontaminate, jaccard_join, pii, quality_rules, sharding, suffix_dedup

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30_000))


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 6))) for _ in range(n))


def table(spark, texts):
    """Clashing extra columns on purpose."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, "y") for i, t in texts],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, n bigint, token string")


@pytest.fixture(scope="module")
def odd_texts():
    base = prose(1, 300)
    words = base.split()
    near = " ".join(words[:100] + ["changed"] + words[101:])
    passage = " ".join(prose(2, 70).split())
    return [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "one two"), (5, base), (6, base), (7, near), (None, "lost row"),
            (8, prose(3, 40) + " " + passage + " " + prose(4, 40)), (9, prose(5, 60) + "\n" + passage), (10, LONG), (11, LONG + " end"),
            (12, prose(6, 200)), (12, prose(6, 200)), (13, "a b c d e"), (14, "A B C D E")]


def components(texts):
    sets, parent = {}, {}
    for i, t in texts:
        w = (t or "").encode().translate(jaccard_join.ASCII_LOWER).split()
        sets[i] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_join_equals_brute_force(spark, odd_texts):
    got = jaccard_join.similar_components(table(spark, odd_texts)).collect()
    assert len(got) == len(odd_texts)
    want = components([(i, t) for i, t in odd_texts if i is not None])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    kept = jaccard_join.one_of_each(table(spark, odd_texts)).select("doc_id").collect()
    assert sorted(r[0] for r in kept if r[0] is not None) == sorted({c for _, c in want.values()})


def test_jaccard_join_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_digest(docs).collect()}
    assert got == components([tuple(r) for r in docs.select("doc_id", "text").collect()])


def near_pairs(texts, size, pct):
    sets = {i: {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} for i, w in ((i, t.split()) for i, t in texts)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2)
            if 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]) and sets[a] & sets[b]}


@pytest.mark.parametrize("size, pct", [(5, 80), (4, 70), (4, 60)])
def test_jaccard_join_is_exact_for_small_sets(spark, size, pct):
    texts = []
    for k in range(40):
        w = prose(1000 + k, size + 1 + k // 4).split()
        texts += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w, f"end{k}"]))]
    want = near_pairs(texts, size, pct)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(table(spark, texts), size, pct).collect()}
    assert {(a, b) for a, b in itertools.combinations(sorted(got), 2) if got[a] == got[b]} == want
    assert min(len(texts[a][1].split()) for a, _ in want) - size + 1 == max(2, jaccard_join.smallest_set(pct))


def covered(texts, size=50):
    places, words = collections.defaultdict(set), {i: (t or "").encode().split() for i, t in texts if i is not None}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            places[tuple(w[k:k + size])].add((i, k))
    hit = collections.defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                hit[i].update(range(k, k + size))
    return {i: len(s) for i, s in hit.items()}


def test_repeated_passages_equal_brute_force(spark, odd_texts):
    got = suffix_dedup.repeated_passages(table(spark, odd_texts)).collect()
    assert {r["doc_id"]: r["n_repeated"] for r in got} == covered(odd_texts)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r["n_repeated"] for r in suffix_dedup.repeated_passages(docs).collect()}
    assert found == covered([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_leaks_equal_containment_and_slots(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts, items = docs.select("doc_id", "text").collect(), bench.collect()
    want = {(d[0], b["item_id"]) for d in texts for b in items if d[1] and b["text"] in d[1]}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert want <= got and {d for d, _ in got} == {d for d, _ in want}


def test_leaks_find_other_numbers_and_names_if_slots_agree(spark):
    item = "A train leaves for Boston at 60 km per hour and after 3 hours how far from home is Alice if Alice walks on"
    other = item.replace("60", "85").replace("3", "7").replace("Alice", "Maria")
    mixed = item.replace("is Alice if Alice", "is Maria if Peter")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id bigint, text string")
    docs = table(spark, [(1, "Intro here. " + item), (2, other), (3, prose(9, 300)), (4, None), (5, ""), (6, mixed)])
    got = {r["doc_id"]: r["reparameterised"] for r in decontaminate.leaks(docs, bench).collect()}
    assert got[1] is False and got[2] is True and 6 not in got and set(got) == {1, 2}
    left = decontaminate.without_leaks(docs, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6] and left.columns == docs.columns
    none = decontaminate.leaks(docs.limit(0), bench.limit(0))
    assert none.count() == 0


def test_leaks_find_copies_full_of_slots_in_any_case_and_short_items(spark):
    sums = "Compute 12 + 7 - 3 * 4 + 9 / 2 - 15 + 8"
    named = "We know that Alice met Bob near Paris when Carol and Dave left Rome with Erin for Oslo"
    title = "The Long Road From Old Lisbon To New Madrid By Way Of Sunny Green Valleys"
    items = [(1, sums), (2, named), (3, title), (4, "Who won?"), (5, "42"), (6, "---")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    filler = prose(11, 30)
    docs = table(spark, [(1, f"{filler} {sums} {filler}"), (2, named.lower()), (3, named.upper()), (4, title.upper()), (5, title),
                         (6, f"{filler} who won {filler} who won"), (7, f"{filler} Compute 13 + 8 - 4 * 5 + 1 / 3 - 16 + 9"), (8, "won who 43 421"),
                         (9, "so 42. " + filler)])
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 4), (9, 5)]


def base(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in reversed(re.sub("[^0-9]", "", m.group()))]
        total = sum(n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(d))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_personal_data_rules_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", "a@b.c", "1.2.3.4.5.6.7.8.", "300.1.1.1 1.1.1.300.4.4.4", "4111-1111-1111-1111", "\x01a@b.c\x01d", "a" * 50_000 + " " + "1 " * 3000,
             "é😀 x@y.zz +44 20 7946 0958", "%a@b.c%d@e.f_g@h.i"]
    texts += ["".join(rnd.choice("12 -.+@a(") for _ in range(rnd.randrange(60))) for _ in range(400)]
    texts += ["".join(rnd.choice(["4111111111111111", " ", "-", "+", "1.2.3.4", "a@b.co", "@", ".", "\x01", "é"]) for _ in range(rnd.randrange(30))) for _ in range(100)]
    rows = pii.pii_digest(table(spark, list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r["spans"].split(",")) and r["n_card"] == sum(k == "card" for k, _, _ in spans)


def test_contexts_find_unseen_identifiers(spark):
    texts = [(i, f"please call me at +1 (415) 555-01{i:02d} thanks") for i in range(8)]
    texts += [(20, "please call me at 415-555-0199 thanks"), (21, "version 2 of it"), (21, "version 2 of it"), (None, "call me at 5550199")]
    found = {r["doc_id"]: r["spans"] for r in pii.pii_digest(table(spark, texts)).collect()}
    assert found[20] == "phone:18:30" and found[21] == "" and found[None] == "phone:11:18"
    masked = {r["doc_id"]: r["text"] for r in pii.redacted(table(spark, texts)).collect()}
    assert masked[20] == "please call me at <phone> thanks" and masked[21] == "version 2 of it" and masked[0] == "please call me at <phone> thanks"


@pytest.mark.parametrize("number", ["415 555 0199", "(415) 555 0199", "41 55 50 19 9", "415 - 555 - 0199", "123 456 789", "415-555 01.99"])
def test_contexts_find_identifiers_in_groups(spark, number):
    texts = [(i, f"please call me at +1 (415) 555-01{i:02d} thanks") for i in range(8)]
    texts += [(20, f"é please call me at {number} thanks"), (21, "chapter 12 34 of 5")]
    masked = {r["doc_id"]: r["text"] for r in pii.redacted(table(spark, texts)).collect()}
    assert masked[20] == "é please call me at <phone> thanks" and masked[21] == "chapter 12 34 of 5"


def test_quality_rules_remove_frequent_lines(spark):
    line, rows = "Share this page with your friends", []
    for i in range(40):
        rows.append((i, prose(i, 30) + "\n" + line + "\n" + prose(i + 100, 20)))
    rows += [(50, "\n".join([f"SHARE this  page with your friends"] * 1 + [prose(7, 2)])), (51, None), (52, ""), (53, "a b c d e f g h i j " * 4), (None, prose(8, 50)),
             (60, prose(60, 50)), (60, prose(60, 50))]
    judged = quality_rules.quality_rules(table(spark, rows)).select("doc_id", "text", "_quality.*").collect()
    assert len(judged) == len(rows)
    by = {r["doc_id"]: r for r in judged}
    assert line not in by[0]["clean_text"] and by[0]["n_removed_words"] == 6 and by[0]["kept"]
    assert not by[50]["kept"] and not by[51]["kept"] and by[51]["n_words"] == 0 and not by[52]["kept"]
    assert by[53]["base_failed"] and by[53]["n_repeat_words"] == 40 and by[None]["kept"] and by[60]["kept"]


def test_copies_do_not_condemn_each_other(spark):
    text = "\n".join(prose(k, 8) for k in range(6))
    judged = quality_rules.quality_digest(table(spark, [(i, text) for i in range(60)])).collect()
    assert all(r["kept"] for r in judged)


@pytest.mark.parametrize("n", [0, 1, 2, 23, 24, 25, 500])
def test_shards_are_even_and_slots_gapless(spark, n):
    rows = [(i // 2 if i % 7 else None, None if i % 5 == 0 else f"é{i}") for i in range(n)]
    got = sharding.sharding_digest(table(spark, rows)).collect()
    assert len(got) == n
    sizes = collections.Counter(r["shard"] for r in got)
    assert n == 0 or max(sizes.values()) - min(sizes[s] for s in range(24)) <= 1
    for s, k in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(k))
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_permutation_is_a_shuffle(spark):
    got = [r[0] for r in spark.range(1000).select(sharding.permuted(F.col("id"), 1000)).collect()]
    assert sorted(got) == list(range(1000))
    near = sum(abs(a - b) < 100 for a, b in zip(got, got[1:], strict=False))
    assert near < 350
