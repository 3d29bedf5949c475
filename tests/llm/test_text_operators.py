import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestra.llm import chosen_path, decontamination, license_scan, line_dedup, packing, suffix_dedup
from attestra.llm.common import Words, hash_words
from attestra.llm.queries import QUERIES, vocabulary_path
from tests.llm.conftest import prose

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text):
    return WORD.findall((text or "").encode().lower())


def test_words_equal_the_pattern(odd_rows):
    import pyarrow as pa

    texts = [t for _, t in odd_rows]
    found = Words(pa.array(texts, pa.string()))
    for row, text in enumerate(texts):
        spans = range(found.bounds[row], found.bounds[row + 1])
        assert [found.word(i) for i in spans] == words_of(text)
    known = {w for t in texts for w in words_of(t)}
    ordered = sorted(known)
    assert len(set(hash_words(ordered).tolist())) == len(known)
    table = dict(zip(ordered, hash_words(ordered).tolist()))
    assert all(table[found.word(i)] == h for i, h in enumerate(found.hash.tolist()))


# ---- line dedup ---------------------------------------------------------------------------------


def lines_kept(rows, least=10):
    def key(line):
        k = line.encode().strip(b" \t\n\x0b\x0c\r").lower()
        return k if len(k.decode()) >= least else None

    held = {}
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) is None or i is None or len(held[key(x)]) < 2
                or min(held[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_line_dedup(odd, odd_rows, empty):
    got = line_dedup.dedup_lines(odd).collect()
    assert Counter((r.id, r.text or "", r.n_lines, r.n_dropped) for r in got) == lines_kept(odd_rows)
    kept = line_dedup.without_shared_lines(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)
    assert line_dedup.dedup_lines(empty).collect() == []


def test_lines_over_a_higher_threshold(spark):
    rows = [(i, "twice in here\nthrice in here" if i < 2 else "thrice in here") for i in range(3)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_documents=3)
    assert {r.id: r.text for r in got.collect()} == {
        0: "twice in here\nthrice in here", 1: "twice in here", 2: ""}


# ---- decontamination ----------------------------------------------------------------------------


def hits_of(text, items, window=13):
    words, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        own = words_of(item_text)
        if item is None or not own:
            continue
        sizes = [own] if len(own) < window else [own[i : i + window] for i in range(len(own) - window + 1)]
        for part in sizes:
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [10_000, 40])
def test_decontamination(spark, odd, odd_rows, empty, block_words):
    rng = random.Random(3)
    long = next(t for i, t in odd_rows if i == 6).split(" ")
    items = [(1, " ".join(long[500:530])), (2, "A b c"), (3, " ".join(long[520:560])), (4, None), (5, ""),
             (None, "x y"), (1, " ".join(long[9000:9013])), (6, prose(rng, 20)), (7, "c")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(odd, frame, block_words=block_words)
    got = decontamination.contaminated(got).collect()
    want = Counter((i, *map(str, hits_of(t, items))) for i, t in odd_rows)
    assert Counter((r.id, str(r.n_words), str(r.n_hit), str(r["items"])) for r in got) == want
    for r in got:
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.find_contamination(odd, none).collect()} == {0}
    assert decontamination.find_contamination(empty, frame).collect() == []


def test_spans_are_cut_out(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame(
        [(1, f"Before. {item.upper()}! After it."), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontamination.find_contamination(docs, items)
    got = {r.id: r.text for r in decontamination.without_spans(found).collect()}
    assert got == {1: "Before. ! After it.", 2: "clean"}


def test_automaton_against_all_substrings():
    rng = random.Random(9)
    for _ in range(60):
        items = [(i, [rng.randrange(3) for _ in range(rng.randrange(1, 12))]) for i in range(4)]
        automaton = decontamination.SuffixAutomaton(items, 4)
        text = [rng.randrange(3) for _ in range(25)]
        import numpy as np

        hit, found = np.zeros(25, bool), set()
        longest = automaton.scan(text, 0, hit, found)
        want, marks = set(), np.zeros(25, bool)
        best = max(n for n in range(26) for i in range(26 - n) if n == 0 or any(
            text[i : i + n] == w[j : j + n] for _, w in items for j in range(len(w))))
        for item, w in items:
            for part in [w] if len(w) < 4 else [w[j : j + 4] for j in range(len(w) - 3)]:
                for i in range(26 - len(part)):
                    if text[i : i + len(part)] == part:
                        want.add(item)
                        marks[i : i + len(part)] = True
        assert found == want and (hit == marks).all() and longest == best


# ---- license scan -------------------------------------------------------------------------------


def test_license_scan(spark, odd, odd_rows, empty):
    texts = [
        "Released under the MIT License. Under the mit\nlicense again, under the MIT, license",
        "Licensed under the Apache License, Version 2.0 (the License)", "CC BY-NC 4.0", "cc by nd",
        "This work is licensed under the GNU General Public License, version 3.", None, "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and its associated documentation files", "mit und under the license", "general public things",
    ] + [t for _, t in odd_rows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in license_scan.scan_licenses(docs).collect()}
    phrases = [(p.encode().split(), label) for p, label in license_scan.PHRASES]
    for i, text in enumerate(texts):
        words = words_of(text)
        starts = sorted((k, label) for p, label in phrases for k in range(len(words)) if words[k : k + len(p)] == p)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(starts))
        assert (r.first_word, r.last_word) == ((starts[0][0], starts[-1][0]) if starts else (None, None))
        assert r.base_labels == sorted({label for _, label in starts})
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert [got[i]["labels"] for i in (3, 4, 7, 8, 9)] == [[], ["gpl"], ["mit"], [], []]
    assert license_scan.scan_licenses(empty).collect() == []
    assert license_scan.scan_licenses(odd).count() == len(odd_rows)


def test_notices_without_words_the_corpus_lacks(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    gpl = license_scan.TEMPLATES[2][1].split()
    texts = [
        mit, "word " * 30 + mit, f"{mit} {mit}", "Permission is hereby granted, free of charge, to",
        " ".join(gpl[:13] + ["and", "so", "on"] + gpl[13:26]), "gnu general public license",
    ]
    got = {
        r.id: r
        for r in license_scan.scan_licenses(
            spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    }
    assert [got[i]["labels"] for i in range(6)] == [["mit"], ["mit"], ["mit"], [], ["gpl"], []]
    assert [got[i]["score"] for i in range(4)] == [0.8, 0.8, 0.8, 0.0]
    assert [(m["first"], m["last"]) for m in got[1]["matches"]] == [(30, 45)]
    assert [(m["first"], m["last"]) for m in got[2]["matches"]] == [(0, 15), (16, 31)]


def test_roots_must_agree_on_the_phrase():
    import pyarrow as pa

    templates = [license_scan.Template("x", "alpha beta gamma delta", "beta gamma delta", False)]
    index = license_scan.Index(templates, {b"beta": 9, b"gamma": 1, b"delta": 5})
    assert templates[0].roots({b"beta": 9, b"gamma": 1, b"delta": 5}) == [(b"gamma", 1), (b"delta", 2), (b"beta", 0)]
    texts = ["gamma beta delta", "beta gamma delta beta gamma delta", "delta", "beta gamma", "delta beta", "", None]
    assert index.candidates(Words(pa.array(texts, pa.string()))) == [(1, 3, 0), (1, 6, 0)]


def test_a_phrase_repeated_very_often(spark):
    text = "Under the MIT license, " * 4000 + "licensed under CC BY SA 4.0 " * 300
    frame = spark.createDataFrame([(1, text), (2, "license mit the under " * 4000)], "doc_id long, text string")
    got = {r.id: r for r in license_scan.scan_licenses(frame).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (4000, 0, 4 * 3999)
    assert got[1].labels == ["cc-by-sa", "mit"] and got[1].score == 1.0 and len(got[1].matches) == 4300
    assert got[2].n_base == 3999 and got[2].base_labels == ["mit"] or got[2].n_base == 0


# ---- packing ------------------------------------------------------------------------------------


def pieces_and_ids(frame, size, **options):
    path = vocabulary_path("word_bpe_49k.json")
    rows = packing.pack_documents(frame, path, size=size, **options).collect()
    return rows, packing.WordTokens(path)


def test_packing_keeps_every_token(odd, odd_rows):
    from tokenizers import Tokenizer

    rows, _ = pieces_and_ids(odd, 512)
    reference = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    want = Counter()
    for i, text in odd_rows:
        want[(i, tuple(reference.encode(text or "", add_special_tokens=False).ids + [2]))] += 1
    documents, current = Counter(), {}
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) > 0
        key = (r.id, r.doc_tokens)
        if r.start == 0:
            current[key] = []
        assert len(current[key]) == r.start
        current[key] += r.ids
        if len(current[key]) == r.doc_tokens:
            documents[(r.id, tuple(current.pop(key)))] += 1
    assert documents == want
    padding = 0
    for pieces in sequences.values():
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        total = sum(p.length for p in pieces)
        assert total <= 512
        padding += 0 if total & (total - 1) == 0 else 512 - total
    assert padding < 0.1 * sum(r.length for r in rows)


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    import numpy as np

    for _ in range(40):
        place = np.array(sorted({0, *(rng.randrange(1, 90) for _ in range(18))}))
        place = np.unique(np.concatenate([place, np.arange(0, place[-1], 12)]))
        fee = np.array([0] + [rng.choice([0, 3, 9]) for _ in place[1:]])
        size, best = 16, [0]
        for j in range(1, len(place)):
            options = []
            for i in range(j):
                n = int(place[j] - place[i])
                if n <= size:
                    options.append(best[i] + (0 if n & (n - 1) == 0 else size - n))
            best.append(min(options) + int(fee[j]) + packing.WINDOW_COST)
        cuts = [0, *packing.cheapest_cuts(place, fee, size)]
        total = 0
        for i, j in zip(cuts, cuts[1:]):
            n = int(place[j] - place[i])
            assert n <= size
            total += (0 if n & (n - 1) == 0 else size - n) + int(fee[j]) + packing.WINDOW_COST
        assert total == best[-1]


def test_special_strings_and_empty(spark, empty):
    texts = ["<|endoftext|> inside", "plain's 'tis it'll", "İstanbul ΣΑΣ ǅ", "é   x\u001cy", "12 345"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, words = pieces_and_ids(frame, 4096)
    for r in rows:
        assert r.ids == words.tokenizer.encode(texts[r.id], add_special_tokens=False).ids + [2]
    assert pieces_and_ids(empty, 4096)[0] == []


def test_ids_equal_the_library():
    words = packing.WordTokens(vocabulary_path("word_bpe_49k.json"))
    rng = random.Random(7)
    marks = ["'", "'s", "'re", "'ll", "'tis", "''s", "'s's", ",'s", "'D", "don't", "I'M", "\x00", "\u0085", "\xa0",
             "\x1c", "1²", "x" * 300, "ŉ", "ǅ", "İ", "é", "e\u0301", "Σ", "<|endoftext|>", "<|", "🙂", "\u2028"]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 'S{chr(c)} {chr(c)}'t1" for c in range(0x260)]
    texts += ["", "'", "'s", " '", "x '"]
    texts += ["".join(rng.choice([*marks, " ", "\n", "a", "Zs", "9", "."]) for _ in range(30)) for _ in range(800)]
    want = [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for limit in (packing.CACHED_PIECES, 3):
        words.known = packing.TwoGenerations(limit)
        assert [x.tolist() for x in words.ids(texts)] == want
        assert [x.tolist() for x in words.ids(texts)] == want
        assert len(words.known.young) <= limit and len(words.known.old) <= limit
    assert words.ids([]) == [] and [len(x) for x in words.ids(["", " ", ""])] == [0, 0, 0]


@pytest.mark.parametrize("size", [128, 3000, 1])
def test_packing_into_other_sizes(odd, size):
    rows, _ = pieces_and_ids(odd, size)
    filled, padding = Counter(), 0
    for r in rows:
        filled[r.sequence_id] += r.length
    for total in filled.values():
        assert total <= size
        padding += 0 if total & (total - 1) == 0 else size - total
    assert padding < 0.15 * sum(filled.values())
    starts = {(r.id, r.doc_tokens): 0 for r in rows}
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0) and starts


def test_free_starts_are_powers_of_two_and_the_size():
    import numpy as np

    place = np.array([0, 3, 4, 7, 8, 11, 12, 24])
    found, begin = packing.free_starts(place, 12)
    got = {(j, i) for j in range(len(place)) for i in found[begin[j] : begin[j + 1]]}
    lengths = {1, 2, 4, 8, 12}
    assert got == {(j, i) for j in range(len(place)) for i in range(j) if place[j] - place[i] in lengths}


# ---- chosen path --------------------------------------------------------------------------------


def groups_of(rows, percent=80):
    sets = []
    for i, text in rows:
        w = words_of(text)
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w and i is not None else set())
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for a in range(n):
        if rows[a][0] is not None:
            least[root(a)] = min(least.get(root(a), rows[a][0]), rows[a][0])
    return [(rows[a][0], least.get(root(a)), links[a]) for a in range(n)]


def test_similar_groups(spark, odd, odd_rows, empty):
    got = chosen_path.similar_groups(odd).collect()
    # The rows of id 16 have different texts and are one node of the graph.
    assert Counter((r.id, r.group, r.n_links) for r in got if r.id != 16) == Counter(
        x for x in groups_of(odd_rows) if x[0] != 16)
    assert sum(r.id == 16 for r in got) == 2
    assert chosen_path.similar_groups(empty).collect() == []


@pytest.mark.parametrize("limits", [{}, {"LIMIT": 4, "BLOCK_SETS": 16, "DEPTH": 4}])
def test_many_near_copies(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(chosen_path, name, value)
    rng = random.Random(8)
    rows = []
    for group in range(4):
        base = prose(rng, 120).split(" ")
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "neu" + str(rng.randrange(5))
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, prose(rng, 60)) for k in range(40)]
    got = chosen_path.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.group, r.n_links) for r in got) == sorted(groups_of(rows))


def test_links_of_repeated_rows(spark):
    rng = random.Random(3)
    base = prose(rng, 120)
    rows = [(1, base), (1, base), (2, base + " neu"), (3, prose(rng, 50)), (4, base), (4, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = chosen_path.similar_groups(docs).collect()
    assert sorted((r.id, r.group, r.n_links) for r in got) == [
        (1, 1, 4), (1, 1, 4), (2, 1, 4), (3, 3, 0), (4, 1, 4), (4, 1, 4)]


def test_links_beside_empty_blocks(spark, monkeypatch):
    """Two long texts a cluster, in two blocks: often in one of them, so that the other is empty."""
    monkeypatch.setattr(chosen_path, "BLOCK_SHINGLES", 250)
    rng = random.Random(4)
    rows = []
    for _ in range(8):
        base = prose(rng, 200)
        rows += [(len(rows), base), (len(rows) + 1, base + " neu")]
    got = chosen_path.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.group, r.n_links) for r in got) == sorted(groups_of(rows))


def test_expected_recall():
    assert chosen_path.expected_recall() > 0.999


def test_pairs_in_large_buckets_stay_together(spark):
    """Pairs at 0.8 that share a passage with all others, walked down to the last level."""
    rng = random.Random(12)
    hot, pairs, rows = [f"hot{k}" for k in range(14)], 4000, []
    for pair in range(pairs):
        own = [f"w{rng.randrange(10**9)}" for _ in range(40)]
        for side in (own[:35], own[:30] + own[35:]):  # of 45 shingles each 40 are equal
            rows.append((len(rows), " ".join(hot + side)))
    sets = chosen_path.embed(spark.createDataFrame(rows, "id long, text string").repartition(8))
    paths = chosen_path.first_paths(sets, chosen_path.RUNS)
    for _ in range(chosen_path.FIRST_DEPTH, chosen_path.DEPTH):
        paths = chosen_path.longer_paths(paths)
    nodes = paths.groupBy("node", F.floor(F.col("id") / 2).alias("pair")).agg(F.count_distinct("id").alias("n"))
    met = nodes.filter("n = 2").select("pair").distinct().count()
    assert met > 0.999 * pairs
    assert chosen_path.expected_recall(depth=chosen_path.DEPTH) > 0.999


# ---- repeated byte strings ----------------------------------------------------------------------


def bytes_kept(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for (i, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def digests(frame, length):
    return Counter(
        (r.id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in suffix_dedup.remove_repeats(frame, length).collect())


def test_repeated_strings(spark, odd, odd_rows, empty):
    assert digests(odd, 400) == bytes_kept(odd_rows, 400)
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_overlapping_passages_and_periods(spark):
    rng = random.Random(4)
    parts = [prose(rng, rng.randrange(20, 60)) for _ in range(6)]
    rows = []
    for k in range(40):
        text = "".join(
            rng.choice(parts)[rng.randrange(40) :][: rng.randrange(60, 400)] + prose(rng, rng.randrange(6))
            for _ in range(rng.randrange(1, 6)))
        rows.append((k, text))
    rows += [(50, "ab" * 300), (51, "ba" * 180 + "c"), (52, "abc" * 200), (53, "ä" * 333)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digests(frame, 150) == bytes_kept(rows, 150)


def test_many_documents_without_an_id_or_with_one_id(spark):
    rng = random.Random(6)
    parts = [prose(rng, 40) for _ in range(4)]
    rows = [(None if k % 3 else 7, prose(rng, 10) + rng.choice(parts) + prose(rng, rng.randrange(9))) for k in range(60)]
    rows += [(None, rows[0][1]), (None, rows[1][1]), (7, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digests(frame, 150) == bytes_kept(rows, 150)
    # Joins and groups go by id and text, so no id gathers many texts.
    docs = frame.selectExpr("doc_id AS id", "text").withColumn("check", suffix_dedup.text_check())
    assert docs.select("check").distinct().count() == len({t for _, t in rows})


# ---- whole tables -------------------------------------------------------------------------------


def test_line_dedup_query_equals_sql(spark):
    from attestra.llm.queries import ORACLES
    from checks import compare

    got = QUERIES["op7_line_dedup"](spark, SMALL).toPandas()
    want = compare.connect(SMALL).execute(ORACLES["op7_line_dedup"]).df()
    assert compare.normalized(got) == compare.normalized(want)


def test_queries_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op3_decontamination"](spark, SMALL).collect()}
    for i, text in docs:
        n, hit, found = hits_of(text, items)
        names = ",".join(sorted(map(str, found)))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (n, hit, len(found))
        assert got[i].items_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n)
    got = QUERIES["op6_chosen_path"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.group_id, r.n_links) for r in got) == sorted(groups_of(docs))
    got = QUERIES["op10_suffix_dedup"](spark, SMALL).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == bytes_kept(docs, 400)
    got = {r.doc_id: r for r in QUERIES["op1_license_scan"](spark, SMALL).collect()}
    phrases = [(p.encode().split(), label) for p, label in license_scan.PHRASES]
    for i, text in docs:
        w = words_of(text)
        starts = sorted((k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p)] == p)
        assert got[i].n_base == len(starts) and got[i].base_labels == ",".join(sorted({x for _, x in starts}))
