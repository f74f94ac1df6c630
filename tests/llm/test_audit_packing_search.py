"""Filter interactions, order-preserving packing and ranked search against brute force and on odd inputs."""

import collections
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import interactions, ordered, ranking

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, mask int, item string, part string, key string"
ODD = [None, "", " \n\t ", "word", "Zażółć ñandú ’s 東京 #1", "a b c d e f g h i j k l " * 4000, "x" * 100_000, "same text twice here", "same text twice here", "same text twice here", "ABC DEF. Ghi? jkl!"]
ODD_IDS = [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, None]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 1, "x", "x", "x") for i, t, lang in rows], SCHEMA)


def prose(seed, n, end=9):
    rng = random.Random(seed)
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz one two three four five six seven".split()) + (". " if i % end == end - 1 else rng.choice(["", ",", ""])) for i in range(n))


# ---- 11


def interactions_brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs, out = collections.defaultdict(list), {}
    for i, text, lang in rows:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        docs[lang or ""].append(({f for f, on in fails.items() if on}, i in good, i in toxic))
    for part, own in docs.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                redundant = sum(f in d[0] and bool(d[0] & set(order[: step - 1])) for d in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_filter_interactions(spark):
    texts = [*zip(ODD_IDS, ODD, itertools.cycle(["en", None, ""])), *((10 + k, prose(k % 7, 150 + 20 * k) + " X" * (3 * k), "fr") for k in range(20))]
    texts += [(40, prose(1, 300), "en"), (39, prose(1, 300), "fr"), (41, prose(1, 300), None)]
    labels = [(1, 1, 0), (1, 0, 1), (7, 1, None), (39, None, 1), (41, 1, 1), (None, 1, 1), (12, 1, 0), (999, 1, 1)]
    got = interactions.audit(table(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    expected = interactions_brute(texts, labels)
    assert len(got) == len(expected) == 3 * 600  # the null part is that of the empty string
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == expected


def test_filter_interactions_match_sql(spark, tmp_path):
    texts = [*((k, t, lang) for k, (t, lang) in enumerate(zip([x for x in ODD], itertools.cycle(["en", None, "de"]))))]
    docs, labels = table(spark, texts), spark.createDataFrame([(1, 1, 0), (1, 0, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", labels.toArrow())
    sql = con.sql(interactions.SQL)
    got = interactions.audit(docs, labels).select(*sql.columns).collect()
    assert sorted(map(tuple, got)) == sorted(sql.fetchall())


def test_filter_interactions_of_nothing(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(none, labels).count() == 0
    assert {r["good_lost"] for r in interactions.audit(table(spark, [(1, "a", "en")]), labels).collect()} == {0}


def test_long_texts_are_measured_in_steps(monkeypatch):
    text = ("Ab cd\tef  gh\n" * 300 + "tail & more").encode()
    whole = interactions.text_failures(text, len(text))
    for step in (1, 7, 100):
        monkeypatch.setattr(interactions, "_STEP", step)
        assert interactions.text_failures(text, len(text)) == whole


# ---- 12


def cheapest(ends, prices, size):
    pos, price, best = [0, *ends], [0, *prices], [0]
    for j in range(1, len(pos)):
        lengths = [(i, pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= size]
        best.append(min(best[i] + (0 if n & (n - 1) == 0 else size - n) for i, n in lengths) + price[j])
    return best[-1]


def padding(length, size):
    return 0 if length & (length - 1) == 0 else size - length


def test_cuts_are_cheapest():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.choice([8, 16, 30, 32])
        ends = np.cumsum([rng.randint(1, size // 2) for _ in range(rng.randint(1, 40))])
        prices = np.array([rng.choice([0, 3, 9]) for _ in ends])
        cuts = ordered.choose_cuts(ends, prices, size)
        lengths = np.diff([0, *ends[cuts]]).tolist()
        assert cuts[-1] == len(ends) - 1 and max(lengths) <= size
        assert sum(padding(n, size) for n in lengths) + prices[cuts].sum() == cheapest(ends.tolist(), prices.tolist(), size)


def test_checksums_of_pieces():
    ids = np.random.default_rng(0).integers(0, 50_000, 3000).astype("<u4")
    for a, b in ((0, 5), (3, 9), (100, 2100), (7, 7), (0, 2048)):
        upto = [np.array([zlib.crc32(ids[:k].tobytes())], np.uint32) for k in (a, b)]
        assert ordered.piece_crc(*upto, np.array([b - a]))[0] == zlib.crc32(ids[a:b].tobytes())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_ids_are_those_of_the_library(library):
    rng = random.Random(4)
    signs = ["a", "B", "é", "1", " ", "\n", "'", "s", "t", ".", "\t", "ß", "東", "É", "́", "—", "!", '"', ")", "<|endoftext|>", "ll", "\x1c", "\x85", " "]
    texts = ["", None, "<|ENDOFTEXT|> <|endoftext|> b", "don't it's, 'tis 's'", "K Å İstanbul ﬁ", prose(1, 3000)] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    for text, (ids, ends) in zip(texts, ordered.Words().encode(texts)):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids
        assert (np.diff(ends) > 0).all() and (not len(ends) or 0 < ends[0] and ends[-1] <= len(ids))
    (_, ends), = ordered.Words().encode(['One two. "Three four?" 3.14 five'])
    assert [ordered.Words().encode([t])[0][0].tolist().__len__() for t in ("One two.", 'One two. "Three four?"')] == ends.tolist()


def test_candidates_of_long_sentences():
    ends, kinds = ordered.candidates(40, np.array([5, 30, 39]), 10)
    assert ends.tolist() == [5, *range(6, 31), 40] and [k for e, k in zip(ends, kinds) if e in (5, 30, 40)] == [1, 1, 0]
    assert set(kinds[1:25].tolist()) == {2}


def check_packing(rows, got, library, size):
    """Every id is in one piece, sequences are gapless and follow the order of the ids, and each ends where it may."""
    codes = [np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t, _ in rows]
    want = collections.Counter()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"], r["doc_tokens"]].append(r)
    for (i, _, _), code in zip(rows, codes):
        want[i, len(code)] += 1
    for name, pieces in by.items():
        starts = collections.Counter((r["start"], r["length"]) for r in pieces)
        assert sum(r["length"] for r in pieces) == want.pop(name) * name[1], name
        options = [c for (i, _, _), c in zip(rows, codes) if (i, len(c)) == name]
        for r in pieces:
            assert r["ids_crc32"] in {zlib.crc32(c[r["start"] : r["start"] + r["length"]].tobytes()) for c in options}
        assert all(s >= 0 and n > 0 for s, n in starts)
    assert not want
    windows = collections.defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append(r)
    last = None
    for k in sorted(windows):
        at = 0
        for r in sorted(windows[k], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            place = (-1 if r["doc_id"] is None else r["doc_id"], r["doc_tokens"])
            assert last is None or last <= place
            last = place
        assert at <= size
    return [sum(r["length"] for r in w) for w in windows.values()]


@pytest.mark.parametrize("horizon", [100, 1 << 20])
def test_ordered_packing(spark, library, horizon):
    rows = [*zip(ODD_IDS, ODD, itertools.cycle(["en"])), *((100 + k, prose(k, 20 + 37 * k % 400), "en") for k in range(150))]
    got = ordered.pack(table(spark, rows), max_len=128, horizon=horizon).collect()
    lengths = check_packing(rows, got, library, 128)
    assert sum(padding(n, 128) for n in lengths) < 0.03 * sum(lengths)


def test_ordered_packing_is_cheapest(spark, library):
    rows = [(k, prose(k, 5 + 13 * k % 120, end=6), "en") for k in range(60)]
    got = ordered.pack(table(spark, rows), max_len=64).collect()
    ends, prices, at = [], [], 0
    for _, text, _ in rows:
        n = len(library.encode(text, add_special_tokens=False).ids) + 1
        parts, upto = text.split(". "), 0
        for part in parts[:-1]:
            upto += len(library.encode(part + ".", add_special_tokens=False).ids)
            if upto < n - 1:
                ends.append(at + upto)
                prices.append(ordered.SENTENCE_PRICE)
        at += n
        ends.append(at)
        prices.append(0)
    windows = collections.Counter()
    for r in got:
        windows[r["sequence_id"]] += r["length"]
    cost = sum(padding(n, 64) for n in windows.values()) + sum(prices[ends.index(e)] for e in np.cumsum([windows[k] for k in sorted(windows)]).tolist())
    assert cost == cheapest(ends, prices, 64)


def test_ordered_packing_of_nothing_and_of_ranges(spark, library):
    assert ordered.pack(table(spark, [])).count() == 0
    rows = [(k, prose(k, 90), "en") for k in range(40)]
    got = ordered.pack(table(spark, rows).repartition(5), max_len=256, tokens_per_range=1500).collect()
    check_packing(rows, got, library, 256)
    assert len({r["sequence_id"] >> 40 for r in got}) > 1


# ---- 13


def ranked_brute(docs, items, top=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, total = len(own), sum(n for _, _, n in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    out = []
    for name, text in items:
        scored = []
        for i, c, n in own:
            m = 100 - 90 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(name, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def corpus(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    return [(k * 3 % n, " ".join(words[int(300 * rng.random() ** 3)] for _ in range(rng.randint(1, 60)))) for k in range(n)]


def test_ranked_search(spark):
    docs = [*zip(ODD_IDS, ODD), *corpus(500), (600, "W1 w1 rare, Żó"), (600, "W1 w1 rare, Żó")]
    items = [(1, "w1 w2 W250 w250 word"), (2, None), (3, "!?"), (4, "nowhere"), (5, "same text twice here a b"), (6, " ".join(f"w{k}" for k in range(0, 300, 4))), (None, "東京 w200")]
    got = ranking.ranked(table(spark, [(i, t, "en") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == ranked_brute(docs, items)


def test_search_in_passes_shards_and_repeated_items(spark):
    docs = corpus(400)
    items = [(k // 2, f"w{k} w{3 * k} w1 w0") for k in range(10)] + [(9, "w5 w6"), (9, "w5 w6")]
    one = ranking.index(table(spark, [(i, t, "en") for i, t in docs]).repartition(3), shard_docs=40)
    got = ranking.search(one, spark.createDataFrame(items, "item_id long, text string"), per_pass=4, top=5).collect()
    assert sorted(map(tuple, got), key=str) == ranked_brute(docs, items, top=5)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = table(spark, [(1, "a", "en")])
    assert ranking.ranked(table(spark, []), items).count() == 0
    assert ranking.ranked(table(spark, [(1, None, "en"), (2, "?", "en")]), items).count() == 0
    assert ranking.ranked(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in ranking.ranked(docs, items).collect()] == ranked_brute([(1, "a")], [(1, "a")])


def test_ranked_search_matches_sql(spark):
    docs, items = table(spark, [(k, t, "en") for k, t in enumerate(ODD)]), spark.createDataFrame([(1, "same text A b"), (2, "東京 ghi"), (3, None)], "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", items.toArrow())
    assert sorted(map(tuple, ranking.ranked(docs, items).collect())) == sorted(con.sql(ranking.SQL).fetchall())


def test_postings_round_trip():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << rng.integers(1, 34, 5000))
    coded, size = ranking.varints(values)
    assert ranking.numbers(coded).tolist() == values.tolist() and len(coded) == size.sum()


def shard(docs):
    own = ranking.Shard()
    own.add([i for i, _ in docs], pa.array([t for _, t in docs], pa.string()))
    rows = [r for b in own.rows(0) for r in b.to_pylist()]
    n, total = rows[0]["n_docs"], rows[0]["n_terms"]
    lists = {r["term"]: ranking.List(r, n, total) for r in rows[1:]}
    return lists, np.array(rows[0]["ids"]), ranking.measure(np.array(rows[0]["lengths"]), n, total), n


def test_block_maxima_are_exact_and_blocks_are_skipped():
    docs = [(i, f"common common2 {t}" + (" rare" if i % 997 == 5 else "")) for i, t in enumerate(t for _, t in corpus(6000))]
    lists, ids, m, n = shard(docs)
    for own in lists.values():
        doc, tf = own.blocks(np.arange(len(own.last)))
        parts = ranking.part(tf, m[doc])
        assert len(doc) == own.count and own.best.tolist() == [int(parts[a : a + ranking.BLOCK].max()) for a in range(0, len(doc), ranking.BLOCK)]
    item = [(t, ranking.weight(n, lists[t].count), int(lists[t].best.max())) for t in ("rare", "w250", "w120", "w0", "w1", "w2", "common")]
    for own in lists.values():
        own.decoded = 0
    found = ranking.search_shard(lists, ids, np.ones(len(ids), bool), m, item, 3, window=512)
    whole = ranking.search_shard(lists, ids, np.ones(len(ids), bool), m, item, 6000, window=6000)
    assert found.rows == whole.rows[:3]
    seen = {t: lists[t].decoded - len(lists[t].last) for t, _, _ in item}  # beyond the second search, which needs every block
    assert sum(seen.values()) < 0.7 * sum(len(lists[t].last) for t, _, _ in item)
