"""Operators on documents against brute-force versions on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tempolog.llm import decontaminate, license_scan, packing, quality_classifier, simhash, substring, token_count
from tempolog.llm.components import connected_components
from tempolog.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, mark long, score double, words string"
COPIED = " ".join(f"passage{i % 37}x{i}" for i in range(70))


def words(n, seed):
    draw = random.Random(seed)
    return [draw.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()) + str(draw.randrange(30)) for _ in range(n)]


def texts():
    base = " ".join(words(300, 1))
    near = base.split()
    near[150] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "One"), (9, "two words"),
        (10, " ".join(words(120, 2)) + "\n" + COPIED + " " + " ".join(words(40, 3))),
        (11, " ".join(words(30, 4)) + " " + COPIED.replace(" ", "\n", 5)), (12, COPIED), (12, COPIED), (13, COPIED.upper()),
        (None, COPIED), (14, "x" * 50_000), (15, " ".join(words(9000, 5))), (16, "É à ñ b <|endoftext|> İΣ 日本語。 é"),
        (17, "A CC by-NC line.\nAll rights\nreserved; the GNU General Public License cc  BY"), (18, "same same same " * 60),
        (19, "Released under the MIT License"), (20, "license MIT the released, under"), (21, base.upper()),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 0.5, "w") for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return repr(tuple(row))


def same(frame, want):
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(map(tuple, want), key=repr)


# --- token counts -------------------------------------------------------------------------------------------------

def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_token_counts_equal_the_library(docs, nothing):
    tokenizer = library()
    want = []
    for i, t in texts():
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    same(token_count.token_counts(docs, tokenizer_path(), 2048), want)
    assert token_count.token_counts(nothing, tokenizer_path(), 2048).count() == 0


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b <|startoftext|>", "don't WE'LL ''s !'s", "x\u0085y\x1cz", "😀ﬁⅧ²½", "가각 é", "\x00a\x7f", "ſŉß"])
def test_odd_texts_are_split_as_the_library_does(text):
    assert token_count.token_counter(tokenizer_path())(text) == len(library().encode(text, add_special_tokens=False).ids)


def test_merging_takes_the_lowest_rank_first():
    merges = token_count.Merges([("b", "c"), ("a", "b"), ("bc", "d"), ("a", "a")])
    left = lambda s: merges.left([merges.symbol(c) for c in s])
    assert [left("abcd"), left("ab"), left("aaaa"), left("x"), left("aab")] == [2, 1, 2, 1, 2]


# --- near copies --------------------------------------------------------------------------------------------------

def simhash_of(text):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    shingles = [b" ".join(own[i:i + 4]) for i in range(max(1, len(own) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(marks, distance):
    n = len(marks)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates_equal_all_pairs(docs, nothing):
    rows = sorted(texts(), key=lambda r: (r[0] is None, r[0]))
    marks = [simhash_of(t) for _, t in rows]
    roots = components_of(marks, 4)
    same(simhash.near_duplicates(docs), [(i, format(m, "016x"), rows[r][0]) for (i, _), m, r in zip(rows, marks, roots)])
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, *sorted({rows[r][0] for r in roots})]  # the row without doc_id stays


@pytest.mark.parametrize("blocks, limit", [(5, 4096), (6, 4096), (8, 4096), (5, 3), (7, 2)])
def test_any_blocks_find_the_same_components(spark, monkeypatch, blocks, limit):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", limit)
    draw = random.Random(4)
    marks = {draw.getrandbits(64) for _ in range(30)}
    for _ in range(200):
        mark = draw.choice(sorted(marks))
        for b in draw.sample(range(64), draw.randrange(1, 6)):
            mark ^= 1 << b
        marks.add(mark)
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    frame = spark.createDataFrame([(m,) for m in signed], "fp long")
    found = {r.node: r.root for r in connected_components(simhash.hamming_links(frame, 4, blocks)).collect()}
    groups = Counter(found.get(m, m) for m in signed)
    want = Counter(components_of(marks, 4))
    assert sorted(groups.values()) == sorted(want.values())


def test_large_blocks_are_searched_breadth_first():
    draw = np.random.default_rng(1)
    fp = np.unique(draw.integers(0, 1 << 18, 300, dtype=np.uint64))
    group = np.zeros(len(fp), np.uint64)
    got = simhash._roots(group, fp, 3)
    want = components_of([int(x) for x in fp], 3)
    assert len(set(got)) == len(set(want)) and all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(fp)) for j in range(0, i, 7))


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (None, 3)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 200: 100}


# --- repeated passages --------------------------------------------------------------------------------------------

def removed(rows, window):
    """For each row its words and those that are left."""
    first = {}
    for i, t in rows:
        own = (t or "").encode().split()
        if i is not None:
            for a in range(len(own) - window + 1):
                k = tuple(own[a:a + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        own = (t or "").encode().split()
        gone = set()
        for a in range(len(own) - window + 1):
            if i is not None and first[tuple(own[a:a + window])] < i:
                gone.update(range(a, a + window))
        out.append((i, own, [w for k, w in enumerate(own) if k not in gone]))
    return out


@pytest.mark.parametrize("window", [50, 5])
def test_repeated_passages_equal_brute_force(docs, nothing, window):
    want = [(i, len(a), len(a) - len(b), hashlib.sha256(b" ".join(b)).hexdigest()) for i, a, b in removed(texts(), window)]
    same(substring.removal_report(docs, window), want)
    assert substring.removal_report(nothing).count() == 0


def test_texts_without_repeats(docs):
    left = substring.without_repeats(docs)
    assert left.columns == docs.columns
    want = []
    for (i, t), (_, a, b) in zip(texts(), removed(texts(), 50)):
        if a == b:
            want.append((i, t, len(t or "")))
        elif b:
            kept = b" ".join(b).decode()
            want.append((i, kept, len(kept)))
    same(left.select("doc_id", "text", "n_chars"), want)


def test_intervals_are_maximal():
    begin, end = substring.removal_intervals(np.array([0, 1, 5, 11, 30]), 5)
    assert list(zip(begin, end)) == [(0, 10), (11, 16), (30, 35)]
    assert list(substring.sliding_min(np.array([5, 3, 4, 1, 6]), 3)) == [3, 1, 1]


# --- licences -----------------------------------------------------------------------------------------------------

def license_rows():
    for i, t in texts():
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        hits = [(k, x) for p, x in license_scan.PHRASES.items() for k in range(len(own)) if own[k:k + len(p.split())] == p.split()]
        labels, score = {x for _, x in hits}, 1.0 if hits else 0.0
        for line in lower.split("\n"):
            block = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
            for template, x in license_scan.TEMPLATES.items():
                need = set(re.findall(r"[a-z0-9]+", template.lower()))
                share = len(need & block) / len(need)
                if share >= license_scan.CONTAINMENT:
                    labels, score = labels | {x}, max(score, share)
        at = [k for k, _ in hits]
        yield (i, len(own), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})),
               ",".join(sorted(labels)), score)


def test_license_scan_equals_brute_force(docs, nothing):
    want = list(license_rows())
    assert {"mit", "cc-by", "gpl", "reserved"} <= {x for r in want for x in r[6].split(",")}
    same(license_scan.scan(docs), want)
    assert license_scan.scan(nothing).count() == 0


def test_filters_lose_no_block():
    draw = random.Random(2)
    letters = [c.encode() for c in "abcdefghij"]
    templates = {" ".join(c.decode() for c in draw.sample(letters, draw.randrange(1, 8))): str(i) for i in range(12)}
    joined = license_scan.Templates({c: draw.randrange(9) for c in letters}, templates, {}, 0.6)
    for _ in range(300):
        block = set(draw.sample(letters, draw.randrange(0, 10))) | {b"other"}
        want = {i: len(block.intersection(s)) for i, s in enumerate(joined.sets) if len(block.intersection(s)) >= joined.need[i]}
        assert joined.candidates(block) == want


# --- quality ------------------------------------------------------------------------------------------------------

def junk(seed):
    return " ".join(w.upper() + "!!" for w in words(60, seed))


def test_quality_is_learnt_and_held_out(spark, nothing):
    rows = [(i, junk(i) if i % 5 == 0 else " ".join(words(60, i)) + ".", "en", "s", 0, 0, 0, 0.0, "") for i in range(300)]
    rows += [(None, junk(1), "en", "s", 0, 0, 0, 0.0, ""), (900, None, "en", "s", 0, 0, 0, 0.0, ""), (901, "", "en", "s", 0, 0, 0, 0.0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(300)] + [(3, 1, 0), (4, None, 0), (None, 1, 0), (7777, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels).collect()}
    assert len(got) == len(rows)
    for i in range(300):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int(i % 5 != 0) == int(got[i].score >= 0.3) and 0 <= got[i].score <= 1
    assert 0 <= got[900].score == got[901].score <= 1
    kept = quality_classifier.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(300) if i % 5}
    bounded = quality_classifier.quality_scores(docs, labels, bound=100).collect()
    assert sum(r.predicted == int(r.doc_id % 5 != 0) for r in bounded if r.doc_id is not None and r.doc_id < 300) > 290
    none = labels.where("false")
    assert {r.score for r in quality_classifier.quality_scores(docs, none).collect()} == {0.5}
    assert quality_classifier.quality_scores(nothing, labels).count() == 0


def test_the_whole_of_a_run_without_spaces_counts():
    features, draw = quality_classifier.Features(), random.Random(6)
    plain = "".join(draw.choice(["abc", "Def", "12", "+", "//"]) for _ in range(400))
    wide = "文字列、" * 40
    for run, tail in ((plain, "?!x?!X"), (wide, "。1。A"), ("x" * 50_000, "!")):
        before, after = features(run.encode()), features((run + tail).encode())
        assert len(after) and before.tolist() != after.tolist()
    assert quality_classifier.form(b"ABcd12!!!!!x" + b"y" * 90 + b"Z??") == "Uld!!!lU??"
    assert features(("x" * 64).encode()).tolist() == features(("x" * 65).encode()).tolist()


def test_dual_descent_reaches_the_hinge_optimum():
    draw = np.random.default_rng(0)
    x = draw.standard_normal((60, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.3 * draw.standard_normal(60) > 0).astype(int)
    w = quality_classifier.dual_coordinate_descent([np.arange(3)] * 60, list(x), y, 3, rounds=500, tolerance=1e-6)
    loss = lambda v: v @ v / 2 + np.maximum(0, 1 - np.where(y > 0, 1, -1) * (x @ v[:3] + v[3])).sum()
    assert all(loss(w) <= loss(w + 1e-3 * draw.standard_normal(4)) + 1e-6 for _ in range(50))


# --- packing ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("size", [4096, 64])
def test_packing_holds_every_id_once(docs, nothing, monkeypatch, size):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 3000)
    tokenizer = library()
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in texts()]
    pieces = packing.pack(docs, tokenizer_path(), size).toPandas()
    assert (pieces.groupby("sequence_id").length.sum() <= size).all()
    for _, group in pieces.sort_values("offset").groupby("sequence_id"):
        assert (group.offset == group.length.cumsum() - group.length).all()
    # Pieces of a document can be told by their checksums, whichever of equal documents they are of.
    known = {(None if np.isnan(float(i or np.nan)) else i, len(a)): a for (i, _), a in zip(texts(), ids)}
    for r in pieces.itertuples():
        a = known[(None if np.isnan(r.doc_id) else int(r.doc_id), r.doc_tokens)]
        assert zlib.crc32(a[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert pieces.length.sum() == sum(map(len, ids))
    total = pieces.groupby(pieces.doc_id.fillna(-1)).length.sum()
    want = Counter()
    for (i, _), a in zip(texts(), ids):
        want[-1 if i is None else i] += len(a)
    assert {int(k): int(v) for k, v in total.items()} == dict(want)
    ordered = pieces.sort_values(["sequence_id", "offset"]).doc_id.fillna(-1)
    assert ordered.is_monotonic_increasing
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def test_plan_is_optimal():
    draw = random.Random(3)
    for _ in range(20):
        places = [0]
        while len(places) < 14:
            places.append(places[-1] + draw.randrange(1, 9))
        costs = [draw.choice([0, 4, 24]) for _ in places]
        size = 16

        def cost(cuts):
            out = 0
            for a, b in zip(cuts, cuts[1:]):
                n = places[b] - places[a]
                if n > size:
                    return None
                out += packing.SEQUENCE_COST + costs[b] + (0 if n & (n - 1) == 0 else size - n)
            return out

        best = {0: 0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + cost([i, j]) for i in range(j) if cost([i, j]) is not None)
        assert cost(packing.plan(places, costs, size)) == best[len(places) - 1]


def test_checksums_between_cuts():
    ids = np.arange(500, dtype="<u4") * 77
    before = np.array([zlib.crc32(ids[:a].tobytes()) for a in (0, 3, 100)])
    after = np.array([zlib.crc32(ids[:b].tobytes()) for b in (1, 500, 100)])
    want = [zlib.crc32(ids[a:b].tobytes()) for a, b in ((0, 1), (3, 500), (100, 100))]
    assert packing.crc_between(before, after, np.array([1, 497, 0])).tolist() == want


# --- decontamination ----------------------------------------------------------------------------------------------

def test_leaked_items_are_found(spark, nothing):
    item = [" ".join(f"item{k}w{i}" for i in range(30)) + ". The answer is " + f"answer{k} value{k} unit{k}." for k in range(6)]
    common = lambda n, s: " ".join(words(n, s))
    swapped = item[2].split()
    for i in range(0, 30, 3):
        swapped[i] = "other"
    paraphrase = item[3].split()
    for i in range(2, 30, 2):
        paraphrase[i] = f"said{i}"
    rows = [(1, common(400, 1) + " " + item[0].upper() + " " + common(90, 2)), (2, common(50, 3) + "\n" + " ".join(swapped)),
            (3, " ".join(paraphrase)), (4, None), (5, ""), (6, common(800, 4)), (7, " ".join(reversed(item[4].split()))),
            (None, item[5]), (8, item[5]), (8, item[5])]
    rows += [(100 + i, common(200, 100 + i)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0, 0, 0.0, "") for i, t in rows], SCHEMA)
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(item)] + [(90, None), (91, " . ")], "item_id long, text string")
    want = sorted([(1, 0), (2, 2), (3, 3), (8, 5), (8, 5), (-1, 5)])
    for block in (decontaminate.BLOCK_ITEMS, 2):
        found = decontaminate.contaminated(docs, benchmark, block).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in found) == want
    kept = decontaminate.clean_documents(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, *range(100, 160)]
    assert decontaminate.contaminated(nothing, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0


def test_many_paraphrases_are_found_whatever_their_cosine(spark):
    draw = random.Random(12)
    word = lambda: f"v{draw.randrange(4000)}"
    item, rows = [], []
    for k in range(400):
        first, answer = [word() for _ in range(30)], " ".join(word() for _ in range(8))
        item.append((k, " ".join(first) + ". " + answer + "."))
        said = " ".join(w if i % 3 == 0 else " ".join(word() for _ in range(3)) for i, w in enumerate(first)) + " " + answer
        around = [" ".join(word() for _ in range(draw.randrange(10, 40))) for _ in range(2)]
        rows.append((k, f"{around[0]} {said} {around[1]}"))
    rows += [(1000 + k, f"alpha{k} beta") for k in range(4000)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string")
    found = decontaminate.contaminated(docs, benchmark).collect()
    # Brute force: the same rule at every passage of each document, for the item that it was made from.
    items = decontaminate.Items.of(item)
    texts = [items.columns_of(decontaminate.fold(t)) for _, t in rows]
    items.weigh(np.sum([np.bincount(np.unique(t), minlength=len(items.column) + 1) for t in texts], axis=0)[:-1], len(texts))
    share = lambda own, text: items.weight[own[np.isin(own, text)]].sum() / items.weight[own].sum()
    want = set()
    for k, text in enumerate(texts[:400]):
        own, answer = items.words[k], items.answers[k]
        for at in range(0, len(text), decontaminate.STRIDE):
            near = text[max(0, at - len(own)):at + decontaminate.PASSAGE + len(own)]
            common = decontaminate.common_weight(own, near, items.weight) / items.weight[own].sum()
            if common >= decontaminate.SETTLED or common >= decontaminate.PARAPHRASE and share(answer, near) >= decontaminate.ANSWER:
                want.add(k)
    assert {r.doc_id for r in found if r.doc_id == r.item_id} == want and len(want) > 200
    assert min(r.cosine for r in found) < 0.4  # these were left out


def test_random_projection_finds_the_leading_space():
    draw = np.random.default_rng(2)
    rows = draw.integers(0, 40, (500, decontaminate.PASSAGE))
    idf = np.r_[draw.random(40) + 0.5, 0.0]
    dense = np.zeros((500, 41))
    for i, r in enumerate(rows):
        np.add.at(dense[i], r, idf[r])
    dense /= np.sqrt((idf[rows] ** 2).sum(axis=1))[:, None]
    basis = draw.standard_normal((41, 6))
    assert np.allclose(decontaminate.gram_times(rows, idf, basis), dense.T @ (dense @ basis))


def test_common_subsequence():
    weight = np.array([1.0, 2.0, 4.0, 0.0])
    assert decontaminate.common_weight(np.array([0, 1, 2]), np.array([2, 0, 3, 1]), weight) == 4.0
    assert decontaminate.common_weight(np.array([0, 1, 2]), np.array([0, 3, 1]), weight) == 3.0


def test_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    items = decontaminate.Items.of([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "iota kappa lambda mu nu xi omicron pi")])
    items.idf = np.r_[np.linspace(0.5, 2.0, len(items.column)), 0.0]
    draw, none = np.random.default_rng(4), len(items.column)
    texts = [np.where(draw.random(n) < 0.4, draw.integers(0, none, n), none) for n in (0, 1, 7, 16, 17, 31, 32, 33, 48, 49, 500, 9000, 0, 40)]
    basis = np.r_[draw.standard_normal((none, 5)), np.zeros((1, 5))]
    want = np.zeros_like(basis)
    for x in texts:
        if len(starts := decontaminate.heavy_starts(x, items.weight, items.least_mass())):
            want += decontaminate.gram_times(decontaminate._windows(x, starts, none), items.idf, basis)
    stored = spark.createDataFrame([(i, i, x.tolist()) for i, x in enumerate(texts)], "doc_id long, text_key long, columns array<int>").repartition(2)
    assert np.allclose(decontaminate.corpus_gram_times(stored, items, basis), want)
    # More words than the space used to be fitted on.
    many = spark.range(50).selectExpr("id doc_id", "xxhash64(id) text_key", f"transform(sequence(1, 100000), x -> int(x % {none + 1})) columns")
    seen = []
    monkeypatch.setattr(decontaminate, "corpus_gram_times", lambda rows, _, basis: (seen.append(rows.count()), np.zeros_like(basis))[1])
    decontaminate.latent_basis(many, items)
    assert seen == [50, 50]
