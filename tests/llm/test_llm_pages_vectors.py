"""Operators on pages and vectors, and the pipeline, against brute-force versions."""

import gzip
import hashlib
import io
import os
import random
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from tempolog.llm import decontaminate, html_extract, packing, quality_classifier, topk, warc  # noqa: E402
from tempolog.llm.queries import tokenizer_path  # noqa: E402
from tempolog.session import shared_folder  # noqa: E402

PAGE = "page_id long, url string, html string, digest string, text string"


# --- archives -----------------------------------------------------------------------------------------------------

def pages():
    draw = random.Random(1)
    long = "<p>" + "".join(chr(draw.randrange(32, 0x500)) for _ in range(400)) + "</p>"
    noise = "".join(chr(draw.randrange(0x100, 0x8000)) for _ in range(90_000))
    return [(5, "http://a/5", long), (3, "http://a/3\nx", long), (9, None, long), (1, "http://a/1", "short"), (2, "http://a/2", "short"),
            (4, "http://b/4", None), (6, "http://b/6", ""), (7, "http://b/7", noise), (8, "http://b/8", noise), (None, "http://b", long),
            (10, "u", "\x1f\x8b\x08 not an archive WARC/1.1\r\n\r\n" * 9), (3, "http://a/3", long)]


def page_rows(rows):
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    for i, _, h in rows:
        data = (h or "").encode()
        owner = first.get(data)
        again = owner is not None and i is not None and i > owner
        yield (i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", owner if again else None)


@pytest.mark.parametrize("range_bytes", [1 << 25, 700])
def test_archives_come_back(spark, range_bytes):
    frame = spark.createDataFrame([(*r, "d", "t") for r in pages()], PAGE)
    got = warc.archive_report(frame, range_bytes=range_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(page_rows(pages()), key=repr)
    assert warc.archive_report(frame.where("false")).count() == 0


def test_files_are_ordinary_gzip(spark):
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(spark.createDataFrame([(*r, "d", "t") for r in pages()], PAGE), path)
    folder = path.removeprefix("file:")
    texts = [gzip.open(f"{folder}/{f}").read() for f in os.listdir(folder) if f.startswith("part-")]
    assert sum(t.count(b"WARC/1.1\r\nWARC-Type: ") for t in texts) == len(pages())


def test_members_start_inside_their_range():
    blocks = [warc.record({"WARC-Type": "response"}, os.urandom(n)) for n in (10, 5000, 0, 900)]
    data = b"\0".join(blocks) + b"\0\x1f\x8b\x08junk" + blocks[0][:20]
    for step in (1, 37, 1000, 10_000):
        found = [b for a in range(0, len(data), step) for b in warc.members(io.BytesIO(data), a, a + step, len(data))]
        assert [len(b) for _, b in found] == [10, 5000, 0, 900]


def test_large_record_keeps_its_length():
    data = warc.record({"WARC-Type": "response"}, bytes(17 << 20))
    assert data[-1] != 0 and len(warc.parse(gzip.decompress(data + b"\0"))[1]) == 17 << 20


# --- pages --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("html, want", [
    ("", []), ("plain &amp; &eacute; &#8212;  x", ["plain & é — x"]),
    ("<nav>m</nav><article><h1>T</h1><p>One<br>two&nbsp; <b>three<p>Four<div class='ad-box'>buy</div></article><footer>f", ["T", "One two three", "Four"]),
    ("<script>var a='</p>'</script><style>p{}</style><article><p>a<!-- <p>no</p> --></article>", ["a"]),
    ("<article><header><h1>H</h1></header><ul><li>a<li>b</ul></article><div class='comments'><article><p>long long long comment</p></article></div>", ["H", "a", "b"]),
    ("<body><div id='cookie-notice'>c</div><main><p>text</p><form>f</form></main><aside>s</aside>", ["text"]),
    ("<p>cut in <a href='x", ["cut in <a href='x"]), ("<div hidden>x</div><div style='display: none'>y</div><p role='note'>z", ["z"]),
])
def test_main_text(html, want):
    assert html_extract.main_blocks(html_extract.parse(html)) == want


def test_template_text_is_left_out(spark):
    def page(i, note):
        return f"<body><div><p>Welcome to our site</p><ul><li>Home</li></ul></div><article><p>Story number {i} of many.</p><p>{note}</p></article></body>"

    rows = [(i, f"http://host.example/{i}", page(i, "Share this story with friends"), "d", "t") for i in range(6)]
    rows += [(100 + i, "http://host.example/copy", page(0, "Share this story with friends"), "d", "t") for i in range(3)]
    rows += [(200, "http://other.example/", page(7, "A remark"), "d", "t"), (201, None, page(8, "x"), "d", "t"), (202, "http://host.example/9", None, "d", "t")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == f"Story number {i} of many." for i in range(6)) and got[101].text == got[0].text
    assert got[200].text == "Story number 7 of many.\n\nA remark" and got[201].text.endswith("x") and got[202].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_every_range_is_a_task(spark):
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(spark.createDataFrame([(*r, "d", "t") for r in pages()], PAGE).repartition(2), path)
    folder = path.removeprefix("file:")
    ranges = sum(-(-os.path.getsize(f"{folder}/{f}") // 5000) for f in os.listdir(folder) if f.startswith("part-"))
    read = warc.read_warc(spark, path, range_bytes=5000)
    assert ranges > 20 and read.rdd.getNumPartitions() == ranges and read.count() == len(pages())


# --- vectors ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block, wide", [(8192, 1.0), (7, 1.0), (50, 2.0**20)])
def test_top_k_equals_all_pairs(spark, block, wide):
    draw = random.Random(6)
    rows = [(i, [draw.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) * wide for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [1.0 * wide, 1.0 * wide, 0.0, 0.0]) for i in range(30)]
    rows += [(300, None), (301, [None, 1.0, 1.0, 1.0]), (350, [float("nan")] * 4), (400, [float("inf"), 0.0, 0.0, 0.0]), (450, [1.0, 2.0]),
             (None, [1.0] * 4), (500, [0.0] * 4)]
    frame = spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, score int, ids int, entry int")
    able = {i: [int(x * 256 // 1) for x in v] for i, v in rows if i is not None and i < 300 or i in (450, 500)}
    want = []
    for q in able:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(able[q], v)), i) for i, v in able.items() if i != q and len(v) == len(able[q]))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:5])]
    got = topk.top_k(frame, block=block)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(frame.where("false")).count() == 0


@pytest.mark.parametrize("block", [8192, 2])
def test_top_k_of_repeated_rows(spark, block):
    """Repeats of a row are candidates each; an id with several vectors is one query with all of them."""
    rows = [(0, [1.0, 1.0])] * 6 + [(7, [1.0, 1.0]), (3, [0.125, 0.125])] + [(9, [1.0, 0.5])] * 7 + [(11, [0.5, 1.0])] * 2
    rows += [(50, [1.0, 0.25 * k]) for k in range(8)] + [(12, [1.0, 1.0]), (50, [1.0, 1.0])]
    whole = [(i, [int(x * 256) for x in v]) for i, v in rows]
    want = []
    for q in (0, 50):
        queries = {tuple(v) for i, v in whole if i == q}
        found = sorted((-sum(a * b for a, b in zip(w, v)), i) for w in queries for i, v in whole if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block)
    assert sorted(map(tuple, got.collect())) == want


# --- pipeline -----------------------------------------------------------------------------------------------------

def test_pipeline_stages_act_on_what_is_left(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in quality_classifier.quality_scores(docs, labels).collect()}
    left = {r.doc_id for r in good.collect()}
    assert left == {i for i, p in scores.items() if p} and good.columns == columns

    once = corpus_pipeline.STAGES[1][1](spark, good, folder)
    words = {i: (texts[i] or "").encode().lower().split() for i in left}
    sets = {i: frozenset(tuple(w[a:a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset() for i, w in words.items()}
    root = {i: i for i in left}
    while True:
        moved = {i: min(root[j] for j in left if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in left}
        if moved == root:
            break
        root = moved
    left = set(root.values())
    assert {r.doc_id for r in once.collect()} == left and once.columns == columns

    cut = corpus_pipeline.STAGES[2][1](spark, once, folder)
    seen, kept = {}, {}
    for i in sorted(left):
        own = (texts[i] or "").encode().split()
        gone = set()
        for a in range(len(own) - 49):
            if seen.setdefault(tuple(own[a:a + 50]), i) < i:
                gone.update(range(a, a + 50))
        if len(gone) < len(own) or not own:
            kept[i] = b" ".join(w for k, w in enumerate(own) if k not in gone).decode() if gone else texts[i]
    assert {r.doc_id: r.text for r in cut.collect()} == kept and cut.columns == columns

    clean = corpus_pipeline.STAGES[3][1](spark, cut, folder)
    items = [" ".join(x.decode() for x in decontaminate.fold(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    plain = {i: f" {' '.join(x.decode() for x in decontaminate.fold(t or ''))} " for i, t in kept.items()}
    leaked = {i for i, t in plain.items() if any(f" {x} " in t for x in items)}
    assert {r.doc_id for r in clean.collect()} == set(kept) - leaked and clean.columns == columns

    result = corpus_pipeline.run(spark, folder).collect()
    want = packing.pack(clean, tokenizer_path()).collect()
    assert sorted(map(tuple, result)) == sorted(map(tuple, want)) and {r.doc_id for r in result} == set(kept) - leaked
