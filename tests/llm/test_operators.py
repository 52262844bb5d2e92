"""Operators on small awkward tables, against brute force where SQL has no form."""

import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.llm import (
    anchored,
    bpe,
    common,
    decontaminate,
    exact_dedup,
    html_extract,
    importance,
    jaccard_join,
    line_dedup,
    substring_dedup,
    suffix_dedup,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string"


def words(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gam", "de", "é", "zeta", "eta", "x1"]) + str(rnd.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    base = [words(rnd, 60) for _ in range(12)]
    passage = words(rnd, 30)
    texts = base + [base[0], base[0] + " ", base[1].replace(" ", "\n"), "", None, " \t\n", "one", "a " * 120]
    texts += [base[2][:200] + " " + passage + " " + base[3][:150], passage + " " + base[4], passage, base[5] + " " + passage]
    texts += [base[6].replace("alpha", "omega", 1), " ".join([base[7]] * 3), words(rnd, 6000)]
    made = [(k, t, "en", f"s{k % 10}", None, "clash", "clash") for k, t in enumerate(texts)]
    return made + [made[0], (None, base[8], None, None, None, None, None), (2, "other text, same id " * 9, None, "s1", 3, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def unique(rows):
    """The rows with a doc_id of their own."""
    seen = {}
    for r in rows:
        seen.setdefault(r[0], []).append(r[1])
    return [(k, v[0]) for k, v in seen.items() if k is not None and len(v) == 1]


def test_exact_dedup(docs, empty, rows):
    found = exact_dedup.exact_dedup(docs, digest="sha").collect()
    assert len(found) == len(rows)
    strip = str.maketrans("", "", " \t\n\x0b\f\r")
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(strip), []).append((-len(r[1] or ""), r[0] is None, r[0]))
    for r in found:
        key = (r["text"] or "").translate(strip)
        size, _, first = min(groups[key])
        assert r["sha"] == hashlib.sha256(key.encode()).hexdigest()
        assert (r["group_size"], r["keep_id"]) == (len(groups[key]), first)
        assert r["kept"] == (r["doc_id"] == first and -len(r["text"] or "") == size)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_line_dedup(spark, empty):
    rows = [(k, f" common \nown {k}\n\nnear\t" if k < 7 else f"common\nown {k}", None, f"s{k % 9}") for k in range(18)]
    docs = spark.createDataFrame([*rows, (None, None, None, None)], "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in line_dedup.line_dedup(docs, min_sites=8).collect()}
    assert found[0]["kept_text"] == "own 0\n\nnear\t" and found[0]["n_removed"] == 1
    assert found[9]["kept_text"] == "own 9"
    assert (found[None]["n_lines"], found[None]["kept_text"]) == (1, "")
    near = {r["doc_id"]: r for r in line_dedup.line_dedup(docs, min_sites=7).collect()}
    assert near[0]["kept_text"] == "own 0\n"
    assert line_dedup.line_dedup(empty).count() == 0


def test_bpe_round_trip_and_library(docs, empty, rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    own = bpe.vocabulary(open(bpe.default_tokenizer(), encoding="utf-8").read())
    rnd = random.Random(1)
    letters = "aeiothn  .,'s\n\t é漢字😀½²<|endoftext|>"
    texts = ["", "<|endoftext|>", "a<|endoftext|> b", "  two  spaces \n\n x", "don't we'll", " " * 50, "ab" * 400]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(400)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)
    found = bpe.decode(bpe.encode(docs)).collect()
    assert len(found) == len(rows) and all(r["decoded"] == (r["text"] or "") for r in found)
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_bpe_workers_forget_what_they_encoded(spark, docs):
    """Workers take turns at encoding and decoding: none keeps the encoder's memory after its task."""
    def held(batches):
        from tidemark.llm import bpe

        sizes = [bpe.vocabulary.cache_info().currsize for _ in batches]
        yield pa.RecordBatch.from_arrays([pa.array([max(sizes, default=0)], pa.int32())], names=["held"])

    found = bpe.decode(bpe.encode(docs.repartition(8))).collect()
    assert len(found) == docs.count()
    workers = spark.range(8, numPartitions=8).mapInArrow(held, "held int").collect()
    assert [r["held"] for r in workers] == [0] * 8


def test_bpe_memory_is_bounded(monkeypatch):
    file = open(bpe.default_tokenizer(), encoding="utf-8").read()
    free, bound = bpe.Vocabulary(file), bpe.Vocabulary(file)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdefgh é") for _ in range(300)) for _ in range(20)]
    want = [free.encode(t).tolist() for t in texts]
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    for text, ids in zip(texts, want):
        assert bound.encode(text).tolist() == ids
        assert max(map(len, (bound.pairs, bound.words, bound.chunks))) <= 50 < len(free.pairs)


def test_jaccard_join(docs, empty, rows, spark):
    alone = unique(rows)
    table = spark.createDataFrame(alone, "doc_id long, text string")
    want = jaccard_join.brute_force(alone)
    for block in (1024, 2):
        found = jaccard_join.near_duplicates(table, block=block).collect()
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == want
    assert len(jaccard_join.near_duplicates(docs).collect()) == len(rows)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_join_dense_group(spark):
    rnd = random.Random(8)
    base = words(rnd, 150).split()
    rows = []
    for k in range(80):
        text = list(base)
        for _ in range(rnd.randint(0, 6)):
            text[rnd.randrange(150)] = f"n{rnd.random()}"
        rows.append((k, " ".join(text)))
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()
    want = jaccard_join.brute_force(rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == want


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substring_dedup(spark, docs, empty, rows, hot):
    alone = unique(rows)
    first, want = set(), {}
    for key, text in sorted(alone):
        w = (text or "").split()
        gone = set()
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in first:
                gone |= set(range(i, i + 20))
            first.add(window)
        want[key] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    found = substring_dedup.substring_dedup(spark.createDataFrame(alone, "doc_id long, text string"), hot=hot)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()} == want
    assert substring_dedup.substring_dedup(docs, hot=hot).count() == len(rows)
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(spark, docs, empty, rows, hot):
    alone = unique(rows)
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(alone, "doc_id long, text string"), hot=hot).collect()
    want = suffix_dedup.brute_force(alone)
    for r in found:
        n = sum(s["end"] - s["start"] for s in r["removed_spans"])
        assert (r["n_bytes"], n, len(r["removed_spans"]), bytes(r["kept_bytes"])) == want[r["doc_id"]]
    assert suffix_dedup.suffix_dedup(docs, hot=hot).count() == len(rows)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def passages(copies):
    """Texts of which many share passages, ``copies`` of each kind."""
    rnd = random.Random(5)
    common, texts = words(rnd, 25), []
    for _ in range(copies):
        own = words(rnd, 120)
        texts += [own, f"{words(rnd, 40)} {own[100:500]}", f"{own[:300]} {common} {words(rnd, 30)}", own]
    return [(k, t) for k, t in enumerate(texts)]


DEDUPS = pytest.mark.parametrize(
    "dedup", [substring_dedup.substring_dedup, suffix_dedup.suffix_dedup], ids=["substring", "suffix"]
)


@DEDUPS
@pytest.mark.parametrize("hot", [20_000, 1])
def test_dedup_leaves_no_tables_or_shuffles(spark, tmp_path, monkeypatch, dedup, hot):
    rows = spark.createDataFrame(passages(10), "doc_id long, text string")
    monkeypatch.setattr(common, "scratch_root", lambda spark: str(tmp_path))
    shuffles = lambda: {f for f in Path(blocks).rglob("shuffle_*")}
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].toString()
    before = shuffles()
    dedup(rows, hot=hot)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["spans"]
    # What is left are sums of counts.
    assert sum(f.stat().st_size for f in shuffles() - before if f.suffix == ".data") < 2_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"


@DEDUPS
@pytest.mark.parametrize("hot", [20_000, 1])
def test_dedup_without_broadcasts(spark, monkeypatch, docs, rows, dedup, hot):
    digest = lambda frame: sorted(map(str, frame.collect()))
    table = spark.createDataFrame(passages(10), "doc_id long, text string")
    want = digest(dedup(table, hot=hot)), digest(dedup(docs, hot=hot))
    for limit in ("ANCHORS", "COPIES", "SPANS"):
        monkeypatch.setattr(anchored, limit, 0)
    assert (digest(dedup(table, hot=hot)), digest(dedup(docs, hot=hot))) == want


def test_segments_meet_anchors_without_text(spark, monkeypatch):
    monkeypatch.setattr(anchored, "ANCHORS", -1)
    rows = anchored.keyed(spark.createDataFrame(passages(2), "doc_id long, text string"), "doc_id", "text")
    found = spark.createDataFrame([], "anchor long, hot boolean")
    copies = spark.createDataFrame([], "k1 long, k2 long")
    _, (places,) = anchored.candidates(rows, copies, found, suffix_dedup.byte_units(50, 20))
    assert places.schema["places"].dataType.elementType.names == ["anchor", "start", "windows", "hot"]


def test_decontaminate(spark, docs, empty, rows):
    bench = [(1, words(random.Random(3), 60)), (2, "One"), (3, None), (4, "..."), (None, rows[5][1].upper()), (1, "one")]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    want = {}
    items = [(str(r[0]) if r[0] is not None else "", decontaminate.words_of(r[1])) for r in bench.collect()]
    for k, text in unique(rows):
        w, hit, names = decontaminate.words_of(text), set(), set()
        for name, item in items:
            n = min(10, len(item))
            phrases = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in phrases:
                    hit |= set(range(i, i + n))
                    names.add(name)
        want[k] = (len(w), len(hit), sorted(names))
    for block in (1 << 20, 1):
        found = decontaminate.decontaminate(docs, bench, block_bytes=block).collect()
        assert len(found) == len(rows)
        got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["hit_spans"]), r["hit_items"]) for r in found}
        assert {k: got[k] for k in want} == want
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where(F.size("hit_spans") > 0).count() == 0


def test_toxicity_held_out(spark, empty):
    rnd = random.Random(5)
    texts = [(k, words(rnd, 80) + (" nasty vile" if k % 7 == 0 else ""), k % 7 == 0) for k in range(700)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in texts] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(k, int(k % 3 > 0), int(y)) for k, _, y in texts if k < 500] + [(None, 1, 1), (3, 1, None)],
        "doc_id long, quality int, toxic int",
    )
    model = toxicity.train(docs, labels)
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(found[k]["toxic"] == y for k, _, y in texts)
    assert found[None]["toxic"] is False
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert not toxicity.train(docs, labels.limit(0)).weights.any()


def test_importance(spark, empty):
    rnd = random.Random(6)
    rows = [(k, words(rnd, 50) if k % 5 else "*** $$$ junk " * 20) for k in range(300)] + [(None, None), (0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(150)] + [(None, 1)], "doc_id long, quality int")
    found = importance.select_by_importance(docs, labels, share=0.6).collect()
    kept = [r for r in found if r["kept"]]
    assert len(kept) == round(0.6 * len(rows))
    assert min(r["sample_key"] for r in kept) >= max(r["sample_key"] for r in found if not r["kept"])
    assert not any(r["doc_id"] % 5 == 0 for r in kept if r["doc_id"] and r["text"])
    assert importance.select_by_importance(empty, labels).count() == 0


def test_html(spark):
    sample = spark.read.parquet(f"{SMALL}/pages.parquet").select("html").collect()
    model = html_extract.train([r[0] for r in sample], layouts=500)
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header class='site-header'><a href=/>Site</a></header>"
        "<nav><ul><li><a href=/a>one</a><li><a href=/b>two</a></ul></nav><article><h1>Head&amp;line</h1><p>First  part &lt;b&gt;"
        "<p>Second <b>bold</b><br>line with more words, to be sure.<script>var x='</p>';</script></article>"
        "<section class='comments'><p>Nice one, thanks.</p></section><footer><p>(c) us</p></footer></body></html>"
    )
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (3, None, "a < b")], "page_id long, url string, html string")
    found = [r["text"] for r in html_extract.extract_text(pages, model=model).collect()]
    assert found[0] == "Head&line\n\nFirst part <b>\n\nSecond bold line with more words, to be sure."
    assert found[1] == found[2] == ""
    assert html_extract.extract_text(pages.limit(0), model=model).count() == 0


@pytest.fixture(scope="module")
def html_model(spark):
    sample = spark.read.parquet(f"{SMALL}/pages.parquet").select("html").collect()
    return html_extract.train([r[0] for r in sample])


STORY = (
    "<h1>Big storm hits coast</h1><p>The storm came in the night, and people had to leave their homes.</p><p>Officials said that "
    'the roads, which had been closed, would open on <b>Friday</b>, if the <a href="/w">weather</a> holds.</p>'
)
LOOSE = (
    "The storm came in the night, and people had to leave their homes.<br><br>Officials said that the roads, which had been closed, "
    'would open on <b>Friday</b>, if the <a class="external" href="/w">weather</a> holds. More will be known then.'
)
ADVERT, MENU = '<ins class="ads">Buy cheap shoes XX</ins>', '<a href="/">Home XX</a> <a href="/n">News XX</a> <a href="/s">Sport XX</a>'


@pytest.mark.parametrize("story", [STORY, "<h1>Big storm hits coast</h1>" + LOOSE])
@pytest.mark.parametrize(
    "around",
    [
        ADVERT + "<article>{}</article>",
        "<article>{}" + ADVERT + "</article>",
        MENU + "<article>{}</article>",
        '<div class="wrapper">' + MENU + "<article>{}</article></div>",
        '<article>{}</article><span class="share">Share this XX</span>',
        '<article>{}<span class="share">Share this XX</span></article>',
        "Skip to content XX<article>{}</article>",
        '<div id="page">Skip to content XX<div class="content">{}</div></div>',
        "<article>{}</article>Copyright 2020 Some Company XX. All rights reserved.",
    ],
)
def test_html_parts_beside_blocks(html_model, around, story):
    found = html_extract.extract(f"<html><body>{around.format(story)}</body></html>", html_model)
    assert "XX" not in found
    assert all(w in found for w in ("Big storm hits coast", "leave their homes.", "on Friday, if the weather holds."))


def test_html_labels_leave_out_other_parts():
    page = (
        "<body class='comments'>XX<article class=post><h1>Head</h1>{0}<p>Text of it.</p>{1}</article><section class=comments><article "
        "class=comment><p>Nice XX</p></article></section></body>"
    )
    parts = (
        "<div class='ad-slot'><p>Buy XX</p></div><aside><p>More XX</p></aside><form><label>Mail XX</label></form>"
        "<ul class='social share'><li>Tell XX</li></ul><nav><a href=/>Home XX</a></nav><ins class=ads>Buy XX</ins>",
        "<ol class='comment-list'><li><article><p>Good XX</p></article></li></ol><article id=comment-7>Bad XX</article>",
    )
    nodes = html_extract.parse(page.format(*parts))
    wanted = html_extract.labelled_nodes(nodes, "article") > 0
    assert html_extract.blocks_of(nodes, wanted) == ["Head", "Text of it."]
    only = html_extract.parse("<body><div class=comments><article><p>Nice</p></article></div></body>")
    assert not html_extract.labelled_nodes(only, "article").any()


def test_importance_counts_every_good_document(spark):
    docs = spark.range(20_050).selectExpr("id as doc_id", "concat('w', id) as text")
    labels = docs.selectExpr("doc_id", "1 as quality")
    # Target and raw text are the same, so no n-gram tells them apart (but for a pseudo-count of 0.001).
    found = importance.select_by_importance(docs, labels).agg(F.max(F.abs("log_weight"))).first()[0]
    assert found < 2e-3


@pytest.mark.parametrize("threshold", [0.6, 0.7])
def test_jaccard_join_other_thresholds(spark, threshold):
    rnd, rows = random.Random(21), []
    for k in range(120):
        text = [f"w{rnd.randint(0, 10**6)}" for _ in range(204)]
        # The first of 200 shingles stay; the others of the second text are new.
        same = -(-2 * 200 * threshold // (1 + threshold))
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[: int(same) + 4] + [f"x{rnd.random()}" for _ in range(200 - int(same))]))]
    want = jaccard_join.brute_force(rows, threshold=threshold)
    assert all(c == k - k % 2 for k, (c, _) in want.items())
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == want


@pytest.mark.parametrize(
    "page, text",
    [
        ('<p title="x>one</p><p>two</p>', "one\n\ntwo"),
        ("<p data-x=it's>one</p><p class=\"a\">two</p>", "one\n\ntwo"),
        ("<p title='a>b' lang=en data-q=\"it's > that\">one</p>", "one"),
        ('<p "lone" x>one</p><p a = "b">two</p>', "one\n\ntwo"),
        ("a < b <3 </> c", "a < b <3 c"),
        ("<!-->x<!--->y<!-- <p>z</p> -->w<!doctype html><?php 1 ?>!", "xyw!"),
        ("<head><title>t</title></head><head>one<noscript>two</noscript>", "one\n\ntwo"),
        ("<ul><li>one<li>two<ul><li>three</ul><li>four</ul>", "one\n\ntwo\n\nthree\n\nfour"),
        ("<p>one<b>two<div>three</b>four</div></p>", "onetwo\n\nthreefour"),
        ("one<b ", "one"),
    ],
)
def test_html_tags_as_browsers_read_them(page, text):
    nodes = html_extract.parse(page)
    assert "\n\n".join(html_extract.blocks_of(nodes, np.ones(len(nodes), bool))) == text


@pytest.mark.parametrize(
    "page",
    [
        '<b "' * 250_000,
        "<" * 1_000_000,
        "<p a='" * 200_000,
        "<!--" * 200_000,
        "<head>" * 100_000,
        "<p " + "a" * 1_000_000 + "=1>x",
        "<div>" * 100_000 + "x" + "</div>" * 100_000,
        "<p><i>" * 50_000,
        "".join(f"<x{i}></x{i}>" for i in range(100_000)),
    ],
    ids=["open tags", "lone brackets", "open quotes", "open comments", "heads", "long name", "deep", "inline", "names"],
)
def test_html_broken_pages_take_linear_time(page):
    began = time.process_time()
    nodes = html_extract.parse(page)
    html_extract.describe(nodes)
    html_extract.decode(nodes, np.ones(len(nodes)))
    assert time.process_time() - began < 20


@pytest.mark.parametrize(
    "part, text",
    [
        ("<pre>def f(x):\n  return x</pre>", "def f(x): return x"),
        ("<noscript>The chart shows rain by month.</noscript>", "The chart shows rain by month."),
        ("<table><tr><td>Cost</td><td>5 million</td></tr></table>", "Cost\n\n5 million"),
        ("<dl><dt>Bridge</dt><dd>A way over a river.</dd></dl>", "Bridge\n\nA way over a river."),
        ("<ol><li>First step of the work</li><li>Second step</li></ol>", "First step of the work\n\nSecond step"),
    ],
)
def test_html_article_parts_of_rare_kinds(html_model, part, text):
    story = "The council voted on Monday to repair the old bridge before winter. Work begins in May, officials said."
    page = (
        f"<html><body><nav><a href=/>Home</a><a href=/n>News</a></nav><article><h1>Bridge</h1><p>{story}</p>{part}"
        f"<p>{story}</p></article><footer>All rights reserved</footer></body></html>"
    )
    assert html_extract.extract(page, html_model) == f"Bridge\n\n{story}\n\n{text}\n\n{story}"


def test_html_judged_in_slices_and_beside_clashing_columns(spark, html_model, monkeypatch):
    page = "<body><article><h1>Old bridge</h1>" + "<p>The council voted on Monday, officials said.</p>" * 40 + "</article></body>"
    whole = html_extract.extract(page, html_model)
    monkeypatch.setattr(html_extract, "NODES", 7)
    assert html_extract.extract(page, html_model) == whole
    rows = [(1, page, "mine"), (1, page, "mine"), (None, "", "mine")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = html_extract.extract_text(pages, model=html_model)
    assert found.columns == ["page_id", "html", "text"]
    assert sorted(r.text for r in found.collect()) == sorted(["", whole, whole])
