"""Every operator against a plain version, on odd rows and on a small table."""

import collections
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textward.llm import (
    lbl,
    line_index,
    mixing,
    quality_rank,
    quality_rules,
    simhash,
    style_tree,
    suffix_array,
    tiling,
    token_counts,
)
from textward.llm.common import read
from textward.llm.components import components


def bag(rows):
    return collections.Counter(rows)


# ---- 1 near-duplicates


def expected_groups(rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    top = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), g in zip(rows, top, strict=True):
        least[g] = min((x for x in (i, least.get(g)) if x is not None), default=None)
    return bag((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, top, strict=True))


@pytest.mark.parametrize("crowd", [1024, 2])
def test_near_duplicates(odd, odd_rows, crowd):
    got = simhash.near_duplicates(odd, crowd=crowd).collect()
    assert bag(tuple(r) for r in got) == expected_groups(odd_rows)


def test_near_duplicates_of_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(docs).collect()
    assert bag(tuple(r) for r in got) == expected_groups(rows)


def test_one_of_each_group_stays(odd, odd_rows, nothing):
    kept = simhash.keep_one(odd).collect()
    groups = {g for *_, g in expected_groups(odd_rows)}
    assert sorted(r.doc_id for r in kept) == sorted(groups)
    assert kept[0].asDict().keys() == set(odd.columns)
    assert simhash.keep_one(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


def test_thresholds_leave_no_pair_out():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 400, dtype=np.uint64)
    fp[:200] = (fp[0] & ~np.uint64(0xFFFF)) | (fp[:200] & np.uint64(0xFFFF))  # crowded on one side
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    for m in (2, 3, 4):
        parts = simhash.correlated_parts(len(fp), bits.T @ bits, m)
        assert sorted(i for p in parts for i in p) == list(range(64))
        assert sum(simhash.allocate(len(fp), bits.T @ bits, parts)) == simhash.TAU - m + 1


@pytest.mark.parametrize("batch", [1, 2, 3, 4, 7, 100])
@pytest.mark.parametrize("sizes", [(9,), (1, 9), (9, 1), (2, 7, 5), (4, 3, 8)])
def test_crowd_over_several_batches(batch, sizes):
    keys = np.repeat(np.arange(len(sizes)), sizes)
    fps = np.arange(len(keys))
    table = pa.table({"key": keys, "fp": fps})
    found = simhash._verify(4, 3)(iter(table.to_batches(max_chunksize=batch)))
    marked = {x.as_py() for b in found for x, y in zip(b.column(0), b.column(1), strict=True) if x == y}
    assert marked == {int(f) for k, f in zip(keys, fps, strict=True) if sizes[k] > 3}


def test_crowds_over_small_arrow_batches(spark):
    prints = spark.range(64).selectExpr("id * 281474976710656 AS fp", "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = simhash.groups(prints, "id", crowd=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 64 and {r.component_id for r in got} == {0}


def test_links_of_a_crowd(spark):
    rng = np.random.default_rng(8)
    fp = np.zeros(400, np.int64)
    for i in range(1, len(fp)):  # chains of near values, and some far ones
        flips = rng.integers(0, 32, rng.choice([2, 4, 9]))
        fp[i] = np.bitwise_xor.reduce([fp[rng.integers(0, i)], *(1 << f for f in flips.tolist())])
    fp = np.unique(fp)
    crowd = spark.createDataFrame([(int(x),) for x in fp], "fp bigint")
    plan = simhash._crowd_links(crowd, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        found = [tuple(r) for r in simhash._crowd_links(crowd, 4).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    linked = {frozenset(x) for x in found}
    want = brute.groups(fp.tolist(), lambda a, b: (a ^ b).bit_count() <= 4)
    assert brute.groups(fp.tolist(), lambda a, b: frozenset((a, b)) in linked) == want


def test_helper_columns_clash_with_nothing(odd):
    names = "group component_id n_first has_first f g fp fp__ near__ least__ group__ n__ node root size_ b b__ bucket__ source__ s words left run extra whole open best weight id key"
    rows = odd.select("doc_id", "text", "source", *[F.lit("clash").alias(x) for x in names.split()])
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in simhash.keep_one(odd).collect())
    mixed = mixing.mix(rows)
    assert set(rows.columns) < set(mixed.columns) and mixed.count() == rows.count()
    assert {r.doc_id for r in suffix_array.dedup(rows).collect()} == {r.doc_id for r in rows.collect()}


def test_no_document_is_mixed_more_often_than_allowed(spark):
    rows = [(i, "w " * (i % 5), "ab"[i % 2]) for i in range(200)] + [(1000 + i, "", "c") for i in range(20)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert max(r.copies for r in got) <= 3


@pytest.mark.parametrize("chunk", [200_000, 3])
def test_components(spark, chunk):
    random.seed(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 150), (150, 120), (7, 7)]
    random.shuffle(pairs)
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), chunk).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 120: 100, 150: 100}


# ---- 2 pages


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <header>Top</header><nav><a href=/x>Menu</a></nav><div class="cookie-notice">ok?</div>
    <article><header><h1>Head &amp; tail</h1></header><p>First <b>bo</b>ld.<br>Next   line<p>Second
    &eacute;<ul><li>one<li>two</ul><script>var a = "</p>";</script><form><input></form>
    <div id="comments"><p>reader says</p></div></article><aside>side</aside><footer>foot</footer>"""
    assert style_tree.main_text(page) == "Head & tail First bold. Next line Second é one two"
    assert style_tree.main_text("<p>a <i>b</i><p class='x>y'>c<div>d") == "a b c d"
    assert style_tree.main_text("no markup at all < 3") == "no markup at all < 3"
    assert style_tree.main_text("") == style_tree.main_text("<!-- open") == ""
    assert style_tree.main_text("<div " + "\"'" * 20000) is not None


def test_pages_of_a_host(spark):
    def page(i, body):
        return f"<body><div class=k>Read our weekly letter today</div><div class=m>{body}</div><div class=z>All rights</div></body>"

    own = [(i, f"http://h.example/{i}", page(i, f"<p>text {i} stands alone on this page</p><p>more {i * i}</p>")) for i in range(30)]
    copies = [(100 + i, "http://h.example/c", page(i, "<p>copied article text, all of it</p>")) for i in range(30)]
    odd = [(200, None, None), (201, "::", "<p>x"), (202, "http://few.example", page(1, "lone"))]
    rows = spark.createDataFrame([(*r, "t", 3) for r in own + copies + odd], "page_id bigint, url string, html string, text string, host int")
    got = {r.page_id: r for r in style_tree.extract(rows).collect()}
    assert len(got) == 63
    assert got[5].text == "text 5 stands alone on this page more 25"
    assert got[100].text == got[129].text == "copied article text, all of it"
    assert got[202].text == "lone"
    assert (got[200].text, got[200].n_chars, got[201].text) == ("", 0, "x")
    assert style_tree.extract(rows.limit(0)).count() == 0


def test_repeated_parts_of_articles_stay(spark):
    def body(i):
        return (
            f"<h2>Method</h2><p>Dish {i} needs <a href=/g/roux>roux</a> and {i * 7} eggs</p>"
            f"<h2>Result</h2><p><a href=/by/ann>Ann</a> made {i * 3} of them</p>"
        )

    def page(i, kind):
        menu = "<div class=k><a href=/>Start</a><a href=/all>All dishes</a></div>"
        return f"<body>{menu}{kind.format(body(i))}<div class=z>All rights</div></body>"

    kinds = ["<article>{}</article>", "<main class=x><div>{}</div></main>", "<div class=m>{}</div>"]
    rows = [(100 * k + i, f"http://h{k}.example/{i}", page(i, x)) for k, x in enumerate(kinds) for i in range(12)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(12):
        prose = [f"Dish {i} needs roux and {i * 7} eggs", f"Ann made {i * 3} of them"]
        assert got[i] == got[100 + i] == f"Method {prose[0]} Result {prose[1]}"
        assert all(x in got[200 + i] for x in prose)
        assert "Start" not in got[200 + i] and "All rights" not in got[200 + i]
    noise = frozenset(["/body/article", "/body/article/nav"])
    assert style_tree.main_text("<body><article><p>a<nav>b</nav></article><p>c", noise) == "c"
    assert style_tree.main_text("<body><article><p>a<nav>b</nav></article><p>c", frozenset(["/body/article/p"])) == "a"


def test_story_beside_teasers_and_names_that_say_little():
    story = "<div><h1>Head</h1><p>the whole main story of the page</p></div>"
    assert style_tree.main_text(f"{story}<article class=card>Teaser</article>") == "Head the whole main story of the page"
    kept = "".join(f'<div class="{c}"><p>{c} text</p></div>' for c in ("share-price", "search-results", "notice-board", "formula"))
    gone = "".join(f'<div class="{c}"><p>gone</p></div>' for c in ("related-posts", "share-buttons", "comments-area", "cookie-notice box"))
    assert style_tree.main_text(f"<article>{kept}{gone}</article>") == "share-price text search-results text notice-board text formula text"


def test_different_branches_stay_apart():
    def paths(markup):
        return {path for path, _, _ in style_tree.Page(markup).blocks()}

    deep = "<div>" * 100 + "{}" + "</div>" * 100
    assert len(paths(deep.format("<p>a</p><div>b<div>c</div></div>"))) == 3
    assert len(paths("<p class='a b c d e'>x</p><p class='a b c d f'>y</p>")) == 2
    long = "z" * 200
    assert len(paths(f"<p class={long}a>x</p><p class={long}b>y</p>")) == 2
    assert all(len(x) < 100 * 40 for x in paths("<div>" * 5000 + "x"))


def test_boxes_of_a_host_go_from_articles(spark):
    def page(i, kind):
        box = "<div class=k1><p>Get the app for your phone today</p><ul><li>one</li><li>two</li></ul></div>"
        body = f"<h2>Method</h2><p>Dish {i} needs {i * 7} eggs</p>{box}<p>And {i * 3} spoons, at {i * 11} degrees</p>"
        return f"<body><div class=x1><span>Start page of the kitchen</span></div>{kind.format(body)}</body>"

    kinds = ["<article>{}</article>", "<div class=m>{}</div>"]
    rows = [(100 * k + i, f"http://h{k}.example/{i}", page(i, x)) for k, x in enumerate(kinds) for i in range(20)]
    got = {r.page_id: r for r in style_tree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(20):
        prose = f"Dish {i} needs {i * 7} eggs And {i * 3} spoons, at {i * 11} degrees"
        assert got[i].text == got[100 + i].text == f"Method {prose}"
        assert got[i].by_tree >= 4 and got[i].by_prior == 0


def test_articles_of_table(spark, sf_dir):
    import html
    import re

    got = {r.page_id: r.text for r in style_tree.extract(read(spark, sf_dir, "pages")).collect()}
    for r in read(spark, sf_dir, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))
        assert got[r.page_id] == " ".join(html.unescape(plain).split())


# ---- 3 rules


def repeat_words(w):
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = collections.Counter(windows)
    return len({i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(8)})


def test_ledger(spark, odd, odd_rows, nothing):
    extra = [(50, "a b c d e f g h " * 5 + "z"), (51, "x\nx\n\ny ## |\nx"), (52, "STOP! " * 30)]
    rows = odd.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"), allowMissingColumns=True)
    got = quality_rules.judge(rows).collect()
    assert len(got) == len(odd_rows) + 3
    for r in got:
        w = brute.words(r.text)
        lines = [x for x in (r.text or "").split("\n") if brute.words(x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeat_words(w)
        assert r.base_failed == (len(w) < 20 or 100 * repeat_words(w) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(nothing).count() == 0


def test_policies_and_ablation(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 5), (5, 64)], "doc_id int, failures bigint")
    one = quality_rules.Policy("p", 2, ("too_few_words", "symbols"))
    got = {r.doc_id: r.p_v2 for r in quality_rules.apply_policies(rows, [one]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True}
    cut = {r.rule: (r.failed, r.only_this) for r in quality_rules.ablate(rows, one).collect()}
    assert cut == {"too_few_words": (3, 2), "symbols": (1, 0)}


# ---- 4 ranking


def test_ranking_on_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = read(spark, base, "documents"), read(spark, base, "labels")
    rows = quality_rank.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_ranking_of_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(6, 1), (7, None), (None, 1), (10, 0), (10, 0), (999, 0)], "doc_id bigint, quality int")
    assert quality_rank.score(odd, labels).count() == len(odd_rows)
    none = quality_rank.score(odd, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert quality_rank.score(nothing, labels).count() == 0


# ---- 5 lines


def test_line_dedup(odd, odd_rows, nothing):
    got = line_index.dedup_lines(odd).collect()
    want = brute.dedup_lines(odd_rows)
    assert bag((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == bag(
        (i, *w) for (i, _), w in zip(odd_rows, want, strict=True)
    )
    assert line_index.dedup_lines(nothing).count() == 0


def test_shards_without_hot_lines(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(line_index, "HOT_PART", 1.0)  # nothing is hot: all goes through the shards
    monkeypatch.setattr(line_index, "SHARD_LINES", 2)
    got = line_index.dedup_lines(odd).collect()
    assert bag((r.doc_id, r.n_dropped) for r in got) == bag(
        (i, w[1]) for (i, _), w in zip(odd_rows, brute.dedup_lines(odd_rows), strict=True)
    )


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 20_000, dtype=np.uint64))
    hashed = line_index.PerfectHash.build(keys)
    assert np.array_equal(np.sort(hashed.find(keys)), np.arange(len(keys)))
    assert len(line_index.PerfectHash.build(keys[:0]).find(keys)) == len(keys)


# ---- 6 tokens


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts(spark, sf_dir, odd, odd_rows, vocabulary):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    for rows in (docs, odd):
        got = token_counts.count_tokens(rows, vocabulary).collect()
        for r in got:
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)
    assert len(got) == len(odd_rows)


def test_merges_like_the_library(vocabulary):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    random.seed(5)
    letters = "aAbB 'stmd\n\t.,!#1 2é ñ|\u0085　日"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 80))) for _ in range(3000)]
    texts += ["aaaaaaa" * 70, "x<|endoftext|>y<|endoftext|>", "   ", "\n\n a", "I'll don't 'S"]
    counter = token_counts.Counter(token_counts.Merges.load(vocabulary))
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(texts) == want


# ---- 7 benchmark


def test_tiles_like_plain_tiling():
    rng = random.Random(4)
    for _ in range(60):
        doc = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 40))], np.uint64)
        item = np.array([rng.randint(0, 4) for _ in range(rng.randint(3, 25))], np.uint64)
        pairs = [
            (d, i)
            for d in range(len(doc) - 2)
            for i in range(len(item) - 2)
            if (doc[d : d + 3] == item[i : i + 3]).all()
        ]
        assert sorted(tiling.greedy_tiles(pairs, doc, item)) == sorted(brute.tiles(doc.tolist(), item.tolist(), 3))


def test_contamination(spark, odd, nothing):
    item = " ".join(f"b{i}" for i in range(30))
    halves = " ".join(f"b{i}" for i in [*range(15, 30), *range(15)])
    texts = {1: f"x y {item.upper()}. z", 2: f"x {halves} y", 3: " ".join(f"b{i}" for i in range(12)), 4: None, 5: "b1 b2 b3"}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (8, "b1 b2"), (9, None), (10, "")], "item_id bigint, text string")
    for block in (1 << 20, 40):
        got = tiling.contaminated(docs, bench, block_bytes=block).collect()
        assert bag((r.doc_id, r.item_id, r.n_tiles) for r in got) == bag([(1, 7, 1), (1, 7, 1), (2, 7, 2)])
        assert sorted(r.doc_id for r in tiling.decontaminate(docs, bench, block_bytes=block).collect()) == [3, 4, 5]
    assert tiling.contaminated(odd, bench.limit(0)).count() == 0
    assert tiling.contaminated(nothing, bench).count() == 0
    assert tiling.decontaminate(odd, bench).count() == odd.count()


def test_contaminated_table(spark, sf_dir):
    docs = {r.doc_id: brute.words(brute.az(r.text)) for r in read(spark, sf_dir, "documents").collect()}
    items = {r.item_id: brute.words(brute.az(r.text)) for r in read(spark, sf_dir, "benchmark").collect()}
    whole = {
        (d, i)
        for i, w in items.items()
        for d, t in docs.items()
        if " ".join(w) in " ".join(t)
    }
    got = {(r.doc_id, r.item_id) for r in tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).collect()}
    assert whole <= got and len(got) <= len(whole) + 2


# ---- 8 language model


@pytest.mark.parametrize("frequent", [lbl.FREQUENT, 60])
def test_base_scores(spark, odd, odd_rows, monkeypatch, frequent):
    monkeypatch.setattr(lbl.Lexicon.of.__func__, "__defaults__", (frequent, lbl.CLASSES))
    got = sorted(map(tuple, lbl.score(odd).select("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()))
    want = sorted(brute.base_scores(odd_rows))
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4]) and g[5] < 0


def test_model_beats_counts_where_order_matters(spark, nothing):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        first = rng.randint(0, 19)
        rows.append((i, " ".join(f"t{(first + k) % 20}" for k in range(60))))
    got = lbl.score(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)
    assert lbl.score(nothing).count() == 0


def test_probabilities_are_normalised():
    model = lbl.LogBilinear.start(np.arange(1.0, 17.0), dim=4)
    code = np.arange(16**3)
    model.train(code, np.ones(len(code), np.int64), np.ones(16), 20, 1)
    assert np.allclose((10 ** model.log10()).sum(1), 1, atol=1e-4)


def test_training_takes_every_triple(spark, monkeypatch):
    rng = np.random.default_rng(1)
    seen = np.bincount(np.concatenate(list(lbl._pass_batches(5000, 3, rng))), minlength=5000)
    assert (seen == 3).all()
    monkeypatch.setattr(lbl, "SHARD_TRIPLES", 20)
    counts = {i: 1 + 5000 // (i + 1) for i in range(1000)}
    triples = spark.createDataFrame([*counts.items()], "code bigint, n bigint")
    rows, shards = lbl._shard_rows(triples, len(counts), sum(counts.values()))
    rows = rows.collect()
    assert shards == 100 and {r.shard for r in rows} == set(range(100)) and len(rows) <= 2 * len(counts)
    for i, n in counts.items():
        assert sum(r.n for r in rows if r.code == i) == pytest.approx(n)
    model = lbl.fit(triples, np.ones(16), dim=4, rounds=1, passes=1)
    assert np.isfinite(model.log10()).all()


# ---- 9 mix


def test_mix(spark, odd, odd_rows, nothing):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows) and got == mixing.mix(odd).collect()
    sizes = collections.Counter()
    for r in got:
        assert r.size == len(brute.words(r.text)) and r.taken == r.size * r.copies <= 3 * r.size
        sizes[r.source] += r.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute.water_levels([sizes[s] for s in names], range(1, len(names) + 1)), strict=True))
    assert all(r.target == pytest.approx(want[r.source]) for r in got)
    assert mixing.mix(nothing).count() == 0


def test_mix_of_table_meets_targets(spark):
    rows = mixing.mix(read(spark, "/root/testdata/sf0.01", "documents"))
    sums = rows.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert all(abs(r.n - r.t) <= 0.05 * r.t for r in sums)


def test_clamped_sources(spark):
    own = spark.createDataFrame([("a", 10, 50), ("b", 1000, 1), ("c", 20, 1), ("d", 0, 3)], "source string, source_size bigint, weight int")
    got = {r.source: r.target for r in mixing.water_fill(own).collect()}
    want = brute.water_levels([10, 1000, 20, 0], [50, 1, 1, 3])
    assert [got[s] for s in "abcd"] == pytest.approx(list(want))


# ---- 10 repeated strings


@pytest.mark.parametrize("crowd", [suffix_array.CROWD, 1])
def test_repeated_strings(spark, crowd):
    rng = random.Random(crowd)
    parts = ["".join(rng.choice("ab") for _ in range(900)) for _ in range(5)]
    rows = []
    for k in range(70):
        a, b = rng.sample(parts, 2)
        t = a[rng.randint(0, 300) : rng.randint(500, 900)] + b[rng.randint(0, 300) : rng.randint(500, 900)]
        t = "a" * rng.randint(100, 1500) + t if rng.random() < 0.3 else t
        rows.append((k, t[:200] + "é\0" + t[200:] if rng.random() < 0.2 else t, 1))
    rows += [(None, rows[3][1], 1), (7, rows[7][1], 1), (500, None, 1), (501, "", 1), (502, "ab" * 150, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes int")
    got = suffix_array.dedup(docs, crowd=crowd, block=2000).collect()
    want = brute.remove_repeats([(t or "").encode() for _, t, _ in rows], 400)
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == bag(
        (i, *w) for (i, _, _), w in zip(rows, want, strict=True)
    )


def test_repeated_strings_of_odd_rows(odd, odd_rows, nothing):
    got = suffix_array.dedup(odd).collect()
    want = brute.remove_repeats([(t or "").encode() for _, t in odd_rows], 400)
    assert bag((r.doc_id, r.n_removed, bytes(r.kept)) for r in got) == bag(
        (i, w[1], w[3]) for (i, _), w in zip(odd_rows, want, strict=True)
    )
    assert suffix_array.dedup(nothing).count() == 0


def test_cover_reaches_every_distance():
    cover = np.flatnonzero(suffix_array._IN_COVER)
    assert {int(a - b) % suffix_array.COVER for a in cover for b in cover} == set(range(suffix_array.COVER))


def test_batches_with_no_rows_are_skipped():
    from textward.llm.common import batches

    empty = pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])
    assert list(batches(iter([empty]))) == []
