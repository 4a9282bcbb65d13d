"""Pages, archives, vectors, chats and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from colprep.llm import chat_format, html_extract, topk_index, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture
def pages(spark):
    def make(htmls):
        return spark.createDataFrame([(k, None if k % 3 == 2 else f"https://www.Host.org/{k % 4}?q", h, "x", 1) for k, h in enumerate(htmls)], "page_id long, url string, html string, file string, offset int")
    return make


def test_blocks_of_broken_markup():
    found = html_extract.blocks('<div class="a b"><p>x &amp; <b>y<br><p>z</p></div><script>var t="</p>";</script><li>q<li>r <!-- c --> s &am</footer>t<unclosed')
    assert [(path[-1], text) for path, text, _ in found] == [(("p",), "x & y"), (("p",), "z"), (("li",), "q"), (("li",), "r s &am"), (("li",), "t<unclosed")]
    assert html_extract.blocks("") == []


def test_blocks_without_optional_tags():
    body = "<h1>Big</h1><p>x <b>y</b><p>z"
    heads = ["<html><head><title>t</title><meta a=1><body>", "<head><title>t</title>", "<html><head><script>1</script></head><body>", "<title>t</title>", "<html><head>\n<noscript><p>n</p></noscript><style>p{}</style>\n", ""]
    for head in heads:
        assert [text for _, text, _ in html_extract.blocks(head + body)] == ["Big", "x y", "z"], head
    assert [text for _, text, _ in html_extract.blocks("<head><title>t</title>plain <i>text</i>")] == ["plain text"]
    assert [text for _, text, _ in html_extract.blocks("<head><title>t</title><span>plain</span> text")] == ["plain text"]


def test_gradients():
    rng = np.random.default_rng(0)
    model = html_extract.Labeller()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = [rng.normal(size=(n, html_extract.INPUT)) for n in (3, 5, 1)]
    y = [rng.integers(0, 2, n).astype(float) for n in (3, 5, 1)]
    _, gradient = model.gradients(x, y)
    for name, w in model.w.items():
        at = np.unravel_index(int(rng.integers(0, w.size)), w.shape)
        kept, losses = w[at], []
        for step in (1e-3, -1e-3):
            w[at] = kept + step
            losses.append(model.gradients(x, y)[0])
        w[at] = kept
        assert abs((losses[0] - losses[1]) / 2e-3 - gradient[name][at]) < 1e-3


def test_main_text(spark, pages):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_extract.fit(table)
    prose = "The quick onion thand of the reed was and over then it. " * 3
    other = f"<body><nav><a href=1>Home</a></nav><main><h1>Big title here</h1><p>{prose}</p><div class=ad>Buy now!</div></main><section class='comments'><p>I liked it.</p></section><footer>&copy; x</footer>"
    rows = html_extract.main_text(pages([other, None, ""]), model).orderBy("page_id").collect()
    assert [r["text"] for r in rows] == [f"Big title here\n\n{prose.strip()}", "", ""] and rows[0]["n_chars"] == len(rows[0]["text"])
    got = html_extract.main_text(table, model).collect()
    assert len(got) == table.count() and sum(r["n_chars"] > 0 for r in got) > 0.99 * len(got)
    assert html_extract.main_text(table.limit(0), model).count() == 0


def test_labeller_on_held_out_make_ups(spark):
    """Pages in make-ups that the table does not have, side blocks in the words of the main text: recall and share dropped by kind."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_extract.fit(table)
    rng = random.Random(3)
    main_text = [[t for path, t, _ in html_extract.blocks(r["html"]) if html_extract.weak_label(path) == 1 and len(t) > 30] for r in table.collect() if r["html"]]
    main_text = [t for t in main_text if t]
    around = {"article": "<article>{}</article>", "main": "<main>{}</main>", "content": '<div class="content">{}</div>', "nameless": "<div>{}</div>", "cell": "<table><tr><td>{}</td></tr></table>"}
    beside = {"sidebar": '<div class="sidebar">{}</div>', "comments": '<section class="comments"><h3>Comments</h3>{}</section>', "form": '<form action="/x">{}</form>', "footer": "<footer>{}</footer>",
              "notice": '<div class="cookie-notice">{}</div>'}
    kept: dict[str, list[bool]] = {}
    for n, texts in enumerate(main_text):
        def told(kind, chosen):
            return "".join(f"<p>{x.replace('<', '&lt;')} zq{kind}{n}</p>" for x in chosen)

        side = {kind: box.format(told(kind, rng.sample(other := rng.choice(main_text), min(len(other), rng.randint(1, 3))))) for kind, box in beside.items()}
        form = list(around)[n % 5]
        core = around[form].format("<h1>Some title of the page</h1>" + told(form, texts))
        core = side["sidebar"] + core if n % 2 else core + side["sidebar"]
        page = f"<html><head><title>t</title></head><body><nav><a href=/>Home</a> <a href=/a>About us</a></nav>{side['notice']}{core}{side['comments']}{side['form']}{side['footer']}</body></html>"
        rows = html_extract.blocks(page)
        for (_, text, _), chance in zip(rows, model.chances([html_extract.vectors(rows)])[0]):
            if f"{n}" in text and "zq" in text:
                kept.setdefault(text.rsplit("zq", 1)[1].removesuffix(str(n)), []).append(chance > 0.5)
    share = {kind: sum(v) / len(v) for kind, v in kept.items()}
    assert set(share) == {*around, *beside}
    assert all(share[kind] >= 0.98 for kind in around) and all(share[kind] <= 0.05 for kind in beside), share


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in (0, 1, 2, 5, 9):
        runs = [[((x,), x) for x in sorted(rng.choices(range(40), k=rng.randint(0, 8)))] for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_archives_round_trip(spark, pages):
    long = "<p>" + "é" * 300
    table = pages([long, "short", None, long, "short", "y" * 99, "y" * 100, "y" * 100, long])
    rows = {r["page_id"]: r for r in warc.archive(table).collect()}
    for r in table.collect():
        data, got = (r["html"] or "").encode(), rows[r["page_id"]]
        assert (got["payload_bytes"], got["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert {k: r["refers_to"] for k, r in rows.items() if r["record_type"] == "revisit"} == {3: 0, 7: 6, 8: 0}
    order = sorted(rows.values(), key=lambda r: r["history"])
    assert [r["history"] for r in order] == list(range(9)) and [(r["url_key"], r["captured"]) for r in order] == sorted((r["url_key"], r["captured"]) for r in order)


def test_top_k_cases(spark, monkeypatch):
    monkeypatch.setattr(topk_index, "BLOCK", 64)
    monkeypatch.setattr(topk_index, "ENOUGH", 12)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 12)).round(2)
    v[50:90] = v[50]  # ties
    rows = [(k, [float(x) for x in v[k]], "c") for k in range(400)] + [(1000, None, "c"), (1100, [1.0, None], "c"), (1200, [float("nan")], "c"), (1300, [], "c")]
    got = topk_index.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string")).collect()
    q = np.floor(1024 * v).astype(np.int64)
    for query in (0, 100, 200, 300):
        score = q @ q[query]
        want = [k for k in np.lexsort((np.arange(400), -score)) if k != query][:10]
        mine = sorted((r for r in got if r["query_id"] == query), key=lambda r: r["rank"])
        assert [(r["vec_id"], r["score"]) for r in mine] == [(k, score[k]) for k in want]
    assert len(got) == 40
    assert topk_index.top_k(spark.createDataFrame(rows[:0], "vec_id long, embedding array<double>, ids string")).count() == 0


def test_top_k_repeated_ids_and_unequal_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk_index, "BLOCK", 32)
    monkeypatch.setattr(topk_index, "ENOUGH", 3)
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in rng.normal(size=rng.integers(1, 9)).round(1)]) for k in rng.integers(0, 60, 300) * 10]
    rows += rows[:40] + [(100, [0.0] * 3), (100, [1.0, 2.0]), (100, [1.0, 2.0])]
    got = topk_index.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).collect()
    v = np.zeros((len(rows), 8), np.int64)
    for r, (_, x) in enumerate(rows):
        v[r, : len(x)] = np.floor(1024 * np.array(x))
    for query in {k for k, _ in rows if k % 100 == 0}:
        asked = {tuple(v[r]): r for r, (k, _) in enumerate(rows) if k == query}.values()
        answers = sorted((-int(v[r] @ v[c]), k) for r in asked for c, (k, _) in enumerate(rows) if k != query)
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == query)
        assert mine == [(n, k, -s) for n, (s, k) in enumerate(answers[:4], 1)]


def test_posting_segments_fall_and_hold_every_value():
    values = np.array([[5, -1, 0], [-4, 1 << 40, 3], [0, 0, 0]])
    postings, ends = topk_index.segments(values)
    assert [values.flat[p] for p in postings] == [1 << 40, 5, -4, 3, -1] and ends[-1] == 5 and len(ends) == 64 * 3
    assert ends.reshape(64, 3)[63 - 2].tolist() == [3, 3, 3] and ends.reshape(64, 3)[63 - 1].tolist() == [3, 3, 4]


def test_chat_lines(spark):
    tools = [chat_format.Tool("f", {"a": ("integer", True), "b": ("string", False)})]
    calls = spark.createDataFrame(
        [(1, 0, "p", "f", '{"b": "x", "a": 1}', None), (1, 1, "q", "f", '{"a": "1", "z": 0}', ["p"]), (1, 2, "r", "g", "nope", ["q", "gone"]), (1, 3, "s", "f", None, ["t"]), (1, 4, "t", "f", '{"a":2}', ["s"]), (2, 0, "p", "f", "[1]", [])],
        "conv_id long, turn long, call_id string, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([(1, 5, "p", "ok"), (1, 6, "p", None), (1, 7, "no", "x"), (3, 0, None, "y")], "conv_id long, turn long, call_id string, text string")
    messages = spark.createDataFrame([(1, 9, "user", None), (None, 0, None, 'q"\n')], "conv_id long, turn long, role string, text string")
    rows = {(r["conv_id"], r["turn"]): r for r in chat_format.format_chats(messages, calls, results, tools).collect()}
    assert {k: (r["level"], r["errors"]) for k, r in rows.items() if r["kind"] == "call"} == {
        (1, 0): (0, ""), (1, 1): (1, "type:a,unknown:z,unanswered"), (1, 2): (2, "tool,dangling,unanswered"), (1, 3): (None, "arguments,cycle,unanswered"), (1, 4): (None, "cycle,unanswered"), (2, 0): (0, "arguments,unanswered"),
    }
    assert rows[1, 0]["json"] == '{"arguments":{"a":1,"b":"x"},"id":"p","name":"f","role":"assistant","type":"tool_call"}'
    assert rows[1, 6]["json"] == '{"content":"","role":"tool","tool_call_id":"p"}' and rows[1, 7]["errors"] == "orphan" and rows[3, 0]["errors"] == "orphan"
    assert rows[None, 0]["json"] == '{"content":"q\\"\\n"}' and len(rows) == 12


def plain_levels(after):
    """Levels by repeated passes; None in a cycle or behind one."""
    level, moved = {}, True
    while moved:
        moved = False
        for call, needs in after.items():
            held = [n for n in needs if n in after]
            if call not in level and all(n in level for n in held):
                level[call], moved = 1 + max((level[n] for n in held), default=-1), True
    return level


def test_levels_of_long_chains_and_merges(spark):
    rng = random.Random(11)
    graphs = {
        1: {f"c{k}": [f"c{k - 1}"] if k else [] for k in range(1000)},  # one chain of 1,000 calls
        2: {f"c{k}": [] if not k else rng.sample([f"c{j}" for j in range(k)], min(k, rng.choice([0, 1, 1, 1, 2, 3]))) for k in range(150)},
        3: {"a": ["b"], "b": ["a"], "c": ["b"], "d": ["d"], "e": ["c", "f"], "f": [], "g": ["e"], "h": ["f", "gone"], "i": ["h", "f"], "j": ["i"], "k": ["j", "i"], "l": ["k"]},
        4: {"x": ["gone"], "y": []},
    }
    rows = [(conv, call, [*needs, None]) for conv, graph in graphs.items() for call, needs in graph.items()]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in chat_format.call_levels(calls).collect()}
    want = {(conv, call): plain_levels(graph).get(call) for conv, graph in graphs.items() for call in graph}
    assert got == want and got[1, "c999"] == 999 and got[3, "g"] is None and got[3, "l"] is not None
    assert chat_format.call_levels(calls.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op2_chat_format", "op6_top_k", "op9_warc"])
def test_oracles(spark, name):
    base = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "pages"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = entry_module.queries()[name](spark, SF)
    columns = sorted(result.columns)
    want = base.execute(f"SELECT {', '.join(columns)} FROM ({entry_module.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in result.select(*columns).collect())


def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        seen.append((name, docs.count()))
        if name != "best_fit_packing":
            assert docs.columns == columns
    counts = [n for _, n in seen]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[2] > 100 and docs.select("doc_id").distinct().count() == counts[3]
