"""Tool-call linking, page extraction and the pipeline."""

import json
import random
import re
import statistics
import time
from collections import Counter
from html import unescape

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import awkward_rows, documents, prose, with_clashes

from seqwatch.llm import chat, html_text

SMALL = "/root/testdata/sf0.001"
TOOLS = [("add", "a", "integer", True), ("add", "b", "number", False), ("f", "x", "object", True), *chat.TURN_TOOLS]


@pytest.fixture(scope="module")
def tools(spark):
    return spark.createDataFrame(TOOLS, "name string, argument string, type string, required boolean")


def events(spark, rows):
    return chat.parsed_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level string"))


def test_calls_are_linked_ordered_and_validated(spark, tools):
    calls = [
        {"id": "c1", "name": "add", "arguments": {"b": 1.5, "a": 2}},
        {"id": "c2", "name": "add", "arguments": {"a": "x", "z": {"q": 1, "b": [1]}}, "depends_on": ["c1"]},
        {"id": "c3", "name": "f", "arguments": {"x": {"z": 1, "a": None}}, "depends_on": ["c2", "c1"]},
        {"id": "c4", "name": "g", "arguments": {}, "depends_on": ["c5"]},
        {"id": "c5", "name": "f", "arguments": [1], "depends_on": ["c4"]},
        {"id": "c1", "name": "add", "arguments": {}},
        {"id": "c6", "name": "add", "arguments": {"b": 1}, "depends_on": ["nobody"]},
    ]
    rows = [(1, 0, "tool", json.dumps({"tool_call_id": "c3", "content": "early"}), "x"), (1, 1, "assistant", json.dumps({"tool_calls": calls}), "x"), (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": 'é "q"\n'}), "x")]
    rows += [(1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "again"}), "x"), (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": ""}), "x"), (1, 5, "tool", "{bad", "x"), (1, None, None, None, None), (2, 0, "tool", json.dumps({"tool_call_id": "c2", "content": "other"}), "x")]
    found = chat.format_chat(events(spark, rows), tools).collect()
    by = {(r["conv_id"], r["turn"], r["seq"]): r for r in found}
    assert len(found) == len(calls) + len(rows) - 1
    call = lambda k: by[(1, 1, k)]
    assert [(call(k)["link"], call(k)["level"], call(k)["errors"]) for k in range(7)] == [
        ("call", 0, ""), ("unanswered", 2, "type:a;unknown:z"), ("call", 4, ""), ("unanswered", None, "no schema"), ("unanswered", None, "not an object"), ("duplicate", 0, "missing:a"), ("unanswered", None, "missing:a"),
    ]
    assert (by[(1, 0, 0)]["link"], by[(1, 2, 0)]["link"], by[(1, 3, 0)]["link"], by[(1, 4, 0)]["link"], by[(1, 5, 0)]["link"], by[(2, 0, 0)]["link"]) == ("early", "result", "duplicate", "orphan", "message", "orphan")
    order = sorted(found, key=lambda r: (r["conv_id"], r["place"] is None, r["place"], r["level"] is None, r["level"] or 0, r["seq"]))
    at = {(r["kind"], r["call_id"]): k for k, r in enumerate(order) if r["link"] in ("call", "unanswered", "result", "early")}
    assert at[("call", "c1")] < at[("result", "c1")] and at[("call", "c1")] < at[("call", "c2")] < at[("call", "c3")] < at[("result", "c3")]
    assert call(1)["json"] == '{"arguments":{"a":"x","z":{"b":[1],"q":1}},"id":"c2","name":"add","role":"assistant"}'
    assert json.loads(by[(1, 2, 0)]["json"]) == {"content": 'é "q"\n', "role": "tool", "tool_call_id": "c1"}
    for r in found:
        assert json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]


def test_plain_turns_and_empty_tables(spark, tools):
    rows = [(1, 0, "system", "s"), (1, 1, "assistant", "hello"), (1, 3, "user", "a"), (1, 4, "assistant", "b"), (1, 5, "assistant", "c"), (1, 6, "user", None), (1, 6, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.format_chat(chat.turn_events(df), tools).orderBy("turn", "link").collect()
    assert [r["link"] for r in found] == ["message", "message", "call", "result", "duplicate", "duplicate", "unanswered"]
    assert [r["errors"] for r in found][-1] == "type:prompt" and found[-1]["level"] == 2
    assert chat.format_chat(chat.turn_events(df.limit(0)), tools).count() == 0


def test_turns_of_every_tool(spark, tools):
    """Tools, errors and levels of derived calls, on conversations with a very long text and clashing columns."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "x" * (c + 7 * t) if c else "y" * 200_000) for c in range(40) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("level", "place", "link", "errors", "json", "asked", "span"):
        df = df.withColumn(name, F.lit("clash"))
    found = {(r["conv_id"], r["turn"]): r for r in chat.format_chat(chat.turn_events(df), tools).collect()}
    for (c, t), r in found.items():
        if t % 2:
            continue
        n, level = (c + 7 * t if c else 200_000), 0
        tool = ("reply", "lookup", "measure")[t % 3]
        errors = {"lookup": {0: "missing:limit", 1: "type:limit"}, "measure": {3: "unknown:extra", 4: "type:exact"}}.get(tool, {}).get(n % 5, "")
        for k in range(t, -1, -2):  # the chain of calls that this one needs
            m = c + 7 * k if c else 200_000
            if m % 13 == 7:
                level = None
                break
            if k == 0 or m % 4 == 3:
                break
            level += 2
        said = json.loads(r["json"])
        assert (said["name"], r["errors"], r["level"]) == (tool, errors, level)
        assert json.dumps(said, sort_keys=True, separators=(",", ":")) == r["json"]


def test_long_conversations_are_ordered_by_spans(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 3)
    draw = random.Random(1)
    rows = [(c, t, draw.choice(["user", "assistant", "system"]), "x") for c in range(5) for t in range(draw.randint(0, 20))] + [(9, None, "user", "x"), (None, 4, "user", "x"), (None, 5, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.last_asked(df).collect():
        before = [t for c, t, role, _ in rows if c == r["conv_id"] and role == "user" and t is not None and r["turn"] is not None and t < r["turn"]]
        assert r["asked"] == max(before, default=None)


def test_pages_equal_a_plain_reading(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    clashing = pages.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash")).withColumn("paths", F.lit(None).cast("string"))
    found = {r["page_id"]: r for r in html_text.extract(clashing).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert found[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"])


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("<script>only code", ""), ("<p>a <b>c", "a c"), ("x < y && <3 text.", "x < y && <3 text."), ("<p>one&nbsp;&amp;<!-- gone --> two<br>three", "one & two three"),
        ("<p>" * 3000 + "deep", "deep"), ("<b>" * 3000 + "deep", "deep"), ("<div '", "<div '"),
    ],
)
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_furniture_goes():
    long = " ".join(["Words, of a long paragraph, follow here."] * 6)
    page = f"""<body><div class="site-header"><a>Site</a></div><header>Top</header><ul class="main-menu"><li>x</ul><div class=content><h2>Title</h2><p>{long}<p>Second<ul><li>item<li>item two</ul>
    <form>Name</form><div class="ad-box">Buy now, it is cheap, really.</div><aside>See also</aside></div><div id="comments"><p>{long}</div><footer>f</footer></body>"""
    assert html_text.main_text(page) == f"Title\n{long}\nSecond\nitem\nitem two"


LONG = " ".join(["Words, of a long paragraph, follow here."] * 6)


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<body><form><nav>Menu</nav><div><h1>T</h1><p>{LONG}</p><p>b.</p></div><footer>f</footer></form></body>", f"T\n{LONG}\nb."),
        (f'<div class="layout sidebar-right"><article><h1>T</h1><p>{LONG}</p></article><div class=sidebar>See also</div></div>', f"T\n{LONG}"),
        (f'<div class="story-with-related"><h1>T</h1><p>{LONG}</p></div>', f"T\n{LONG}"),
        (f"<div id=content><ul><li><a href=1>Home</a><li><a href=2>About</a></ul><h1>T</h1><p>{LONG}</p><p>{LONG}</p><div>© 2024 Example</div></div>", f"T\n{LONG}\n{LONG}"),
        (f"<div><div><a>Home</a> | <a>Us</a></div><div id=content><h1>T</h1><p>lead.</p><div class=body><p>{LONG}</p><p>{LONG}</p></div></div><div>Contact us</div></div>", f"T\nlead.\n{LONG}\n{LONG}"),
        (f"<div><section><h2>A</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section><section><h2>B</h2><p>{LONG}</p></section></div>", f"A\n{LONG}\n{LONG}\n{LONG}\nB\n{LONG}"),
        (f'<nav>x</nav><article></article><div class=ad>{LONG}</div><footer>f</footer>', ""),
        (f'<article><p>{LONG}<ul><li>one<li>two</ul></article><div class=comments><p>{LONG * 9}</div>', f"{LONG}\none\ntwo"),
        ("<p><a href=x>only a link</a></p>", "only a link"),
    ],
)
def test_content_by_paths_and_priors(html, text):
    assert html_text.main_text(html) == text


ARTICLE = f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article>"


@pytest.mark.parametrize("wrapper", ['class="cookie-consent-open page"', "class=overlay-open", "class=login-state-out", "class=skip-ads", 'id="notice-shown"', "role=alert", "class=popup role=dialog", 'class="ad"'])
@pytest.mark.parametrize("inner", [ARTICLE, ARTICLE.replace("article>", "main>"), ARTICLE.replace("article>", "div>")])
def test_names_around_the_article_say_nothing_of_it(wrapper, inner):
    if "<div>" in inner and wrapper.startswith("role"):
        inner = f"<div>{inner}</div>"
    assert html_text.main_text(f"<body><div {wrapper}>{inner}</div><div class=ad>{LONG}</div><div class=comments><article><p>{LONG * 9}</p></article></div></body>") == f"T\n{LONG}\n{LONG}"


@pytest.mark.parametrize(
    "inner,kept",
    [
        ("<p class=share-price>The share, at 5.</p>", "The share, at 5."),
        ("<blockquote class=reply>He said no, twice.</blockquote>", "He said no, twice."),
        ("<div>Copyright law is the topic, says A.</div>", "Copyright law is the topic, says A."),
        ("<p>© 2020 Foo Inc.</p>", None),
        ("<div>Copyright 2020 Foo Inc.</div>", None),
        ("<div class=ad-leaderboard>Buy now, buy cheap, today.</div>", None),
        ("<p class=sponsored>Buy now, buy cheap, today.</p>", None),
        ("<div class=comment-list><p>Nice one, thanks.</p></div>", None),
        ("<div class=share-links>Share this, or that.</div>", None),
        ("<div class=ad-free>Plain text, here.</div>", "Plain text, here."),
    ],
)
def test_marks_within_the_article(inner, kept):
    page = f"<body><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p>{inner}</article></body>"
    assert html_text.main_text(page) == "\n".join(filter(None, ["T", LONG, LONG, kept]))


def test_ratios_part_what_is_marked_on_the_given_pages(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("html").collect()]
    plain = [html_text.main_text(h) for h in pages]
    draw, values = random.Random(1), html_text.Page.path_values
    monkeypatch.setattr(html_text.Page, "path_values", lambda self, parts: {k: draw.random() for k in values(self, parts)})
    assert sum(html_text.main_text(h) != t for h, t in zip(pages, plain)) > len(pages) // 2


def site(seed):
    """A page of plain divisions, without any mark but its tags, and its article."""
    draw = random.Random(seed)
    said = lambda n: prose(n, draw.random()).capitalize() + ", " + prose(n, draw.random()) + "."
    title, body = prose(4, draw.random()), [said(draw.randint(12, 40)) for _ in range(draw.randint(2, 8))]
    items = [prose(3, draw.random()) for _ in range(draw.randint(0, 4))]
    menu = "".join(f"<li><a href=/{k}>{prose(1, draw.random())}</a>" for k in range(draw.randint(3, 9)))
    links = " | ".join(f"<a href=/{k}>{prose(2, draw.random())}</a>" for k in range(draw.randint(2, 5)))
    listed = f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if items else ""
    article = f"<h1>{title}</h1>" + f"<p>{body[0]}</p>" + listed + "".join(f"<p>{b}</p>" for b in body[1:])
    html = f"<html><body><div>{prose(3, draw.random())}</div><div><ul>{menu}</ul></div><div><div>{article}</div></div><div>{links}</div><div>{prose(5, draw.random())}</div></body></html>"
    return html, "\n".join([title, body[0], *items, *body[1:]])


def test_pages_without_marks_are_told_by_their_paths(monkeypatch):
    pages = [site(k) for k in range(60)]
    assert [html_text.main_text(h) for h, _ in pages] == [t for _, t in pages]
    monkeypatch.setattr(html_text.Page, "path_values", lambda self, parts: {self.paths[p.element]: 1.0 for p in parts})
    assert sum(html_text.main_text(h) != t for h, t in pages) == len(pages)


def test_path_values_equal_a_plain_table():
    """Random trees: the table of each root-to-leaf path counted from the tree itself, smoothed by hand."""
    for seed in range(40):
        draw, leaves = random.Random(seed), []

        def grow(path, depth):
            out = []
            for _ in range(draw.randint(1, 4)):
                tag = draw.choice(["div", "section", "ul", "blockquote"])
                if depth < 3 and draw.random() < 0.5:
                    out.append(f"<{tag}>{grow((*path, tag), depth + 1)}</{tag}>")
                else:
                    text, linked = prose(draw.randint(1, 9), draw.random()) + draw.choice(["", ".", ", a!"]), draw.random() < 0.3
                    leaves.append(((*path, tag), text, linked))
                    out.append(f"<{tag}>" + (f"<b><a>{text}</a></b>" if linked else f"<i>{text}</i>") + f"</{tag}>")
            return "".join(out)

        page = html_text.Page(grow((), 0))
        table = {}
        for path, text, linked in leaves:
            row = table.setdefault(path, [0, 0, 0, 0])
            n = len(text.replace(" ", ""))
            for k, v in enumerate((1, n, sum(c in ".,;:!?" for c in text), n * linked)):
                row[k] += v
        parts = page.parts()
        assert [*page.path_table(parts).values()] == [*table.values()]
        rows, expected = [*table.values()], []
        for k, (n, chars, marks, linked) in enumerate(rows):
            near = [rows[max(k - 1, 0)], rows[k], rows[min(k + 1, len(rows) - 1)]] if len(rows) > 2 else [rows[k]] * 3
            smooth = [0.1 * near[0][c] / near[0][0] + 0.8 * near[1][c] / near[1][0] + 0.1 * near[2][c] / near[2][0] for c in (1, 2)]
            expected.append(smooth[0] * (1 + smooth[1]) * (1 - linked / chars))
        values = [*page.path_values(parts).values()]
        assert values == pytest.approx(expected)
        least = min(statistics.pstdev(expected), max(expected))
        kept = {p.text() for p in page.content()}
        chosen = {t for path, t, _ in leaves if (v := expected[[*table].index(path)]) >= least + 1e-9 or v == max(expected) > 1e-9}
        assert chosen <= kept


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", "<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<a " * 100_000, "<a '\"<" * 100_000 + ">", "<ul><li>" * 50_000, "<form>" * 100_000 + "x", "<!a " * 100_000])
def test_deep_and_broken_pages_take_linear_time(html):
    began = time.time()
    html_text.main_text(html)
    assert time.time() - began < 10  # about 1 s; quadratic handling takes minutes


def test_repeated_and_long_pages(spark):
    words = prose(50_000, 1)
    html = f"<div><h1>T</h1><p>{words}.</p></div>"
    rows = spark.createDataFrame([(1, "u", html), (1, "u", html), (None, None, None)], "page_id long, url string, html string")
    found = sorted(html_text.extract(rows).collect(), key=lambda r: r["n_chars"])
    assert [(r["page_id"], r["url"], r["text"]) for r in found] == [(None, None, ""), *[(1, "u", f"T\n{words}.")] * 2]
    assert found[1]["n_chars"] == len(words) + 3


def test_empty_pages(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "jaccard_join", "decontamination", "byte_bpe"]
    good = [(k, prose(60, k).capitalize() + ".", "en", "s", 1) for k in range(60)]
    bad = [(100 + k, " | ".join(prose(40, 100 + k).split()) + " ###", "en", "s", 1) for k in range(30)]
    leak = prose(30, 555)
    extra = [(200, good[6][1], "en", "s", 1), (201, prose(40, 201) + ". " + leak, "en", "s", 1), (202, "12 34", "en", "s", 1), (203, None, "en", "s", 1)]
    d = str(tmp_path)
    docs = documents(spark, good + bad + extra)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in rows} == set(range(60))
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    stage = corpus_pipeline.language_stage(spark, docs.withColumnRenamed("n_chars", "score"), d)
    assert stage.columns == ["doc_id", "text", "lang", "source", "score"] and stage.filter("doc_id in (202, 203)").count() == 0


def test_pipeline_stages_bear_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns in every stage; then empty tables."""
    import corpus_pipeline

    d = str(tmp_path)
    good = [(100 + k, prose(40, 300 + k).capitalize() + ".", "en", "s", 1) for k in range(40)]
    rows = awkward_rows() + good + [good[0]]
    plain = documents(spark, rows)
    plain.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(k % 9 > 0), None) for k, r in enumerate(good)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(None, None), (0, ""), (1, good[5][1])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = with_clashes(plain).withColumn("score__kept", F.lit("clash")).cache()
    whole = {tuple(r) for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, d)
        assert found.columns == docs.columns
        kept[name] = [tuple(r) for r in found.collect()]
        assert {*kept[name]} <= whole
    ids = lambda name: Counter(r[0] for r in kept[name])
    assert not {1, 2, 3, 4} & {*ids("language_id")} and ids("language_id")[100] == 2
    assert ids("quality_classifier")[100] in (0, 2)
    assert ids("jaccard_join") == Counter({r[0]: 1 for r in rows if r[0] not in (6, 7, 8, 12)})
    assert ids("decontamination") == Counter(r[0] for r in rows if r[0] != 105)
    coded = corpus_pipeline.token_stage(spark, docs, d).collect()
    assert Counter(r["doc_id"] for r in coded) == Counter(r[0] for r in rows)
    assert {r["n_tokens"] for r in coded if r["doc_id"] in (1, 2)} == {0}
    none = str(tmp_path / "none")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{none}/{t}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
