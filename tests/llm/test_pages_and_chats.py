import html
import json
import random
import re

from palimpsest.llm import chat_format, html_extract
from palimpsest.llm.html_extract import Page, kids, main_text, matching


def test_pages_of_the_table(spark, sf_dir):
    """The table's pages have one article each; a plain rendering of it is the main text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", x))).strip() for x in re.split("</?(?:p|h1)>", article))
        want = "\n".join(x for x in blocks if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_parts_that_are_no_article():
    source = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use</div>
    <div id=main><div class=post><h2>T&eacute;st &lt;x&gt;</h2>One <b>two</b>three<br>four <script>var a="</p>"</script><div>five &amp; six</div><ul><li>a<li>b</ul>
    <table><tr><td>c<td>d</table></div><div class="comments"><p>nice</div></div><form><input><p>x</form><aside>s</aside><!-- c --><footer>f</footer>"""
    assert main_text(Page(source), frozenset(), []) == "Tést <x>\nOne twothree four\nfive & six\na\nb\nc\nd"
    assert main_text(Page(None), frozenset(), []) == main_text(Page("<p"), frozenset(), [])[:0] == ""


def test_wrapper_of_a_host(spark):
    """Without telling names: what is constant on a host's pages is template, and the root is where text varies."""
    page = "<body><div><p>Daily Gazette</p><p>All the news</p></div><div><p>Story {0} begins here with words {0}</p><p>and goes on about {0} for long</p></div><div><p>Printed in one place</p></div></body>"
    rows = [(k, "http://h.example/x", page.format(f"topic{k} " * 5)) for k in range(12)] + [(50, "http://single.example/", "<p>only &amp; page"), (51, None, None), (52, "http://h.example/y", "")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].startswith("Story topic") and len(got[k].split("\n")) == 2 and "Printed" not in got[k] for k in range(12))
    assert got[50] == "only & page" and got[51] == got[52] == ""
    clash = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "page_id long, url string, html string, host string, template int, digest int")
    assert {r.page_id: r.text for r in html_extract.extract_main_text(clash).collect()} == got
    assert html_extract.extract_main_text(clash.limit(0)).count() == 0


def test_induction_decides_where_names_mislead(spark):
    """Of a host whose articles are teasers and whose text stands in unnamed blocks, the varying text counts; what every article of a host repeats is template."""
    page = "<body><div class=top><p>Menu of all</p></div><article><p>Read this too</p></article><div><p>{0}</p><p>{1}</p></div><div><p>Imprint and so on</p></div></body>"
    signed = "<body><article><h1>{0}</h1><p>{1}</p><p>Subscribe to our paper now</p></article></body>"
    text = lambda k: (f"Title {k} of the day {k}", " ".join(f"word{k}x{j}" for j in range(30)))
    rows = [(k, "http://teasers.example/", page.format(*text(k))) for k in range(9)] + [(100 + k, "http://signed.example/", signed.format(*text(k))) for k in range(9)]
    rows += [(200 + k, "http://copies.example/", signed.format(*text(7))) for k in range(9)]
    rows += [(300 + k, "http://few.example/", signed.format(*text(k))) for k in range(2)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(9):
        assert got[k] == got[100 + k] == "\n".join(text(k))
        assert got[200 + k] == "\n".join([*text(7), "Subscribe to our paper now"])
    assert got[300] == "\n".join([*text(0), "Subscribe to our paper now"])


def test_names_that_mislead():
    text = lambda source: main_text(Page(source), frozenset(), [])
    assert text('<div class="layout has-sidebar"><p>Text a b c</p></div>') == "Text a b c"
    assert text('<div id="search-results"><p>Text</p></div>') == "Text"
    assert text('<article><p>x</p><div class="social-science"><p>keep</p></div><div class="ad-300x250">no</div></article>') == "x\nkeep"
    assert text("<form><p>whole page in a form</p></form>") == "whole page in a form"
    assert text('<body><div class="sidebar"><p>most of the text is here</p></div></body>') == "most of the text is here"
    assert text("<article><h1>T</h1><p>a long text here</p></article><article><p>teaser</p></article>") == "T\na long text here"
    assert text("<article><p>an article</p><section><h2>Comments (3)</h2><p>bad</p></section></article>") == "an article"
    assert text("<article><p>an article</p><h3>Comments</h3><p>bad</p><p>worse</p></article><p>x</p>") == "an article"
    assert text('<article><p>short</p></article><div class="comments"><p>' + "very long talk " * 50 + "</p></div>") == "short"


def test_tree_matching_against_all_matchings(monkeypatch):
    rng = random.Random(4)

    def tree(depth):
        tag = rng.choice(("div", "ul", "p"))
        return f"<{tag}>" + ("" if depth == 0 or tag == "p" else "".join(tree(depth - 1) for _ in range(rng.randrange(4)))) + f"</{tag}>"

    def most(x, y):
        """The size of the largest matching, by trying all."""
        if x.tag != y.tag:
            return 0

        def lists(xs, ys):
            if not xs or not ys:
                return 0
            return max(lists(xs[1:], ys), lists(xs, ys[1:]), (most(xs[0], ys[0]) + lists(xs[1:], ys[1:])) if xs[0].tag == ys[0].tag else 0)

        return 1 + lists(kids(x), kids(y))

    for _ in range(150):
        a, b = Page(tree(3)), Page(tree(3))
        found = matching(a.root, b.root, 20)
        assert len(found) == most(a.root, b.root)
        of = {id(x): y for x, y in found}
        assert len(of) == len(set(map(id, of.values()))) == len(found)
        assert all(x.tag == y.tag and (x.parent is None or of[id(x.parent)] is y.parent) for x, y in found)
    monkeypatch.setattr(html_extract, "MOST_CELLS", 10)
    long = Page("<div>" + "<p>x</p>" * 300 + "</div>")
    assert len(matching(long.root, Page("<div>" + "<p>y</p>" * 200 + "</div>").root, 20)) == 202


def test_long_lists_are_matched_exactly(monkeypatch):
    """Over 40,000 cells, and whatever part of the table is held at once, as one plain table of all cells has it."""

    def plain(xs, ys):
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs, 1):
            for j, y in enumerate(ys, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (x == y))
        return best[-1][-1]

    rng = random.Random(6)
    xs, ys = (["h2" if rng.random() < 0.1 else rng.choice(("p", "ul", "pre")) for _ in range(n)] for n in (260, 240))
    a, b = (Page("<div>" + "".join(f"<{t}>x</{t}>" for t in tags) + "</div>") for tags in (xs, ys))
    found = matching(a.root, b.root, 5)
    assert len(found) == 2 + plain(xs, ys)
    pairs = [(a.nodes.index(x), b.nodes.index(y)) for x, y in found]
    for cells in (1, 1000, 10**9):
        monkeypatch.setattr(html_extract, "MOST_CELLS", cells)
        assert pairs == [(a.nodes.index(x), b.nodes.index(y)) for x, y in matching(a.root, b.root, 5)]
    deep, other = Page("<div>" * 5000 + "<p>x"), Page("<div>" * 4990 + "<ul><li>y")
    assert len(matching(deep.root, other.root, 5002)) == 4991


def test_deep_and_broken_pages():
    deep = "<div>" * 5000 + "deep"
    assert main_text(Page(deep), frozenset(), []) == "deep"
    assert main_text(Page('<p title="unclosed>text</p><p>more'), frozenset(), [])[-4:] == "more"
    assert main_text(Page("<!-- never closed <p>x"), frozenset(), []) == ""


TOOLS = '<tools>[{"name":"add","parameters":{"properties":{"a":{"type":"integer"},"b":{"type":"number"}},"required":["a"]}}]</tools>'


def test_calls_and_results(spark):
    rows = [
        (1, 0, "system", "x " + TOOLS),
        (1, 1, "user", "hi é"),
        (1, 1, "user", "hi é"),
        (1, 2, "tool", '{"tool_call_id":"c2","content":{"z":1,"a":[1,2]}}'),
        (1, 3, "assistant", 'ok <tool_call>{"id":"c1","name":"add","arguments":{"b":2.5,"a":1}}</tool_call><tool_call>{"id":"c2","name":"add","arguments":{"q":1,"a":"s"}}</tool_call>'),
        (1, 4, "tool", '{"tool_call_id":"c1","content":"3"}'),
        (1, 5, "assistant", '<tool_call>{"id":"c3","name":"nope","arguments":{},"after":["c2"]}</tool_call><tool_call>bad</tool_call>'),
        (1, 6, "tool", '{"tool_call_id":"zz"}'),
        (2, 0, "tool", "junk"),
        (3, 0, "assistant", '<tool_call>{"id":"a","name":"f","arguments":{},"after":["b"]}</tool_call>'),
        (3, 1, "assistant", '<tool_call>{"id":"b","name":"f","arguments":{},"after":["a"]}</tool_call>'),
        (3, 2, "tool", '{"tool_call_id":"a"}'),
        (3, 3, "tool", '{"tool_call_id":"b"}'),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as place", "2 as row")
    got = chat_format.format_conversations(df).collect()
    assert len(got) == len(rows)
    at = {(r.conv_id, r.turn): r for r in got}
    call, late, early = at[1, 3], at[1, 5], at[1, 2]
    assert (call.n_calls, call.n_linked, call.n_invalid, call.n_malformed) == (2, 2, 1, 0)
    assert (late.n_calls, late.n_linked, late.n_invalid, late.n_malformed) == (1, 0, 1, 1)
    assert (early.place, early.depth, early.orphan) == (3, 1, False) and at[1, 6].orphan and at[2, 0].orphan
    assert call.json == '{"content":"ok","conv_id":1,"role":"assistant","tool_calls":[{"arguments":{"a":1,"b":2.5},"id":"c1","name":"add"},{"arguments":{"a":"s","q":1},"id":"c2","name":"add"}],"turn":3}'
    assert json.loads(early.json) == {"content": '{"a":[1,2],"z":1}', "conv_id": 1, "role": "tool", "tool_call_id": "c2", "turn": 2}
    assert any(r.cyclic for r in got if r.conv_id == 3) and not any(r.cyclic for r in got if r.conv_id == 1)


def call(ident, after=(), name="f", **arguments):
    return "<tool_call>" + json.dumps({"id": ident, "name": name, "arguments": arguments, "after": list(after)}) + "</tool_call>"


def answer(ident):
    return json.dumps({"tool_call_id": ident, "content": "x"})


def test_long_chains_are_no_circles(spark):
    """1,000 calls in reversed order, each after the next one's result: the order is exact, and nothing is cyclic."""
    n = 1000
    rows = [(7, k, "assistant", call(f"c{k}", [f"c{k + 1}"] if k + 1 < n else [])) for k in range(n)] + [(7, n + k, "tool", answer(f"c{k}")) for k in range(n)]
    got = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 2 * n and not any(r.cyclic for r in got)
    at = {r.turn: (r.place, r.depth, r.turn) for r in got}
    assert all(at[k] < at[n + k] for k in range(n)) and all(at[n + k + 1] < at[k] for k in range(n - 1))


def test_places_against_brute_force(spark):
    rng = random.Random(8)
    rows, edges, turns = [], {}, {}
    for conv in range(30):
        n = rng.randrange(2, 9)
        for k in range(n):
            names = [f"c{rng.randrange(n)}" for _ in range(rng.randrange(3))] if rng.random() < 0.7 else []
            if conv % 2:  # no circles
                names = [x for x in names if int(x[1:]) > k]
            t, u = rng.randrange(6), rng.randrange(6)
            rows += [(conv, t, f"a{k}", call(f"c{k}", names)), (conv, u, "tool", answer(f"c{k}"))]
            turns[conv, "call", k], turns[conv, "answer", k] = t, u
            edges.setdefault((conv, "answer", k), set()).add((conv, "call", k))
            for x in names:
                edges.setdefault((conv, "call", k), set()).add((conv, "answer", int(x[1:])))
    most = {c: len({k for k in turns if k[0] == c}) for c in range(30)}
    value = {k: (t, 0) for k, t in turns.items()}
    for _ in range(200):
        for late, earlies in edges.items():
            if value[late][1] <= most[late[0]]:
                value[late] = max([value[late], *((value[e][0], value[e][1] + 1) for e in earlies)])
    want = sorted((k[0], turns[k], k[1], *((turns[k], 0) if value[k][1] > most[k[0]] else value[k]), value[k][1] > most[k[0]]) for k in turns)
    got = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.turn, "answer" if r.role == "tool" else "call", r.place, r.depth, r.cyclic) for r in got) == want
    assert any(w[-1] for w in want) and not any(w[-1] for w in want if w[0] % 2)


def test_arguments_against_schemas(spark):
    schema = {
        "type": "object",
        "properties": {"who": {"type": "object", "properties": {"age": {"type": "integer"}, "kind": {"enum": ["a", "b"]}}, "required": ["age"]}, "list": {"type": "array", "items": {"type": ["string", "null"]}}, "free": {"type": "object", "properties": {}, "additionalProperties": True}},
        "required": ["who"],
    }
    tools = "<tools>" + json.dumps([{"name": "f", "parameters": schema}, {"name": "bare"}]) + "</tools>"
    cases = [
        (call("a", who={"age": 3, "kind": "a"}, list=["x", None], free={"z": 1}), 0),
        (call("b", who={"age": "3"}), 1),
        (call("c", who={"kind": "z", "age": 1}), 1),
        (call("d", who={"kind": "a"}), 1),
        (call("e", who={"age": 1, "odd": 2}), 1),
        (call("f", who={"age": 1}, list=["x", 5]), 1),
        (call("g", list=[]), 1),
        (call("h", name="bare"), 0),
        (call("i", name="unknown"), 1),
    ]
    rows = [(1, 0, "system", tools)] + [(1, 1 + k, "assistant", t) for k, (t, _) in enumerate(cases)]
    lost = ['<tool_call>{"id":"p","name":"f","arguments":{"who":{"age":1},"who":{"age":2}}}</tool_call>', '<tool_call>{"id":"q","name":"f","arguments":' + "[" * 3000 + "]" * 3000 + "}</tool_call>"]
    rows += [(1, 50 + k, "assistant", t) for k, t in enumerate(lost)]
    rows += [(1, 60, "assistant", "long " * 200_000 + call("l", who={"age": 1}))]
    names = ("row", "place", "depth", "special", "calls", "schema", "faults", "source", "json", "f_conv", "place_", "b")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *(f"1 as {n}" for n in names))
    got = {r.turn: r for r in chat_format.format_conversations(df).collect()}
    assert [got[1 + k].n_invalid for k in range(len(cases))] == [n for _, n in cases]
    for k in (50, 51):
        assert (got[k].n_malformed, got[k].n_invalid) in ((1, 1), (1, 0))
    assert "who" in got[50].json and got[60].n_invalid == 0 and got[60].n_calls == 1
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_plain_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.json for r in chat_format.format_conversations(turns).collect()}
    for r in turns.collect():
        assert got[r.conv_id, r.turn] == json.dumps({"content": r.text, "conv_id": r.conv_id, "role": r.role, "turn": r.turn}, ensure_ascii=False, separators=(",", ":"))
    assert chat_format.format_conversations(turns.limit(0)).count() == 0
